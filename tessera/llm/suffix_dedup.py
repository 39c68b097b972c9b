"""Operator 9: exact substring dedup with induced-sorted suffix arrays in shards.

A byte goes if it is covered by a ``width``-byte string (50) that also starts in a document with a
smaller id.

1. *Shards.* Every string of 50 bytes holds 31 20-byte grams; the gram with the smallest hash is its
   minimiser, so equal strings share a minimiser at the same place. The selected grams (about one in
   16 bytes) travel as packed arrays: hash, a hash of the 80 bytes around it, document, position.
   Equal surroundings within a batch are combined before the shuffle: only the smallest document's
   go on, the others are already known to be covered.
2. Grams of a single document end here. An occurrence whose whole surroundings occur in a smaller
   document is covered without looking at a byte: the inside of every copied passage.
3. What is left are the borders of shared passages: grams that several documents hold in different
   surroundings. Their 80 bytes are fetched once for each distinct surroundings and cut to what
   they share with any other surroundings of the gram to its left and to its right; under 50 bytes
   hold no shared string. Of equal ones all but the smallest document's are covered and a gram with one form left is done. The others are concatenated per shard and sorted by induced sorting (``induced.py``); runs of 50-byte starts whose common
   prefixes are 50 or more share a string, and those not of the run's smallest document are covered.
   A gram in more than ``HEAVY`` different surroundings is sorted in smaller groups: of the 30 other bytes of
   a string around it 15 or more stand on one side, so it goes by its 15 bytes to the left and, once more, to the right.
4. The spans of a document are merged and cut out.

Results are exact but for hash collisions: grams compare by 64 bits and, inside one gram, whole
surroundings by 48 bits more; borders compare by bytes.

Defined results: a null text counts as empty; a null id neither removes nor is removed; a repeated
row counts once and each gets the same result; if an id repeats with other texts their strings all
count as the id's, and its spans, cut at each text's end, apply to each. Texts under 50 bytes stay
whole. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed_texts, partitions, raw_texts, unpacked
from .induced import permuted_common_prefixes, suffix_array

WIDTH, GRAM = 50, 20
#: Texts are scanned in groups, and long texts in pieces, of about this size; pieces overlap by MARGIN.
GROUP_BYTES, MARGIN = 1 << 18, 128
#: Shards for each shuffle partition: a shard's arrays take some 50 bytes a gram in one Python worker.
SHARDS = 2
#: Distinct surroundings of a gram (80 bytes each) that are sorted together.
HEAVY = 4096
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_CTX = (1 << 48) - 1


def _gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (at most 31) from each position, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _MULT
    out, width, at = None, 1, 0
    k = 0
    while True:
        if size & width:
            out = h if out is None else out[: len(h) - at] * _STEPS[3] + (h[at:] if at else h)
            at += width
        if 2 * width > size:
            break
        h = h[:-width] * _STEPS[k % 3] + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width, k = 2 * width, k + 1
    out = out[: len(b) - size + 1]
    out = (out ^ (out >> np.uint64(30))) * _STEPS[0]
    return out ^ (out >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values."""
    have, y = 1, x
    while 2 * have <= width:
        y = pick(y[:-have], y[have:])
        have *= 2
    return pick(y[: len(x) - width + 1], y[width - have : width - have + len(x) - width + 1])


def minimisers(b: np.ndarray, starts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all grams that are minimisers of some ``width``-byte string inside one text.

    starts: where the texts begin in ``b`` and, last, its end.
    """
    span = width - gram + 1
    if len(b) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = _gram_hashes(b, gram)
    low = _sliding(h, span, np.minimum)
    # strings that cross a border of texts choose nothing
    bad = np.zeros(len(low) + 1, dtype=np.int64)
    inner = starts[1:-1]
    np.add.at(bad, np.clip(inner - width + 1, 0, len(low)), 1)
    np.add.at(bad, np.clip(inner, 0, len(low)), -1)
    low = np.where(np.cumsum(bad[:-1]) > 0, np.uint64(0), low)
    pad = np.zeros(span - 1, dtype=np.uint64)
    high = _sliding(np.concatenate((pad, low, pad)), span, np.maximum)
    at = np.flatnonzero(high[: len(h)] == h)
    return at, h[at]


class _Prefix:
    """Polynomial prefix hashes modulo 2**64 of one buffer."""

    def __init__(self, b: np.ndarray, base: int = 0x5851F42D4C957F2D):
        n = len(b) + 1
        self.inverse = np.uint64(pow(base, -1, 1 << 64))
        powers = np.full(n, np.uint64(base))
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        back = np.full(n, self.inverse)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(7)) * self.powers[:-1])))

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * _MULT
        h = (h ^ (h >> np.uint64(29))) * _STEPS[1]
        return h ^ (h >> np.uint64(32))


def merge_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans, by document."""
    if not len(doc):
        return doc, lo, hi
    by = np.lexsort((lo, doc))
    doc, lo, hi = doc[by], lo[by], hi[by]
    part = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    shift = part * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + shift)
    new = np.concatenate(([True], (lo + shift)[1:] > reach[:-1]))
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], (reach - shift)[last]


def _later(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray):
    """Order by (key, ctx, doc), where groups of (key, ctx) start, and which rows are not of their group's smallest doc."""
    by = np.lexsort((doc, ctx, key))
    k, c, d = key[by], ctx[by], doc[by]
    first = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    group = np.cumsum(first) - 1
    return by, first, group, d != d[first][group]


_GRAM_SCHEMA = "part int, seeds binary, docs binary"


def _scan(width: int, gram: int, parts: int):
    """Texts -> for each shard the packed grams; part -1 - p carries spans that are already known."""
    side = width - gram

    def emit(ids, raw, base, core):
        sizes = np.array([len(t) for t in raw], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        b = np.frombuffer(b"".join(raw), dtype=np.uint8)
        at, key = minimisers(b, starts, width, gram)
        text = np.searchsorted(starts, at, side="right") - 1
        # a piece's margins belong to its neighbours
        own = (at - starts[text] >= core[text, 0]) & (at - starts[text] < core[text, 1])
        at, key, text = at[own], key[own], text[own]
        zero = starts - np.append(base, 0)
        lo, hi = np.maximum(starts[text], at - side), np.minimum(starts[text + 1], at + width)
        # how the surroundings are cut off at the text's ends is part of them
        ctx = (_Prefix(b).span(lo, hi) + (at - lo).astype(np.uint64) * _STEPS[2]) & np.uint64(_CTX)
        pos, doc = at - zero[text], ids[text]
        by, _, _, late = _later(key, ctx, doc)
        known, kept = by[late], np.sort(by[~late])
        # minimisers are small hashes: mix once more, or the first shards get nearly all
        shard = ((key[kept] * _MULT >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        kept, shard = kept[order], shard[order]
        out_part, out_seeds, out_docs = [], [], []
        bounds = np.searchsorted(shard, np.arange(parts + 1))
        for p in range(parts):
            i = kept[bounds[p] : bounds[p + 1]]
            if len(i):
                local = np.unique(text[i], return_inverse=True)
                seeds = b"".join((
                    key[i].tobytes(), (ctx[i] >> np.uint64(16)).astype("<u4").tobytes(), (ctx[i] & np.uint64(0xFFFF)).astype("<u2").tobytes(),
                    pos[i].astype("<u4").tobytes(), local[1].astype("<u4").tobytes(), (lo - at + side)[i].astype(np.uint8).tobytes(), (hi - at)[i].astype(np.uint8).tobytes(),
                ))
                out_part.append(p)
                out_seeds.append(seeds)
                out_docs.append(ids[local[0]].tobytes())
        d, a, z = merge_spans(doc[known], (lo - zero[text])[known], (hi - zero[text])[known])
        if len(d):
            out_part.append(int(d[0]) % parts)
            out_seeds.append(b"")
            out_docs.append(np.concatenate((d, a, z)).tobytes())
        if not out_part:
            return None
        return pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_seeds, pa.binary()), pa.array(out_docs, pa.binary())], ["part", "seeds", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close():
            ids, raw, base, core = zip(*held)
            return emit(np.array(ids, dtype=np.int64), list(raw), np.array(base, dtype=np.int64), np.array(core, dtype=np.int64))

        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                if text is None or len(text) < width:
                    continue
                for a in range(0, len(text), GROUP_BYTES):
                    z = min(len(text), a + GROUP_BYTES)
                    lo, hi = max(0, a - MARGIN), min(len(text), z + MARGIN)
                    held.append((number[i], text[lo:hi], lo, (a - lo, z - lo)))
                    size += hi - lo
                    if size >= GROUP_BYTES:
                        if (out := close()) is not None:
                            yield out
                        held, size = [], 0
        if held and (out := close()) is not None:
            yield out

    return run


_PIECE_SCHEMA = "kind byte, doc_id long, key long, lo int, hi int, at int"


def _pieces(kind, doc, key, lo, hi, at):
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, dtype=np.int8)), pa.array(doc), pa.array(key.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(at.astype(np.int32))],
        ["kind", "doc_id", "key", "lo", "hi", "at"],
    )


def _unpack(seeds: bytes, docs: bytes):
    n = len(seeds) // 24
    cols, at = [], 0
    for kind, width in (("<u8", 8), ("<u4", 4), ("<u2", 2), ("<u4", 4), ("<u4", 4), ("u1", 1), ("u1", 1)):
        cols.append(np.frombuffer(seeds, dtype=kind, count=n, offset=at))
        at += n * width
    key, high, low, pos, local, left, right = cols
    ctx = (high.astype(np.uint64) << np.uint64(16)) | low.astype(np.uint64)
    return key.astype(np.uint64), ctx, np.frombuffer(docs, dtype=np.int64)[local], pos.astype(np.int64), left.astype(np.int64), right.astype(np.int64)


def _shard(width: int, gram: int, heavy: int):
    """One shard's grams -> kind 0: known spans; kind 1: surroundings to fetch (key, at: gram's place in them); kind 2: those of heavy grams."""
    side = width - gram

    def run(batches):
        held = []
        for batch in batches:
            for seeds, docs in zip(batch.column(1), batch.column(2)):
                seeds, docs = seeds.as_py(), docs.as_py()
                if seeds:
                    held.append(_unpack(seeds, docs))
                else:
                    d, a, z = np.frombuffer(docs, dtype=np.int64).reshape(3, -1)
                    yield _pieces(0, d, np.zeros(len(d), dtype=np.uint64), a, z, np.zeros(len(d)))
        if not held:
            return
        columns = list(zip(*held))
        held.clear()
        key, ctx, doc = (np.concatenate(c) for c in columns[:3])
        by, first, group, late = _later(key, ctx, doc)
        del ctx, group
        key, doc = key[by], doc[by]
        pos, left, right = (np.concatenate(c).astype(np.int32)[by] for c in columns[3:])
        del columns, by
        lo, hi = pos - np.int32(side) + left, pos + right
        del left, right
        d, a, z = merge_spans(doc[late], lo[late], hi[late])
        yield _pieces(0, d, np.zeros(len(d), dtype=np.uint64), a, z, np.zeros(len(d)))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        of_key = np.cumsum(new_key, dtype=np.int32) - np.int32(1)
        starts = np.flatnonzero(new_key)
        least = np.minimum.reduceat(doc, starts)
        several = np.maximum.reduceat(doc, starts) != least
        surroundings = np.add.reduceat(first, starts, dtype=np.int32)
        border = (several & (surroundings > 1))[of_key] & ~late
        # the key's smallest document only serves as a reference: once for each of its surroundings
        border &= (doc != least[of_key]) | first
        crowded = (surroundings > heavy)[of_key]
        for kind, pick in ((1, border & ~crowded), (2, border & crowded)):
            yield _pieces(kind, doc[pick], key[pick], lo[pick], hi[pick], (pos - lo)[pick])

    return run


_SLICE_SCHEMA = "key long, doc_id long, lo int, bytes binary, at int"


def _slices(width: int, gram: int):
    """(id, packed, pieces) -> the surroundings' bytes; those of a heavy gram by either side's bytes."""
    side = (width - gram + 1) // 2

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                keys, docs, lows, out, places = [], [], [], [], []
                for doc, text, pieces in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    raw = unpacked(text.as_py())
                    for p in pieces:
                        piece, at, key = raw[p["lo"] : p["hi"]], p["at"], p["key"]
                        under = [key]
                        if p["kind"] == 2:
                            ends = [piece[at - side : at] if at >= side else b"", piece[at + gram : at + gram + side]]
                            under = [xxhash.xxh64_intdigest(end, (key + k) % (1 << 64)) - (1 << 63) for k, end in enumerate(ends) if len(end) == side]
                        keys += under
                        docs += [doc] * len(under)
                        lows += [p["lo"]] * len(under)
                        out += [piece] * len(under)
                        places += [at] * len(under)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(lows, pa.int32()), pa.array(out, pa.binary()), pa.array(places, pa.int32())], ["key", "doc_id", "lo", "bytes", "at"])

    return run


def shared_spans(pieces: list[bytes], doc: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, lo, hi) of ``width``-byte strings of ``pieces`` that a piece of a smaller document holds."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    # alphabet: the bytes that occur, and 0 between pieces
    raw = np.frombuffer(b"\0".join(pieces), dtype=np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    used = np.bincount(raw, minlength=256) > 0
    narrow = np.cumsum(used).astype(np.uint16)
    b = narrow[raw]
    b[begin[1:] - 1] = 0
    if b.max() < 256:
        b = b.astype(np.uint8)
    sa = suffix_array(b)
    common = permuted_common_prefixes(b, sa, width)
    n_starts = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), n_starts)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)).astype(np.int32)
    of = np.full(len(b), -1, dtype=np.int32)
    of[begin[owner] + offset] = np.arange(len(owner), dtype=np.int32)
    run = np.cumsum(common[sa] < width, dtype=np.int32)
    start = of[sa]
    chosen = start >= 0
    start, run = start[chosen], run[chosen]
    if not len(start):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    d = doc[owner[start]]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
    hit = start[d != least]
    at = lo[owner[hit]] + offset[hit]
    return merge_spans(doc[owner[hit]], at, at + width)


def _agreement(key: np.ndarray, ends: list[bytes]) -> np.ndarray:
    """For each row the longest prefix of its bytes (at most 32) that another row of its key begins with."""
    sizes = np.array([len(e) for e in ends])
    words = np.frombuffer(b"".join(e.ljust(32, b"\0") for e in ends), dtype=">u8").reshape(-1, 4).astype(np.uint64)
    by = np.lexsort((*words.T[::-1], key))
    k, w = key[by], words[by]
    both = np.zeros(len(key) - 1, dtype=np.int64)
    going = k[1:] == k[:-1]
    for i in range(4):
        x = w[1:, i] ^ w[:-1, i]
        for shift in (1, 2, 4, 8, 16, 32):  # all bits below the highest one
            x |= x >> np.uint64(shift)
        same = 8 - ((np.bitwise_count(x).astype(np.int64) + 7) >> 3)
        both += np.where(going, same, 0)
        going &= same == 8
    out = np.zeros(len(key), dtype=np.int64)
    out[by[1:]] = both
    out[by[:-1]] = np.maximum(out[by[:-1]], both)
    return np.minimum(out, sizes)


def _trimmed(rows: list[tuple], width: int, gram: int) -> list[tuple[int, int, int, bytes]]:
    """Whole keys' rows (key, doc, lo, piece, at) -> (key, doc, lo, piece) of those that may hold a shared string, cut to what is shared."""
    if len(rows) < 2:
        return []
    side = width - gram
    key = np.array([r[0] for r in rows], dtype=np.int64)
    left = _agreement(key, [piece[max(0, at - side) : at][::-1] for _, _, _, piece, at in rows])
    right = _agreement(key, [piece[at + gram : at + gram + side] for _, _, _, piece, at in rows])
    out = []
    for i in np.flatnonzero(left + right >= side).tolist():
        key_, doc, lo, piece, at = rows[i]
        first = at - int(left[i])
        out.append((key_, doc, lo + first, piece[first : at + gram + int(right[i])]))
    return out


def _settled(rows: list[tuple[int, int, int, bytes]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes]]]:
    """Trimmed rows of whole keys -> spans (doc, lo, hi) that go, and the rows (doc, lo, piece) left to sort.

    Of equal pieces of a key only the smallest document's can hold more than what goes; it is sorted with the key's other pieces, if any:
    what pieces of different keys share has its minimiser in a key of its own.
    """
    least: dict[tuple[int, bytes], int] = {}
    for key, doc, _, piece in rows:
        least[key, piece] = min(doc, least.get((key, piece), doc))
    forms = Counter(key for key, _ in least)
    gone = [(doc, lo, lo + len(piece)) for key, doc, lo, piece in rows if doc != least[key, piece]]
    return gone, [(doc, lo, piece) for key, doc, lo, piece in rows if forms[key] > 1 and doc == least[key, piece]]


def _sort_shard(width: int, gram: int, most_bytes: int = 1 << 20):
    """Rows sorted by key -> spans. A shard is sorted in runs of whole keys of about ``most_bytes``."""

    def out(spans):
        d, a, z = (np.asarray(v, dtype=np.int64) for v in spans)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], ["doc_id", "lo", "hi"])

    def sort(rows):
        doc, lo, pieces = zip(*rows)
        return out(shared_spans(list(pieces), np.array(doc, dtype=np.int64), np.array(lo, dtype=np.int64), width))

    def run(batches):
        ready, size, held, raw = [], 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if raw >= most_bytes and row[0] != held[-1][0]:
                    gone, some = _settled(_trimmed(held, width, gram))
                    if gone:
                        yield out(merge_spans(*np.array(gone, dtype=np.int64).T))
                    ready += some
                    size += sum(len(r[2]) for r in some)
                    held, raw = [], 0
                    if size >= most_bytes:
                        yield sort(ready)
                        ready, size = [], 0
                held.append(row)
                raw += len(row[3])
        gone, some = _settled(_trimmed(held, width, gram))
        if gone:
            yield out(merge_spans(*np.array(gone, dtype=np.int64).T))
        ready += some
        if ready:
            yield sort(ready)

    return run


def repeated_spans(docs: DataFrame, packed: DataFrame, width: int = WIDTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """``(doc_id, lo, hi)``: byte spans (not yet merged) that go, for documents with any; packed: of ``packed_texts``."""
    n = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).where("doc_id is not null")
    scanned = texts.mapInArrow(_scan(width, gram, SHARDS * n), _GRAM_SCHEMA)
    found = cut(scanned.repartitionById(SHARDS * n, F.col("part")).mapInArrow(_shard(width, gram, heavy), _PIECE_SCHEMA))
    wanted = found.where("kind > 0").groupBy("doc_id").agg(F.collect_set(F.struct("kind", "key", "lo", "hi", "at")).alias("pieces"))
    sliced = packed.join(wanted, F.col("id") == F.col("doc_id")).select("id", "packed", "pieces", "rest").mapInArrow(_slices(width, gram), _SLICE_SCHEMA)
    sorted_ = sliced.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_sort_shard(width, gram), "doc_id long, lo int, hi int")
    return found.where("kind = 0").select("doc_id", "lo", "hi").unionByName(sorted_)


def _cut_out(batches):
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for raw, spans in zip(raw_texts(batch.column(0), batch.column(1)), batch.column(2).to_pylist()):
            lo = np.array([s["lo"] for s in spans or []], dtype=np.int64)
            hi = np.minimum(np.array([s["hi"] for s in spans or []], dtype=np.int64), len(raw))
            keep = lo < hi
            _, lo, hi = merge_spans(np.zeros(int(keep.sum()), dtype=np.int64), lo[keep], hi[keep])
            edges = [0, *np.stack((lo, hi), axis=1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept))
            n_spans.append(len(lo))
            digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per document; width is at most 32 over gram, gram at most 31."""
    if not 0 < gram < 32 or not gram < width <= gram + 32:
        raise ValueError("gram must be 1 to 31 and width above it by 1 to 32")
    packed, without_id = packed_texts(docs.select("doc_id", "text"))
    spans = repeated_spans(docs, packed, width, gram, heavy).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = packed.join(spans, F.col("id") == F.col("doc_id"), "left").select("id", "packed", "spans", "rest")
    without_id = without_id.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return joined.unionByName(without_id).mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: DuckDB: every 50-byte string as hex digits, its smallest document, covered runs as islands, the rest concatenated.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
 w as (select doc_id, i, substr(h, (2 * i + 1)::bigint, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d where n >= 50)),
 f as (select s, min(doc_id) as m from w group by s having min(doc_id) <> max(doc_id)),
 c as (select w.doc_id, w.i, lag(w.i) over (partition by w.doc_id order by w.i) as p from w join f using (s) where w.doc_id > f.m),
 r as (select doc_id, i, sum(case when p is null or i > p + 50 then 1 else 0 end) over (partition by doc_id order by i) as k from c),
 sp as (select doc_id, min(i) as lo, max(i) + 50 as hi from r group by doc_id, k),
 kp as (select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as a, lo as b from sp union all select sp.doc_id, max(hi), any_value(n) from sp join d using (doc_id) group by sp.doc_id),
 kept as (select kp.doc_id, string_agg(substr(h, (2 * a + 1)::bigint, (2 * (b - a))::bigint), '' order by a) as h from kp join d using (doc_id) group by kp.doc_id),
 n as (select doc_id, sum(hi - lo) as removed, count(*) as spans from sp group by doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce(n.removed, 0)::bigint as n_removed, coalesce(n.spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""
