"""Operator 4: SimHash near-duplicates behind a pigeonring filter.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments on a ring. If two fingerprints differ in at
most t bits, the pigeonring principle gives a start segment such that every chain of l consecutive
segments from it holds at most floor(l * t / SEGMENTS) differences. With t = 3 and four segments
these budgets are 0, 1, 2, 3. The first two become *keys* of an equi-join (start segment equal, next
segment equal or differing in one named bit: 4 x 17 keys of 31 or 32 bits), the longer chains and
the full Hamming distance are checked on the candidates.

Inside a key's bucket only what the components need is compared: a breadth-first walk compares each
reached fingerprint with those not reached yet, so a dense bucket of n copies costs about n
comparisons and emits n - 1 edges, never all pairs. A bucket of more than ``WIDE`` fingerprints is
not walked: its members go to a second stage whose keys also fix the third segment (budget 2), which
leaves 16 free bits, so no bucket there can exceed 65,536 fingerprints. Nothing is dropped.

The pipeline's stage asks for documents whose sets of 5-word shingles have Jaccard similarity 0.8 or
more (``similar_groups``). First the pigeonring filter as above finds all fingerprints of 5-word shingles
at 3 differing bits or fewer; the pairs that shingle sets confirm make the classes it starts from. At 0.8
about 15 % of the bits differ, which is beyond 64 bits at 3, and a ring wide enough for it has no chain
that is both selective and sure. So a document has ``LANES`` independent fingerprints (the ring's is the
first), and what the ring can't reach is looked for between different classes only, by keys that are chains
over permuted rings of all the lanes' bits, each with budget 0; their length follows from the number of
documents, their number from the wanted recall at the threshold. Inside a key's bucket all the lanes' bits
together tell pairs that are sure to be alike, which make a tree, doubtful ones and ones too far apart. First
each doubtful member is a candidate with the nearest member walked, so a group of n copies makes about n
candidates; after the components of what the shingle sets confirm, a second round takes each member
with the nearest member of every other component in its bucket. So no group makes all its pairs.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and links like
any other; equal fingerprints share a class; rows with a null id are kept with a null component;
only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, stored
from .words import MIX, Words, grams, mixed, text_groups

BITS, SEGMENTS, SEED = 64, 4, 42
WIDTH = BITS // SEGMENTS
WIDE = 2048
SHINGLE, SIMILAR, RECALL, LANES = 5, 0.8, 0.97, 8
#: Differing bits of all lanes, as deviations from the mean at the threshold: beyond FAR hardly any pair at the threshold, up to SURE hardly any below it.
FAR, SURE = 3.5, -4.5
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: For each half byte, its four bits in four 16-bit lanes.
_LANES = np.array([sum(((x >> k) & 1) << (16 * k) for k in range(4)) for x in range(16)], dtype=np.uint64)
_LANE_LIMIT = 65_535


def shingle_hashes(text: bytes, n: int = 3) -> list[int]:
    """XXH64 (seed 42) of each n-word shingle, repeats included; the whole sequence if shorter."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [h(b" ".join(words), SEED)]
    if n == 3:
        return [h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    return [h(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``counts`` hashes: bit set if set in over half of the run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    pieces = np.maximum(1, -(-counts // _LANE_LIMIT)) * (counts > 0)
    if not pieces.sum():
        return out
    owner = np.repeat(np.arange(len(counts)), pieces)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[owner] + nth * _LANE_LIMIT
    for nibble in range(16):
        lanes = _LANES[((hashes >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.intp)]
        sums = np.add.reduceat(lanes, starts)
        for k in range(4):
            got = np.bincount(owner, ((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64), len(counts))
            out |= (2 * got > counts).astype(np.uint64) << np.uint64(4 * nibble + k)
    return out


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in text_groups(batches, most_rows=512):
            hashes = [np.array(shingle_hashes(text, n), dtype=np.uint64) for text in raw]
            fp = majority(np.concatenate(hashes), np.array([len(h) for h in hashes], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """``(doc_id, fp)``: signed 64-bit SimHash of n-word shingles of whole texts."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints(n), "doc_id long, fp long"
    )


def budgets(t: int) -> list[int]:
    return [(k + 1) * t // SEGMENTS for k in range(SEGMENTS)]


def _flips(width: int, most: int) -> list[int]:
    """Masks of at most ``most`` (0, 1 or 2) set bits."""
    out = [0]
    if most >= 1:
        out += [1 << j for j in range(width)]
    if most >= 2:
        out += [1 << j | 1 << k for j in range(width) for k in range(j)]
    return out


def chain_masks(t: int, length: int) -> list[tuple[int, int]]:
    """For each start segment, the difference masks over the first ``length`` chain segments that keep its budgets."""
    b, out = budgets(t), []
    for start in range(SEGMENTS):
        masks = [0]
        for k in range(length):
            shift = WIDTH * ((start + k) % SEGMENTS)
            masks = [m | f << shift for m in masks for f in _flips(WIDTH, b[k] - bin(m).count("1"))]
        out += [(start, m) for m in masks]
    return out


def _keys(t: int, length: int):
    """Rows ``(key, start, fp)``: fingerprints of one key agree over the chain but for the mask's bits.

    key holds start and mask number besides the bits kept, through a 64-bit mix; a collision of two
    keys only adds candidates, which the checks remove.
    """
    masks = chain_masks(t, length)
    start = np.array([s for s, _ in masks], dtype=np.uint64)
    diff = np.array([m for _, m in masks], dtype=np.uint64)
    span = np.array([sum(((1 << WIDTH) - 1) << (WIDTH * ((s + k) % SEGMENTS)) for k in range(length)) for s, _ in masks], dtype=np.uint64)
    tag = (np.arange(len(masks), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            step = max(1, 200_000 // len(masks))
            for at in range(0, batch.num_rows, step):
                fp = batch.column(0).slice(at, step).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
                only = batch.column(1).slice(at, step).to_numpy(zero_copy_only=False)[:, None]
                key = (fp & span & ~diff) ^ tag
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(32)
                keep = (only < 0) | (only == start.astype(np.int64))
                flat = np.broadcast_to(fp, key.shape)[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[keep].view(np.int64)), pa.array(np.broadcast_to(start, key.shape)[keep].astype(np.int8)), pa.array(flat.view(np.int64))],
                    ["key", "start", "fp"],
                )

    return run


def _ring_ok(x: np.ndarray, start: int, t: int) -> np.ndarray:
    """Chains of 1, 2, ... segments from ``start`` keep their budgets, then the full distance is t at most."""
    ok, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    for k, most in enumerate(budgets(t)):
        seg = (x >> np.uint64(WIDTH * ((start + k) % SEGMENTS))) & np.uint64((1 << WIDTH) - 1)
        total += np.bitwise_count(seg)
        ok &= total <= most
    return ok & (np.bitwise_count(x) <= t)


def walk(fps: np.ndarray, start: int, t: int) -> list[tuple[int, int]]:
    """Spanning edges of one bucket's components; fps are distinct."""
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _ring_ok(left ^ x, start, t)
            if near.any():
                found = left[near]
                edges += [(x, y) for y in found]
                queue += list(found)
                left = left[~near]
    return edges


def _walks(t: int, wide: int | None):
    """Sorted rows (key, start, fp) -> edges (a, b, -1), or (fp, fp, start) for members of wide buckets."""

    def out(a, b, s):
        return pa.RecordBatch.from_arrays([pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (a, b)] + [pa.array(np.array(s, dtype=np.int32))], ["a", "b", "start"])

    def run(batches):
        key = start = None
        held: list[np.ndarray] = []
        size, spilling = 0, False

        def close():
            nonlocal held, size, spilling
            edges = []
            if not spilling and size > 1:
                edges = walk(np.unique(np.concatenate(held)), start, t)
            held, size, spilling = [], 0, False
            return edges

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            s = batch.column(1).to_numpy(zero_copy_only=False)
            f = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            first = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            last = np.append(first[1:], len(k))
            # a bucket of one row inside the batch has no pair: skip it without a Python step
            busy = (last - first > 1) | (first == 0) | (last == len(k))
            edges, wide_fp, wide_start = [], [], []
            for i, j in zip(first[busy], last[busy]):
                if key is None or k[i] != key:
                    edges += close()
                    key, start = k[i], int(s[i])
                piece = f[i:j]
                if wide is not None and not spilling and size + len(piece) > wide:
                    spilling = True
                    for h in held:
                        wide_fp.append(h)
                        wide_start += [start] * len(h)
                    held = []
                if spilling:
                    wide_fp.append(piece)
                    wide_start += [start] * len(piece)
                else:
                    held.append(piece)
                size += len(piece)
            if edges:
                yield out([a for a, _ in edges], [b for _, b in edges], [-1] * len(edges))
            if wide_fp:
                x = np.concatenate(wide_fp)
                yield out(x, x, wide_start)
        edges = close()
        if edges:
            yield out([a for a, _ in edges], [b for _, b in edges], [-1] * len(edges))

    return run


def hamming_edges(fps: DataFrame, t: int = 3, wide: int = WIDE) -> DataFrame:
    """Edges ``(a, b)`` of distinct fingerprints ``fp`` whose components are those of all links at distance <= t."""
    if not 0 <= t <= 3:
        raise ValueError("the ring keys are laid out for at most 3 differing bits")
    n = partitions(fps.sparkSession)
    rows = fps.select("fp", F.lit(-1).cast("int").alias("only")).mapInArrow(_keys(t, 2), "key long, start byte, fp long")
    found = stored(
        rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_walks(t, wide), "a long, b long, start int")
    )
    hot = found.where("start >= 0").select(F.col("a").alias("fp"), F.col("start").alias("only")).distinct()
    deep = hot.mapInArrow(_keys(t, 3), "key long, start byte, fp long")
    more = deep.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_walks(t, None), "a long, b long, start int")
    return found.where("start < 0").select("a", "b").unionByName(more.select("a", "b"))


def simhash_groups(docs: DataFrame, t: int = 3, n: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document."""
    prints = stored(fingerprints(docs, n))
    reps = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = hamming_edges(reps.select("fp"), t)
    ids = (
        edges.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
        .join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    groups = components(ids)
    by_fp = reps.join(groups, reps.rep == groups.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(by_fp, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def shingle_sets(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's n-word shingles (of all words, in a shorter text), and their count by text."""
    w = Words(raw)
    first, h = grams(w, n)
    text = w.text[first]
    sizes = np.diff(w.first)
    for k in np.flatnonzero((sizes > 0) & (sizes < n)):
        one = np.array([sizes[k]], dtype=np.uint64)
        for x in w.hash[w.first[k] : w.first[k + 1]]:
            one = mixed(one + MIX[2]) + x
        text, h = np.append(text, k), np.append(h, mixed(one))
    by = np.lexsort((h, text))
    text, h = text[by], h[by]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))[: len(h)]
    return h[new], np.bincount(text[new], minlength=len(raw))


def _many_fingerprints(n: int, lanes: int):
    def run(batches):
        for part, raw in text_groups(batches):
            h, counts = shingle_sets(raw, n)
            salts = np.arange(1, lanes + 1, dtype=np.uint64) * MIX[2] if len(h) else []
            fps = np.stack([majority(mixed(h + s), counts) for s in salts], axis=1) if len(salts) else np.zeros((len(raw), lanes), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array(fps[:, 0].view(np.int64))], ["doc_id", "fp", "first"])

    return run


def _sets(n: int):
    def run(batches):
        for part, raw in text_groups(batches):
            h, counts = shingle_sets(raw, n)
            upto = np.cumsum(counts)
            low = h.astype("<u4")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([low[u - c : u].tobytes() for u, c in zip(upto, counts)], pa.binary())], ["id", "held"])

    return run


def plan_keys(n_docs: int, least: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(bits a key, keys a document): about one other document by chance in a bucket, ``recall`` of pairs at ``least`` meet."""
    bits = min(30, max(12, int(np.ceil(np.log2(max(2, n_docs))))))
    agree = 1 - np.arccos(2 * least / (1 + least)) / np.pi
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - agree**bits)))


def reach(least: float, lanes: int) -> tuple[int, int]:
    """Differing bits of ``lanes`` fingerprints up to which a pair is sure, and up to which it is doubtful."""
    bits, p = BITS * lanes, np.arccos(2 * least / (1 + least)) / np.pi
    mean, spread = bits * p, np.sqrt(bits * p * (1 - p))
    return int(mean + SURE * spread), int(np.ceil(mean + FAR * spread))


def _ring_keys(bits: int, tables: int, lanes: int):
    """Rows ``(key, id, label, fp)`` of rows (id, label, fp); a table's key is ``bits`` bits of all fingerprints."""
    rng = np.random.default_rng(SEED)
    picks = np.stack([rng.permutation(BITS * lanes)[:bits] for _ in range(tables)])
    power = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = np.frombuffer(b"".join(v.as_py() for v in part.column(2)), dtype="<u8").reshape(-1, lanes)
                cells = np.unpackbits(words.view(np.uint8), axis=1).astype(np.int64)
                for t in range(tables):
                    key = cells[:, picks[t]] @ power | np.int64(t) << 40
                    yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], ["key", "id", "label", "fp"])

    return run


def _apart(fps: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ x).sum(axis=-1, dtype=np.int64)


def near_walk(ids: np.ndarray, fps: np.ndarray, sure: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a bucket: a tree over the sure pairs, and each other member with the nearest one walked before it."""
    a, b = [], []
    near, least = np.full(len(ids), -1, dtype=np.int64), np.full(len(ids), far + 1, dtype=np.int64)
    left, queue = np.arange(len(ids)), []
    while len(left):
        if not queue:
            x, left = left[0], left[1:]
            if near[x] >= 0:
                a.append(ids[near[x] : near[x] + 1])
                b.append(ids[x : x + 1])
        else:
            x = queue.pop()
        if not len(left):
            break
        apart = _apart(fps[left], fps[x])
        joined = apart <= sure
        found, left, apart = left[joined], left[~joined], apart[~joined]
        a.append(np.full(len(found), ids[x]))
        b.append(ids[found])
        queue += found.tolist()
        nearer = left[apart < least[left]]
        least[nearer], near[nearer] = apart[apart < least[left]], x
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def other_pairs(ids: np.ndarray, labels: np.ndarray, fps: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a bucket but those of the commonest label with its nearest member of every other label, if within ``far`` bits."""
    _, which, counts = np.unique(labels, return_inverse=True, return_counts=True)
    a, b = [], []
    for i in np.flatnonzero(which != np.argmax(counts)):
        apart = _apart(fps, fps[i])
        other = np.flatnonzero((which != which[i]) & (apart <= far))
        other = other[np.lexsort((apart[other], which[other]))]
        other = other[np.concatenate(([True], which[other][1:] != which[other][:-1]))[: len(other)]]
        a.append(np.full(len(other), ids[i]))
        b.append(ids[other])
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def _meet(lanes: int, sure: int, far: int, again: bool):
    """Sorted rows (key, id, label, fp) -> candidates (a, b) of different labels: of the first round, or the rest."""

    def pairs(key, ids, labels, fps):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        a, b = [], []
        two = first[sizes == 2]
        near = (_apart(fps[two], fps[two + 1]) <= far) & (labels[two] != labels[two + 1])
        a.append(ids[two[near]])
        b.append(ids[two[near] + 1])
        for i, size in zip(first[sizes > 2], sizes[sizes > 2]):
            here = slice(i, i + size)
            if (labels[here] == labels[i]).all():
                continue
            if again:
                x, y = other_pairs(ids[here], labels[here], fps[here], far)
            else:
                x, y = near_walk(np.arange(i, i + size), fps[here], sure, far)
                new = labels[x] != labels[y]
                x, y = ids[x[new]], ids[y[new]]
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(cols[0]):
                continue
            cols.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u8").reshape(-1, lanes))
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last or (held and held[0][0][0] != cols[0][0]):
                held.append([c[:last] for c in cols])
                yield pairs(*(np.concatenate(c) for c in zip(*held)))
                held = []
            held.append([c[last:] for c in cols])
        if held:
            yield pairs(*(np.concatenate(c) for c in zip(*held)))

    return run


def _similar(least: float):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), dtype="<u4") for v in (a, b))
                both = len(np.intersect1d(x, y))
                keep.append(both >= least * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def ring_pairs(reps: DataFrame, t: int = 3) -> DataFrame:
    """``(a, b)``, a < b: pairs of ``(rep, first)`` whose components are those of all fingerprints ``first`` at distance <= t."""
    held = stored(reps.groupBy("first").agg(F.min("rep").alias("least")))
    edges = hamming_edges(held.select(F.col("first").alias("fp")), t)
    ends = [held.select(F.col("first").alias(c), F.col("least").alias(f"of_{c}")) for c in ("a", "b")]
    across = edges.distinct().join(ends[0], "a").join(ends[1], "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    same = reps.join(held, "first").where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    return across.unionByName(same).distinct()


def similar_groups(docs: DataFrame, n: int = SHINGLE, least: float = SIMILAR, recall: float = RECALL, lanes: int = LANES) -> DataFrame:
    """``(doc_id, component_id)``, one row per document: components of pairs whose n-word shingle sets are ``least`` alike."""
    parts = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = stored(texts.mapInArrow(_many_fingerprints(n, lanes), "doc_id long, fp binary, first long"))
    reps = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("first").alias("first")))
    bits, tables = plan_keys(reps.count(), least, recall)
    sure, far = reach(least, lanes)

    def candidates(labelled: DataFrame, again: bool) -> DataFrame:
        rows = labelled.mapInArrow(_ring_keys(bits, tables, lanes), "key long, id long, label long, fp binary")
        ordered = rows.repartition(parts, "key").sortWithinPartitions("key", "id")
        return stored(ordered.mapInArrow(_meet(lanes, sure, far, again), "a long, b long").where("a < b").distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        # a repeated id counts with its first set
        sets = texts.mapInArrow(_sets(n), "id long, held binary").join(asked, F.col("id") == F.col("doc_id"), "left_semi").groupBy("id").agg(F.min("held").alias("held"))
        left, right = (sets.select(F.col("id").alias(c), F.col("held").alias(f"held_{c}")) for c in ("a", "b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "held_a", "held_b").mapInArrow(_similar(least), "a long, b long")

    def labels(groups: DataFrame) -> DataFrame:
        return reps.join(groups, reps.rep == groups.node, "left").select("rep", F.coalesce("component", "rep").alias("label"), "fp")

    links = stored(confirmed(stored(ring_pairs(reps.select("rep", "first")))))
    links = stored(links.unionByName(confirmed(candidates(labels(components(links)), False))))
    groups = components(links)
    rest = candidates(labels(groups), True)
    if rest.limit(1).count():
        groups = components(links.unionByName(confirmed(rest)))
    by_fp = reps.join(groups, reps.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    known = prints.where("doc_id is not null").join(by_fp, "fp").select("doc_id", "component_id")
    return known.unionByName(prints.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id")))


def keep_first(docs: DataFrame, n: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` whose document comes first in its near-duplicate group."""
    groups = similar_groups(docs, n, least)
    kept = groups.where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("__tessera_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__tessera_id"]), "left_semi")
