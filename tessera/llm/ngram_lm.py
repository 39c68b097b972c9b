"""Operator 10: stupid-backoff scores from n-gram count tables partitioned by hash.

The relation is: explode every document into its words and word pairs, count both over the whole
corpus, join the counts back to each document's n-grams, sum the logs per document. Counts leave out
the scored document itself (its own occurrences are subtracted), so that a pair which only this
document holds backs off:

    S(w | v) = c(v w) / c(v)            if c(v w) > 0
             = alpha * c(w) / N         else if c(w) > 0
             = alpha * alpha / N        otherwise;   a first word starts at its unigram

with c and N without the document. As rows that join does not fit its disk budget (a row for each of
about 130 million distinct (document, pair) costs some 16 bytes compressed, 2.1 GB on 0.5 GB of
input, against 4 times the input), so relations travel packed: a group of documents asks each hash
partition once for its distinct n-grams (sorted 64-bit hashes, stored as differences, with counts);
the partition adds all groups' counts and answers each in its order; a document's group joins
its answers by the group's content hash. A frequent n-gram is one entry per group, never a row per
occurrence. The groups are checkpointed once, compressed: asking and scoring see the same groups, also
after a retry.

Defined results: a null or empty text has 0 words, log_score 0 and a null mean; a null id is scored
like any other row; repeated rows are documents of their own, each with the others as corpus; only
``doc_id`` and ``text`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .words import MIX, Words, mixed, text_groups

ALPHA = 0.4
GROUP_BYTES = 4 << 20


def ngram_keys(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of each (word before, word) pair (0 at a text's first word), and which are first."""
    first = np.concatenate(([True], w.text[1:] != w.text[:-1]))[: len(w.hash)]
    uni = mixed(w.hash + MIX[1])
    pair = np.zeros_like(uni)
    if len(uni) > 1:
        pair[1:] = mixed(mixed(w.hash[:-1] + MIX[2]) + w.hash[1:] + MIX[0])
    pair[first] = 0
    return uni, pair, first


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of as few bytes as the largest needs, then counts."""
    if not len(keys):
        return b""
    diff = np.diff(keys)
    width = max(1, (int(diff.max()).bit_length() + 7) // 8) if len(diff) else 1
    raw = diff.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(keys).to_bytes(4, "little") + bytes([width]) + keys[:1].astype("<u8").tobytes() + raw + counts.astype("<u4").tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    at = 13 + (n - 1) * width
    full = np.zeros((n, 8), dtype=np.uint8)
    full[0] = np.frombuffer(blob, np.uint8, 8, 5)
    full[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, 13).reshape(width, n - 1).T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(blob, "<u4", n, at).astype(np.int64)


def _groups(batches):
    """(content hash, ids, texts) of groups of rows."""
    for part, raw in text_groups(batches, GROUP_BYTES):
        ids = part.column(0)
        h = xxhash.xxh64(repr(ids.to_pylist()).encode())
        for t in raw:
            h.update(len(t).to_bytes(8, "little"))
            h.update(t)
        yield np.uint64(h.intdigest()).astype(np.int64), ids, raw


def _opened(blob: bytes, n: int) -> list[bytes]:
    """The ``n`` texts of a packed group."""
    sizes = np.frombuffer(blob, "<u4", n).astype(np.int64)
    joined = zstandard.ZstdDecompressor().decompress(blob[4 * n :], max_output_size=max(1, int(sizes.sum())))
    ends = np.cumsum(sizes)
    return [joined[z - k : z] for z, k in zip(ends.tolist(), sizes.tolist())]


def _ask(parts: int):
    def run(batches):
        for chunk, blob, ids in ((c.as_py(), b.as_py(), i.as_py()) for batch in batches for c, b, i in zip(batch.column(0), batch.column(2), batch.column(3))):
            raw = _opened(blob, len(ids))
            uni, pair, first = ngram_keys(Words(raw))
            keys, counts = np.unique(np.concatenate((uni, pair[~first])), return_counts=True)
            shard = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            bounds = np.searchsorted(shard, np.arange(parts + 1))
            blobs = [pack(keys[a:b], counts[a:b]) for a, b in zip(bounds, bounds[1:])]
            some = [p for p in range(parts) if blobs[p]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([blobs[p] for p in some], pa.binary())], ["chunk", "part", "blob"]
            )

    return run


def _answer(batches):
    """All requests of one partition -> totals, in each request's order."""
    chunks, part, blobs = [], [], []
    for batch in batches:
        chunks += batch.column(0).to_pylist()
        part += batch.column(1).to_pylist()
        blobs += batch.column(2).to_pylist()
    if not blobs:
        return
    keys, counts = zip(*(unpack(b) for b in blobs))
    sizes = [len(k) for k in keys]
    table, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(where, np.concatenate(counts), len(table)).astype(np.int64)[where]
    upto = np.cumsum(sizes)
    del keys, counts, table, where
    wide = "<u4" if totals.max() < 1 << 32 else "<u8"
    for i, (c, p, z, n) in enumerate(zip(chunks, part, upto, sizes)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], pa.int64()), pa.array([p], pa.int32()), pa.array([wide[2:].encode() + totals[z - n : z].astype(wide).tobytes()], pa.binary()), pa.array([None], pa.list_(pa.int64()))],
            ["chunk", "part", "blob", "ids"],
        )


def _state(batches):
    """Texts of a group, compressed, as part -1."""
    for chunk, ids, raw in _groups(batches):
        packed = zstandard.ZstdCompressor(level=1).compress(b"".join(raw))
        head = np.array([len(t) for t in raw], dtype="<u4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([head + packed], pa.binary()), pa.array([ids.to_pylist()], pa.list_(pa.int64()))],
            ["chunk", "part", "blob", "ids"],
        )


def score_group(raw: list[bytes], totals_of, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, the sum of logs without the terms in N, and how many terms divide by N."""
    w = Words(raw)
    uni, pair, first = ngram_keys(w)
    keys = np.unique(np.concatenate((uni, pair[~first])))
    totals = totals_of(keys)
    n = np.diff(w.first)
    if not len(uni):
        return n, np.zeros(len(raw)), np.zeros(len(raw), dtype=np.int64)

    c1 = _own(uni, w.text, keys, totals)
    c2 = np.zeros_like(c1)
    c2[~first] = _own(pair[~first], w.text[~first], keys, totals)
    before = np.concatenate(([0], c1[:-1]))
    seen, known = c2 > 0, c1 > 0
    value = np.where(first, np.where(known, c1, alpha), np.where(known, alpha * c1, alpha * alpha))
    logs = np.where(seen, np.log(np.maximum(c2, 1)) - np.log(np.maximum(before, 1)), np.log(np.maximum(value, 1e-300)))
    return n, np.bincount(w.text, logs, len(raw)), np.bincount(w.text, ~seen, len(raw)).astype(np.int64)


def _own(key, text, keys, totals):
    at = np.searchsorted(keys, key)
    _, where, own = np.unique(text * len(keys) + at, return_inverse=True, return_counts=True)
    return totals[at] - own[where]


def _score(alpha: float):
    def close(states, answers):
        blobs = [answers[p] for p in sorted(answers)]
        totals = np.concatenate([np.frombuffer(b, "<u" + b[:1].decode(), offset=1).astype(np.int64) for b in blobs]) if blobs else np.zeros(0, dtype=np.int64)

        def totals_of(keys):
            if len(keys) != len(totals):
                raise RuntimeError("a group of documents lacks answers")
            return totals

        for blob, ids in states:
            raw = _opened(blob, len(ids))
            n, logs, k = score_group(raw, totals_of, alpha)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(logs), pa.array(k)], ["doc_id", "n_words", "logs", "n_backed"])

    def run(batches):
        chunk, states, answers = None, [], {}
        for batch in batches:
            for c, p, blob, ids in zip(*(batch.column(i) for i in range(4))):
                if (c := c.as_py()) != chunk:
                    yield from close(states, answers)
                    chunk, states, answers = c, [], {}
                if p.as_py() < 0:
                    states.append((blob.as_py(), ids.as_py()))
                else:
                    answers[p.as_py()] = blob.as_py()
        yield from close(states, answers)

    return run


_PACKED = "chunk long, part int, blob binary"


def score(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log_score)``, scores rounded to 6 places."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    groups = cut(rows.mapInArrow(_state, _PACKED + ", ids array<long>"))
    answers = groups.mapInArrow(_ask(n), _PACKED).repartitionById(n, F.col("part")).mapInArrow(_answer, _PACKED + ", ids array<long>")
    scored = cut(
        groups.unionByName(answers).repartition(n, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(
            _score(alpha), "doc_id long, n_words long, logs double, n_backed long"
        )
    )
    total = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("total"))
    log_score = F.col("logs") - F.col("n_backed") * F.log(F.greatest(F.col("total") - F.col("n_words"), F.lit(1)).cast("double"))
    # one row: the corpus size
    return scored.crossJoin(F.broadcast(total)).select(
        "doc_id",
        "n_words",
        F.round(log_score, 6).alias("log_score"),
        F.round(F.when(F.col("n_words") > 0, log_score / F.col("n_words")), 6).alias("mean_log_score"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
with docs as (select doc_id, row_number() over (order by doc_id) as rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
       from documents),
 tok as (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from docs),
 big as (select a.rid, a.i, a.w, b.w as v from tok a left join tok b on a.rid = b.rid and b.i = a.i - 1),
 c1 as (select w, count(*) as c from tok group by w),
 o1 as (select rid, w, count(*) as c from tok group by rid, w),
 c2 as (select v, w, count(*) as c from big where v is not null group by v, w),
 o2 as (select rid, v, w, count(*) as c from big where v is not null group by rid, v, w),
 n as (select count(*) as n from tok),
 m as (select rid, len(ws) as n from docs),
 x as (select b.rid, b.v, greatest(n.n - m.n, 1)::double as nn,
         (c1.c - o1.c)::double as cw, (cv.c - ov.c)::double as cv, (c2.c - o2.c)::double as cc
       from big b join c1 on c1.w = b.w join o1 on o1.rid = b.rid and o1.w = b.w join m on m.rid = b.rid cross join n
       left join c1 cv on cv.w = b.v left join o1 ov on ov.rid = b.rid and ov.w = b.v
       left join c2 on c2.v = b.v and c2.w = b.w left join o2 on o2.rid = b.rid and o2.v = b.v and o2.w = b.w),
 s as (select rid, sum(case when v is null then ln(case when cw > 0 then cw else {ALPHA} end) - ln(nn)
         when cc > 0 then ln(cc) - ln(greatest(cv, 1))
         when cw > 0 then ln({ALPHA} * cw) - ln(nn) else ln({ALPHA} * {ALPHA}) - ln(nn) end) as t from x group by rid)
select d.doc_id, len(d.ws)::bigint as n_words, round(coalesce(s.t, 0), 6) as log_score,
  round(case when len(d.ws) > 0 then s.t / len(d.ws) end, 6) as mean_log_score
from docs d left join s on s.rid = d.rid
"""
