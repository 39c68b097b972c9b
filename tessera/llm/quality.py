"""Operator 7: quality classifier with hierarchical empirical Bayes over sites.

*Document evidence.* Two logistic heads, low quality and toxic, on text-shape features and on the
presence of the words that separate the labels best. They are fitted on at most ``SAMPLE`` labelled
ids (those with the smallest hash of the id), the only bounded part; a broadcast of that many ids
picks the rows, word counts come from a grouped aggregate over hashed words. The feature rows of the
sample, some 100 bytes each, are fitted in one executor task; only the weights reach the driver.

*Site evidence.* All documents' probabilities are summed by path (here source and language) and host
(source). The hosts' spread gives a Beta prior by moments; a host's rate is shrunk toward the global
rate by it, a path's rate toward its host's rate by the spread of paths inside hosts. A site with few
documents stays near its parent. A document's log odds are moved by the difference between its path's
and the global log odds, which is Bayes' rule for a classifier fitted at the global rate.

A document is rejected if either posterior exceeds one half.

Defined results: a null or empty text has neutral features; null sources and languages are sites of
their own; without labelled rows of both classes a head gives probability 0; a repeated row gets
the same result each time; an id trains once: with its lowest quality, its highest toxicity and, of
several texts, the one with the smallest hash; an empty table gives no rows. Only ``doc_id``, ``text``, ``source`` and ``lang`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import BLOCK, LOWER, SPACE, Words, mixed, text_groups

SAMPLE, N_WORDS, BUCKETS = 20_000, 256, 1 << 20
HEADS = ("low", "toxic")
SEED = 7
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other ASCII, 1 upper, 2 lower, 3 digit, 4 space, 5 beyond ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[SPACE] = 4
N_SHAPE = 16


def _kinds(text: bytes) -> np.ndarray:
    """Bytes of each class, counted a block at a time."""
    out = np.zeros(6, dtype=np.int64)
    for at in range(0, len(text), BLOCK):
        out += np.bincount(_CLASS[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)], minlength=6)
    return out


def shape(raw: list[bytes], w: Words) -> np.ndarray:
    """Features of how a text looks, one row per text; all finite, neutral for empty texts."""
    n = len(raw)
    size = np.array([len(t) for t in raw], dtype=np.int64)
    total = np.maximum(size, 1)
    share = np.stack([_kinds(t) for t in raw]) / total[:, None]
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    mean = np.bincount(w.text, w.hi - w.lo, n) / some

    def distinct(keys):
        owner = w.text[: len(keys)]
        by = np.lexsort((keys, owner))
        new = np.concatenate(([True], (keys[by[1:]] != keys[by[:-1]]) | (owner[by[1:]] != owner[by[:-1]])))[: len(keys)]
        first = np.flatnonzero(new)
        text, count = owner[by][first], np.diff(np.append(first, len(keys)))
        most = np.zeros(n)
        np.maximum.at(most, text, count)
        return np.bincount(text, minlength=n) / some, most / some

    types, top = distinct(w.hash)
    pair = mixed(w.hash[:-1]) + w.hash[1:] if len(w.hash) > 1 else w.hash[:0]
    pairs, top_pair = distinct(pair)
    b, begin = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size) - size
    at = begin[w.text]
    mark = _CLASS[b[at + w.hi - 1]] == 0
    second = _CLASS[b[at + np.maximum(w.hi - 2, w.lo)]] == 0
    marked = np.bincount(w.text, mark, n) / some
    twice = np.bincount(w.text, mark & second & (w.hi - w.lo > 1), n) / some
    alone = np.bincount(w.text, mark & (w.hi - w.lo == 1), n) / some
    lines = np.array([t.count(b"\n") for t in raw]) / total
    out = np.column_stack((share, np.log1p(words), np.log1p(mean), types, top, pairs, top_pair, marked, twice, alone, lines))
    out[words == 0] = 0
    return out


def word_buckets(w: Words) -> np.ndarray:
    """Bucket of each word without its ASCII marks at the ends: hashes of the word are enough for words of letters."""
    return (mixed(w.hash) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _letters(raw: list[bytes]) -> Words:
    """Words of letters, digits and bytes beyond ASCII: marks count as white space."""
    table = LOWER.copy()
    table[_CLASS == 0] = 32
    return Words([t.translate(table.tobytes()) for t in raw])


def features(raw: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape rows, and the present chosen words as (text, index in ``chosen``), each once."""
    x = shape(raw, Words(raw))
    if not len(chosen):
        return x, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    w = _letters(raw)
    at = np.searchsorted(chosen, b := word_buckets(w))
    hit = chosen[np.minimum(at, len(chosen) - 1)] == b
    both = np.unique(w.text[hit] * len(chosen) + at[hit])
    return x, both // len(chosen), both % len(chosen)


def _presence(batches):
    """(text, low, toxic) rows -> distinct word buckets with counts of documents by label."""
    for part, raw in text_groups(batches):
        w = _letters(raw)
        both = np.unique(w.text * BUCKETS + word_buckets(w))
        text, bucket = both // BUCKETS, both % BUCKETS
        low, toxic = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[text] for i in (2, 3))
        keys, where = np.unique(bucket, return_inverse=True)
        cols = [np.bincount(where, v, len(keys)).astype(np.int64) for v in (np.ones(len(where)), low, toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys, *cols)], ["bucket", "n", "low", "toxic"])


def _feature_rows(chosen: np.ndarray):
    """Rows (doc_id, text, low, toxic) -> one blob each: the labels, the shape as float32, the words' indices as uint16."""

    def run(batches):
        for part, raw in text_groups(batches):
            x, text, word = features(raw, chosen)
            upto = np.searchsorted(text, np.arange(len(raw) + 1))
            low, toxic = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            blobs = [bytes([low[i], toxic[i]]) + x[i].astype("<f4").tobytes() + word[upto[i] : upto[i + 1]].astype("<u2").tobytes() for i in range(len(raw))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["doc_id", "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the intercept; Newton steps with a ridge. Without both classes: probability 0."""
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), -20.0)
    width = x.shape[1] + 1
    keep = np.full(width, ridge)
    keep[-1] = 1e-6
    beta = np.zeros(width)
    for _ in range(rounds):
        # block sums: no second copy of the matrix
        gram, slope = np.diag(keep), -keep * beta
        for at in range(0, len(x), 1000):
            z = np.column_stack((x[at : at + 1000], np.ones(len(x[at : at + 1000])))).astype(float)
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            gram = gram + (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
            slope = slope + z.T @ (y[at : at + 1000] - p)
        step = np.linalg.solve(gram, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _fit(n_words: int):
    """All rows of the sample, in order of id -> one row: means, scales and both heads' weights."""

    def run(batches):
        blobs = [v.as_py() for batch in batches for v in batch.column(1)]
        width = N_SHAPE + n_words
        x, y = np.zeros((len(blobs), width), dtype=np.float32), np.zeros((len(blobs), len(HEADS)))
        for i, blob in enumerate(blobs):
            y[i] = blob[0], blob[1]
            x[i, :N_SHAPE] = np.frombuffer(blob, "<f4", N_SHAPE, 2)
            x[i, N_SHAPE + np.frombuffer(blob, "<u2", offset=2 + 4 * N_SHAPE).astype(np.intp)] = 1
        blobs.clear()
        mean = x.mean(axis=0, dtype=float) if len(x) else np.zeros(width)
        scale = np.maximum(np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=float) / max(1, len(x)) - mean**2, 0)), 1e-3)
        x -= mean.astype(np.float32)
        x /= scale.astype(np.float32)
        out = np.concatenate([mean, scale, *(fit_logistic(x, y[:, k]) for k in range(len(HEADS)))])
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["weights"])

    return run


class Model:
    def __init__(self, chosen: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.chosen = chosen
        self.slopes = weights[:, :-1] / scale
        self.start = weights[:, -1] - self.slopes @ mean

    def logits(self, raw: list[bytes]) -> np.ndarray:
        x, text, word = features(raw, self.chosen)
        out = x @ self.slopes[:, :N_SHAPE].T + self.start
        for k in range(len(HEADS)):
            out[:, k] += np.bincount(text, self.slopes[k, N_SHAPE + word], len(raw))
        return np.clip(out, -20, 20)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, low, toxic)``: one row for each of at most ``sample`` labelled ids."""
    rows = labels.select(F.col("doc_id").cast("long"), (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic")).na.drop()
    by_id = rows.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    # bounded by ``sample``: the ids of the training rows
    ids = by_id.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    text = F.col("text").cast("string").cast("binary")
    found = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("low").alias("low"), F.first("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit both heads on at most ``sample`` labelled ids."""
    picked = cut(training_rows(docs, labels, sample))
    totals = picked.agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    counts = cut(picked.mapInArrow(_presence, "bucket long, n long, low long, toxic long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic"))))
    chosen = []
    for head in HEADS:
        if not totals["n"] or not totals[head] or totals[head] == totals["n"]:
            continue
        with_, without = F.col(head) / totals[head], (F.col("n") - F.col(head)) / (totals["n"] - totals[head])
        # difference of the square roots: rewards words that are frequent in one class only
        gain = F.abs(F.sqrt(with_) - F.sqrt(without))
        chosen += [r["bucket"] for r in counts.orderBy(F.desc(gain), "bucket").limit(N_WORDS // len(HEADS)).select("bucket").collect()]
    chosen = np.unique(np.array(chosen, dtype=np.int64))
    # bounded by ``sample``: the feature rows meet in one task
    rows = picked.mapInArrow(_feature_rows(chosen), "doc_id long, x binary").repartition(1).sortWithinPartitions("doc_id")
    made = rows.mapInArrow(_fit(len(chosen)), "weights array<double>").first()
    width = N_SHAPE + len(chosen)
    if made is None:  # the plan of an empty sample has no task
        return Model(chosen, np.zeros(width), np.ones(width), np.stack([fit_logistic(np.zeros((0, width)), np.zeros(0))] * len(HEADS)))
    got = np.array(made["weights"])
    return Model(chosen, got[:width], got[width : 2 * width], got[2 * width :].reshape(len(HEADS), width + 1))


def _logits(model: Model):
    def run(batches):
        for part, raw in text_groups(batches):
            z = model.logits(raw)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array(z[:, 0]), pa.array(z[:, 1])], ["doc_id", "host", "path", "low", "toxic"]
            )

    return run


def _shrunk(prior, strength, total, n):
    return (prior * strength + total) / (strength + n)


def _strength(rate: str, between: str):
    """Prior weight in documents, from a mean rate m and the spread v of rates: m(1-m)/v - 1, within [1, 1e6]."""
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col(rate) * (1 - F.col(rate)) / F.greatest(F.col(between), F.lit(1e-9)) - 1))


def site_posteriors(scored: DataFrame, head: str) -> DataFrame:
    """``(host, path, site_<head>, global_<head>)``: shrunk rates of each path."""
    p = 1 / (1 + F.exp(-F.col(head)))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.coalesce(F.var_pop(F.col("s") / F.col("n")), F.lit(0.0)).alias("inner")
    )
    world = hosts.agg(
        (F.sum("hs") / F.sum("hn")).alias("g"), F.coalesce(F.var_pop(F.col("hs") / F.col("hn")), F.lit(0.0)).alias("outer"), F.avg("inner").alias("within")
    )
    # one row
    at_host = hosts.crossJoin(F.broadcast(world)).withColumn("h", _shrunk(F.col("g"), _strength("g", "outer"), F.col("hs"), F.col("hn")))
    joined = paths.join(at_host.select(F.col("host").alias("_h"), "g", "h", "within"), F.col("host").eqNullSafe(F.col("_h")))
    return joined.select("host", "path", _shrunk(F.col("h"), _strength("h", "within"), F.col("s"), F.col("n")).alias(f"site_{head}"), F.col("g").alias(f"global_{head}"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, host, path, p_low, p_toxic, site_low, site_toxic, keep)``, one row per document."""
    model = train(docs, labels, sample)
    scored = cut(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
        .mapInArrow(_logits(model), "doc_id long, host string, path string, low double, toxic double")
    )
    out = scored
    for head in HEADS:
        site = site_posteriors(scored, head).select(F.col("host").alias("_h"), F.col("path").alias("_p"), f"site_{head}", f"global_{head}")
        out = out.join(site, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left").drop("_h", "_p")
        odds = lambda c: F.log(F.col(c)) - F.log1p(-F.col(c))
        moved = F.col(head) + odds(f"site_{head}") - odds(f"global_{head}")
        out = out.withColumn(f"p_{head}", 1 / (1 + F.exp(-moved)))
    keep = (F.coalesce("p_low", F.lit(0.0)) <= 0.5) & (F.coalesce("p_toxic", F.lit(0.0)) <= 0.5)
    return out.select("doc_id", "host", "path", *(F.round(c, 6).alias(c) for c in ("p_low", "p_toxic", "site_low", "site_toxic")), keep.alias("keep"))


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    kept = classify(docs, labels, **options).where("keep").select(F.col("doc_id").alias("__tessera_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__tessera_id"]), "left_semi")
