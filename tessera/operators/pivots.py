"""Nearest stored vector at a cosine of ``t`` or more, exactly, by pivots on the unit sphere.

Angles are a metric. Some stored vectors are pivots; every entry belongs to the cell of its nearest pivot and, by its angle to
it, to a ring as wide as the threshold's angle. An entry within angle ``w`` of a query lies

- in a ring that the query's own angle to that pivot reaches within ``w``, and
- in a cell whose pivot is at most ``2 w`` farther from the query than the query's nearest pivot,

so all other cells and rings are passed over. What remains meets in an equi-join on cell, ring and block: a ring with over
``BLOCK`` entries or probes is dealt into blocks of that size by hash, so no key grows with the data. Angles are padded by
``SLACK`` against rounding, and the join compares by the same expression as the exact search, so results equal it to the bit.

Equal vectors are collapsed first, to the smallest key. Pivots are the vectors with the smallest hashes: ``n_pivots`` times the
dimension numbers on the driver and in each task, whatever the table holds. Vectors that are null, zero, of another
length than the pivots or hold null or non-finite components match nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..sources.shared import as_parquet

BLOCK, SLACK = 4096, 1e-6


def _usable(rows: DataFrame, key: str) -> DataFrame:
    """``(key, embedding, length)`` of distinct vectors."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.select(F.col(key).alias("key"), "embedding").where(F.col("embedding").isNotNull() & sound)
    kept = kept.groupBy("embedding").agg(F.min("key").alias("key")).withColumn("length", norm(F.col("embedding")))
    return kept.where((F.col("length") > 0) & (F.col("length") < float("inf"))).select("key", "embedding", "length")


def choose_pivots(entries: DataFrame, n_pivots: int) -> np.ndarray:
    rows = entries.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(n_pivots).collect()
    size = max((len(r["embedding"]) for r in rows), default=0)
    return np.array([r["embedding"] for r in rows if len(r["embedding"]) == size], dtype=np.float64).reshape(-1, max(size, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(pivots: np.ndarray, width: float, probing: bool):
    """Batches (key, embedding, length) with cell and ring: one row an entry, one row a probe."""
    units = _unit(pivots)
    last = int(math.pi / width)

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                angle = np.arccos(np.clip(_unit(x) @ units.T, -1, 1))
                if probing:
                    low = np.clip(np.floor((angle - width - 2 * SLACK) / width), 0, last).astype(np.int64)
                    high = np.clip(np.floor((angle + width + 2 * SLACK) / width), 0, last).astype(np.int64)
                    near = angle <= angle.min(axis=1, keepdims=True) + 2 * width + 4 * SLACK
                    row, cell = np.nonzero(near)
                    n = (high - low + 1)[row, cell]
                    ring = np.repeat(low[row, cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, cell = np.repeat(row, n), np.repeat(cell, n)
                else:
                    row, cell = np.arange(len(x)), angle.argmin(axis=1)
                    ring = np.minimum(np.floor(angle[row, cell] / width), last)
                for i in range(0, len(row), 1024):
                    some = slice(i, i + 1024)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[some])) for c in batch.columns), pa.array(cell[some].astype(np.int32)), pa.array(ring[some].astype(np.int32))], ["key", "embedding", "length", "cell", "ring"])

    return run


def _blocks(rows: DataFrame, name: str, block: int) -> DataFrame:
    return rows.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias(name))


def candidates(entries: DataFrame, queries: DataFrame, t: float, n_pivots: int = 256, block: int = BLOCK) -> DataFrame:
    """``(query_id, q, q_length, key, embedding, length)``: every pair of distinct vectors that may reach cosine ``t``."""
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    stored, asked = as_parquet(_usable(entries, "key")), _usable(queries, "query_id")
    pivots = choose_pivots(stored, n_pivots)
    if not len(pivots):
        pivots = np.ones((1, 1))
    width = max(math.acos(t), 1e-3) + SLACK

    def placed(rows: DataFrame, probing: bool) -> DataFrame:
        fits = rows.where(F.size("embedding") == pivots.shape[1])
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fits.schema)
        return as_parquet(fits.mapInArrow(_placed(pivots, width, probing), f"{kinds}, cell int, ring int"))

    held = placed(stored, False)
    probes = placed(asked, True)
    # one row a ring: at most pivots times pi over the width
    dealt = _blocks(held, "parts", block).join(F.broadcast(_blocks(probes, "shares", block)), ["cell", "ring"])
    part, share = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("key"), F.col("shares")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.join(F.broadcast(dealt), ["cell", "ring"]).withColumn("part", part).withColumn("share", upto("shares"))
    right = probes.join(F.broadcast(dealt), ["cell", "ring"]).withColumn("share", share).withColumn("part", upto("parts"))
    right = right.select("cell", "ring", "part", "share", F.col("key").alias("query_id"), F.col("embedding").alias("q"), F.col("length").alias("q_length"))
    return left.join(right, ["cell", "ring", "part", "share"]).select("query_id", "q", "q_length", "key", "embedding", "length")


def nearest(entries: DataFrame, queries: DataFrame, t: float, n_pivots: int = 256, block: int = BLOCK) -> DataFrame:
    """``(query_id, key, score)``: for entries(key, embedding) and queries(query_id, embedding) the nearest entry of each query
    that has one at cosine ``t`` or more; ties at nine places fall to the smaller key."""
    score = dot(F.col("embedding"), F.col("q")) / (F.col("length") * F.col("q_length"))
    pairs = candidates(entries, queries, t, n_pivots, block).select("q", "key", score.alias("score")).where(F.col("score") >= t)
    best = pairs.groupBy("q").agg(F.min(F.struct((-F.round("score", 9)).alias("order"), "key", "score")).alias("b"))
    return queries.select("query_id", F.col("embedding").alias("q")).join(best, "q").select("query_id", F.col("b.key").alias("key"), F.col("b.score").alias("score"))
