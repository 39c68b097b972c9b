"""Exact vector search; the approximate one is in ``ann``.

It compares a batch of query vectors with all stored vectors. The query side is counted
first: up to ``BROADCAST_NUMBERS`` vector components it goes to every task, where slices of stored vectors are compared with all
queries by matrix products (``scan``) and only a slice's k best rows of a query leave the task. Beyond that queries are dealt into
blocks, and stored vectors into shares of each block, that meet in one equi-join: as many tasks as
blocks times shuffle partitions, and nothing unbounded is ever broadcast. The result keeps k rows per query: the window's group limit prunes before the shuffle.

Vectors that are null, zero, not finite or of another length than the queries are scored by the native expression, as are such queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot, norm
from ..sources import snapshots
from . import scan

#: Components (queries x dimension) that are broadcast: 32 MB of doubles.
BROADCAST_NUMBERS = 4_000_000


def _with_unit(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_norm", norm(F.col(column)))


def similarities(vectors: DataFrame, queries: DataFrame, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """``(query_id, key, score)`` for vectors(key, embedding) and queries(query_id, embedding); zero norms score 0."""
    stored = _with_unit(vectors.select("key", "embedding"), "embedding")
    asked = _with_unit(queries.where("embedding is not null").select("query_id", F.col("embedding").alias("q")), "q").withColumnRenamed("_norm", "_qnorm")
    size = asked.agg(F.coalesce(F.sum(F.size("q")), F.lit(0))).first()[0]
    if size <= broadcast_numbers:
        pairs = stored.crossJoin(F.broadcast(asked))
    else:
        blocks, shares = -(-size // broadcast_numbers), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        dealt = dealt.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        held = stored.withColumn("_share", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int"))
        pairs = held.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks - 1))))).join(dealt, ["_block", "_share"])
    lengths = F.col("_norm") * F.col("_qnorm")
    score = F.when(lengths > 0, dot(F.col("embedding"), F.col("q")) / lengths).otherwise(0.0)
    return pairs.select("query_id", "key", score.alias("score"))


def sound(v: Column) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & (norm(v) > 0) & (norm(v) < float("inf")), F.lit(False))


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -np.inf) -> DataFrame | None:
    """``(query_id, key, score)`` that holds every query's k best rows, of ``least`` or more; None where the queries are too many for each task."""
    asked = queries.where("embedding is not null").select("query_id", "embedding", sound(F.col("embedding")).alias("_sound"))
    size = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    if size > BROADCAST_NUMBERS:
        return None
    width = F.size("embedding")
    common = asked.where("_sound").groupBy(width.alias("w")).count().orderBy(F.desc("count"), "w").first()
    if common is None:
        return similarities(vectors, queries)
    # bounded by BROADCAST_NUMBERS
    rows = asked.where(F.col("_sound") & (width == common["w"])).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()
    stored = vectors.select("key", "embedding")
    fits = sound(F.col("embedding")) & (width == common["w"])
    ids = pa.array([r["query_id"] for r in rows], type=to_arrow_type(asked.schema["query_id"].dataType))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, key {stored.schema['key'].dataType.simpleString()}, score double"
    near = stored.where(fits).mapInArrow(scan.nearest(ids, np.array([r["embedding"] for r in rows], dtype=np.float64), k, least), kinds)
    near = near.unionByName(similarities(stored.where(~fits), queries))
    odd = asked.where(~F.col("_sound") | (width != common["w"]))
    return near.unionByName(similarities(stored.where(fits), odd)) if odd.limit(1).count() else near


def nearest_above(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame | None:
    """``(query_id, key, score)``: the nearest row of each query that has one at ``least`` or more, of sound vectors; None where the queries are too many for each task."""
    usable = lambda rows: rows.where(sound(F.col("embedding")))
    found = _nearest(usable(vectors), usable(queries), 1, least)
    if found is None:
        return None
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    return found.where(F.col("score") >= least).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    scored = _nearest(vectors, queries, k)
    scored = similarities(vectors, queries) if scored is None else scored
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= k)


def save(vectors: DataFrame, path: str) -> None:
    """The stored vectors as a snapshot; ``load`` reads them back, nothing is embedded again."""
    snapshots.commit(vectors.sparkSession, path, replace={"vectors": vectors})


def load(spark, path: str, version: int | None = None) -> DataFrame:
    return snapshots.open_snapshot(spark, path, version).read("vectors")
