"""Semantic response cache as a table ``(id, query, response, embedding, created_at, last_used_at)``.

A lookup takes the nearest entry and tests only that one: similarity at the threshold or above, not
expired at ``as_of`` (always a parameter). With ``skip_expired`` expired entries are left out before
the nearest is taken. ``lookup`` compares every query with every entry; ``lookup_hits`` keeps only what
reaches the threshold, passes over entries that cannot where queries are many (``pivots``) and gives the same hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..sources import snapshots
from . import pivots, vector


def expired(created_at: Column, as_of: Column, ttl_seconds: float) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(created_at)) > int(ttl_seconds * 1_000_000)


def lookup(cache: DataFrame, queries: DataFrame, as_of: Column, threshold: float = DEFAULTS.CACHE_SIMILARITY_THRESHOLD, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS, skip_expired: bool = False) -> DataFrame:
    """``(query_id, cache_id, similarity, hit)``, one row per query."""
    entries = cache.where(~expired(F.col("created_at"), as_of, ttl_seconds)) if skip_expired else cache
    nearest = vector.search(entries.select(F.col("id").alias("key"), "embedding"), queries, 1).select("query_id", F.col("key").alias("id"), "score")
    return _judged(cache, queries, nearest, as_of, threshold, ttl_seconds)


def lookup_hits(cache: DataFrame, queries: DataFrame, as_of: Column, threshold: float = DEFAULTS.CACHE_SIMILARITY_THRESHOLD, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS, skip_expired: bool = False, n_pivots: int = 256) -> DataFrame:
    """As ``lookup``, but the similarity is null where no entry reaches the threshold.

    Distinct query vectors that fit each task are compared with all entries by matrix products; more of them go by pivots.
    """
    entries = cache.where(~expired(F.col("created_at"), as_of, ttl_seconds)) if skip_expired else cache
    entries = entries.select(F.col("id").alias("key"), "embedding")
    asked = queries.where("embedding is not null").groupBy("embedding").agg(F.min("query_id").alias("query_id"))
    near = vector.nearest_above(entries, asked, threshold)
    if near is None:
        near = pivots.nearest(entries, queries, threshold, n_pivots)
    else:
        of = queries.select(F.col("query_id").alias("_each"), "embedding").join(asked, "embedding")
        near = near.join(of, "query_id").select(F.col("_each").alias("query_id"), "key", "score")
    return _judged(cache, queries, near.select("query_id", F.col("key").alias("id"), "score"), as_of, threshold, ttl_seconds)


def _judged(cache: DataFrame, queries: DataFrame, nearest: DataFrame, as_of: Column, threshold: float, ttl_seconds: float) -> DataFrame:
    found = nearest.join(cache.select("id", "created_at"), "id")
    ok = (F.col("score") >= threshold) & ~expired(F.col("created_at"), as_of, ttl_seconds)
    rows = found.select("query_id", F.when(ok, F.col("id")).alias("cache_id"), F.col("score").alias("similarity"), ok.alias("hit"))
    return queries.select("query_id").join(rows, "query_id", "left").select("query_id", "cache_id", "similarity", F.coalesce("hit", F.lit(False)).alias("hit"))


def evict(cache: DataFrame, as_of: Column, max_size: int = DEFAULTS.CACHE_MAX_SIZE, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS) -> DataFrame:
    """Live entries, at most ``max_size``: the most recently used stay; ties fall to the larger id."""
    live = cache.where(~expired(F.col("created_at"), as_of, ttl_seconds))
    return live.orderBy(F.desc("last_used_at"), F.desc("id")).limit(max_size)


def touch(cache: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """Entries that were hit become the most recently used."""
    used = hits.where("hit").select(F.col("cache_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return cache.join(used, "id", "left").withColumn("last_used_at", F.when(F.col("_used"), as_of).otherwise(F.col("last_used_at"))).drop("_used")


def put(cache: DataFrame, entries: DataFrame, as_of: Column, max_size: int = DEFAULTS.CACHE_MAX_SIZE, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS) -> DataFrame:
    """New entries (id, query, response, embedding) replace equal ids; then the cache is cut to size."""
    fresh = entries.withColumn("created_at", as_of).withColumn("last_used_at", as_of)
    return evict(cache.join(entries.select("id"), "id", "left_anti").unionByName(fresh), as_of, max_size, ttl_seconds)


def clear(cache: DataFrame) -> DataFrame:
    """The cache without its entries."""
    return cache.limit(0)


def save(cache: DataFrame, path: str) -> None:
    """A new version; the saved one may be what the cache was loaded from."""
    snapshots.commit(cache.sparkSession, path, replace={"cache": cache})


def load(spark, path: str, as_of: Column, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS) -> DataFrame:
    """A saved cache without the entries that have expired since."""
    return snapshots.open_snapshot(spark, path).read("cache").where(~expired(F.col("created_at"), as_of, ttl_seconds))


def stats(cache: DataFrame, as_of: Column, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS, max_size: int = DEFAULTS.CACHE_MAX_SIZE) -> DataFrame:
    return cache.agg(F.count("*").alias("size"), F.count_if(expired(F.col("created_at"), as_of, ttl_seconds)).alias("expired")).withColumn("max_size", F.lit(max_size).cast("long"))


def query_embedding_cache(queries: DataFrame, text: str = "query") -> DataFrame:
    """One row per distinct normalised query: embed these once; hit rate = 1 - distinct / total."""
    from ..functions.text import query_hash

    return queries.withColumn("query_hash", query_hash(F.col(text))).groupBy("query_hash").agg(F.count("*").alias("n"), F.min(text).alias(text))


def replay_lru(events: DataFrame, max_size: int) -> DataFrame:
    """events(id, at) of one cache -> ids that remain after all uses: the latest distinct ``max_size``."""
    last = events.groupBy("id").agg(F.max("at").alias("last_used_at"))
    order = Window.orderBy(F.desc("last_used_at"), F.desc("id"))
    return last.orderBy(F.desc("last_used_at"), F.desc("id")).limit(max_size).withColumn("position", F.row_number().over(order).cast("long"))
