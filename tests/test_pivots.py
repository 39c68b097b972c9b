"""The pivot search against the exact lookup: same hits, most pairs passed over, hot rings dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cache, pivots, vector


def clustered(seed=1, n=2000, dim=24, clusters=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.25
    x[: n // 3] = centres[0] + rng.normal(size=(n // 3, dim)) * 0.1  # a third of all rows in one place
    return x


@pytest.fixture(scope="module")
def store(spark):
    x = clustered()
    odd = [(90001, None), (90002, [0.0] * 24), (90003, [float("nan")] * 24), (90004, [1.0]), (90005, x[5].tolist()), (90006, [None] * 24)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    ask = [(i, (x[i * 13] * 3).tolist()) for i in range(120)] + [(500 + i, v.tolist()) for i, v in enumerate(clustered(2, 30))] + [(901, None), (902, [0.0] * 24), (903, x[5].tolist()), (903, x[5].tolist())]
    kinds = "long, embedding array<double>"
    return spark.createDataFrame(rows, f"key {kinds}").withColumn("cell", F.lit("x")), spark.createDataFrame(ask, f"query_id {kinds}").withColumn("q", F.lit(1))


def sound(store):
    entries, queries = store
    return entries.where("key < 90000 or key = 90005"), queries


@pytest.mark.parametrize("t, n_pivots, block", [(0.95, 64, 4096), (0.95, 64, 50), (0.8, 200, 100), (0.99, 1, 300), (1.0, 64, 4096)])
def test_equals_the_exact_search(store, t, n_pivots, block):
    shown = lambda df: sorted((r["query_id"], r["key"], r["score"]) for r in df.collect())
    entries, queries = sound(store)
    want = vector.search(entries, queries.distinct(), 1).where(F.col("score") >= t)
    got = pivots.nearest(*store, t, n_pivots, block)
    assert shown(got.distinct()) == shown(want)
    assert got.where("query_id = 903").count() == (2 if t < 1 or want.where("query_id = 903").count() else 0)


def test_share_of_compared_pairs(store):
    entries, queries = store
    pairs = pivots.candidates(entries, queries, 0.95, 128, 100)
    all_pairs = 2000 * 150
    assert pairs.count() < 0.3 * all_pairs
    sizes = pairs.groupBy("query_id", "key").count().agg(F.max("count")).first()[0]
    assert sizes == 1  # a pair meets once


def test_cache_hits_equal_lookup(spark, store):
    entries, queries = sound(store)
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    full = entries.select(F.col("key").alias("id"), "embedding", (t0 + F.make_interval(hours=F.col("key") % 5)).alias("created_at"))
    asked = queries.where("query_id < 900")
    now = t0 + F.make_interval(hours=F.lit(5))
    for skip in (False, True):
        want = {r["query_id"]: (r["cache_id"], r["hit"]) for r in cache.lookup(full, asked, now, 0.95, 2.5 * 3600, skip).collect()}
        rows = cache.lookup_hits(full, asked, now, 0.95, 2.5 * 3600, skip, 64).collect()
        assert {r["query_id"]: (r["cache_id"], r["hit"]) for r in rows} == want and len({h for _, h in want.values()}) == 2
        assert all(r["similarity"] is None or r["similarity"] >= 0.95 for r in rows)


def test_empty(store):
    entries, queries = store
    assert pivots.nearest(entries.limit(0), queries, 0.95).count() == 0
    assert pivots.nearest(entries, queries.limit(0), 0.95).count() == 0
    with pytest.raises(ValueError):
        pivots.nearest(entries, queries, 0.0)


def test_few_queries_are_compared_without_pivots(store, monkeypatch):
    entries, queries = store
    shown = lambda df: sorted((r["query_id"], r["cache_id"], r["similarity"]) for r in df.collect() if r["hit"])
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    full = entries.select(F.col("key").alias("id"), "embedding", t0.alias("created_at"))
    monkeypatch.setattr(vector, "BROADCAST_NUMBERS", 1)
    want = shown(cache.lookup_hits(full, queries, t0, 0.95, 3600, n_pivots=64))
    monkeypatch.setattr(vector, "BROADCAST_NUMBERS", 4_000_000)
    monkeypatch.setattr(pivots, "nearest", None)
    assert shown(cache.lookup_hits(full, queries, t0, 0.95, 3600)) == want and want
