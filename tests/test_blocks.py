"""The stored block index against the plain one: same answers, blocks skipped, folders pruned, parts appended."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, lexical


def corpus(spark, n=3000, seed=5, first=0):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(400)]
    rows = [(first + i, " ".join(w for w in common if rng.random() < 0.6) + " " + " ".join(rng.choices(rare, k=rng.choice([0, 3, 10, 80])))) for i in range(n)]
    return spark.createDataFrame(rows + [(first + n, ""), (first + n + 1, None)], "key long, content string").repartition(3)


QUERIES = [(0, "r7 c1 c2 c3 c4"), (1, "c1 c5"), (2, "r1 r2 r3 r4 c9"), (3, "unknown"), (4, ""), (5, None), (6, "c0 c1 c2 c3 c4 c5 c6 c7 r300")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "i")
    blocks.build(corpus(spark), "key", block=32, buckets=16).save(path)
    return path


def same(got, want):
    shown = lambda df: sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 7)) for r in df.collect())
    assert shown(got) == shown(want) and shown(want)


@pytest.mark.parametrize("k, lead, direct", [(5, 4096, 0), (1, 1, 0), (40, 64, 0), (100_000, 64, 0), (5, 1, blocks.DIRECT)])
def test_same_answers_as_the_plain_index(spark, stored, asked, k, lead, direct):
    same(blocks.search(blocks.load(spark, stored), asked, k, lead=lead, direct=direct), lexical.search(lexical.build_index(corpus(spark), "key"), asked, k))


def test_share_of_postings_that_is_skipped(spark, stored, asked):
    index = blocks.load(spark, stored)
    own, wanted = blocks._wanted(index, asked.where("query_id in (0, 2)"), "query", ())
    read = blocks.plan(own, blocks.query_bands(own, wanted), 5).groupBy("essential").agg(F.sum("n").alias("n")).collect()
    n = {r["essential"]: r["n"] for r in read}
    assert n[False] > 0.8 * sum(n.values())


def test_a_search_reads_its_folders_only(spark, stored, asked):
    own, wanted = blocks._wanted(blocks.load(spark, stored), asked.where("query_id = 1"), "query", ())
    buckets = {r["bucket"] for r in wanted.collect()}
    text = own.blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text
    assert len(buckets) <= 2 and {r[0] for r in own.blocks.select("bucket").distinct().collect()} == buckets


def test_parts_are_appended_and_unfinished_ones_not_seen(spark, tmp_path, asked):
    path = str(tmp_path / "i")
    blocks.build(corpus(spark, 800), "key", buckets=16).save(path)
    more = corpus(spark, 500, 9, 10_000)
    # a writer that died before its last table
    half = blocks.build(corpus(spark, 300, 2, 50_000), "key", part="lost", buckets=16)
    half.blocks.write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")
    index = blocks.append(path, more, "1", key="key")
    both = lexical.build_index(corpus(spark, 800).union(more), "key")
    for k in (3, 50):
        same(blocks.search(index, asked, k, lead=100, direct=0), lexical.search(both, asked, k))
    assert {r[0] for r in index.blocks.select("bucket").distinct().collect()} <= set(range(16))
    with pytest.raises(ValueError):
        blocks.append(path, more, "1", key="key")


def test_hot_tokens_are_many_blocks_and_keys_are_unique(spark):
    index = blocks.build(corpus(spark, 2000), "key", block=32)
    assert index.blocks.agg(F.max(F.size("rows"))).first()[0] < 100
    with pytest.raises(ValueError):
        blocks.build(spark.createDataFrame([(1, "a b"), (1, "c d")], "key long, content string"), "key")


def test_empty_corpus_and_queries(spark, asked):
    index = blocks.build(corpus(spark, 50).limit(0), "key")
    assert [blocks.search(index, asked, direct=n).count() for n in (-1, 0)] == [0, 0]
    assert blocks.search(blocks.build(corpus(spark, 50), "key"), asked.limit(0)).count() == 0
