"""The scan core against plain searches: lexical search without an index, vectors by matrix products, odd rows, ties."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.models import HashEmbedder
from tessera.operators import lexical, scan, vector

ROWS = ["query_id", "rank", "key", "score"]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 12)) for r in df.select(*ROWS).collect())


def plain(vectors, queries, k):
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    return vector.similarities(vectors, queries).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


@pytest.mark.parametrize("slice_rows", [7, 2048])
def test_lexical_scan_equals_the_index(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(scan, "ROWS", slice_rows)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [(f"k{i}", " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(300)]
    # a third are copies: ties fall to the smaller key; null, empty and foreign texts count as chunks
    texts += [(f"c{i}", texts[5][1]) for i in range(150)] + [("n", None), ("e", ""), ("x", "zz yy")]
    asked = [(i, " ".join(rng.choice(words, 8))) for i in range(40)] + [(50, texts[5][1]), (51, "absent"), (52, None), (53, "w1 w1"), (53, "w2")]
    chunks, queries = spark.createDataFrame(texts, "key string, content string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")
    want = rows(lexical.search(lexical.build_index(chunks, "key"), queries, 6))
    assert rows(lexical.search(lexical.Texts(chunks), queries, 6)) == want
    monkeypatch.setattr(lexical, "SCAN_NUMBERS", 1)
    assert rows(lexical.search(lexical.Texts(chunks), queries, 6)) == want


def test_lexical_scan_makes_no_postings(spark, monkeypatch):
    monkeypatch.setattr(lexical, "build_index", None)
    chunks = spark.createDataFrame([(1, "a1 b1"), (2, "b1")], "key long, content string")
    got = lexical.search(lexical.Texts(chunks), spark.createDataFrame([(1, "b1")], "query_id long, query string"), 1)
    assert [r["key"] for r in got.collect()] == [2]


def test_vector_search_equals_all_pairs_to_the_bit(spark, monkeypatch):
    monkeypatch.setattr(scan, "NUMBERS", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 9)).astype(np.float32).astype(float)
    x[100:250] = x[3]
    odd = [(1001, None), (1002, [0.0] * 9), (1003, [1.0]), (1004, [None] * 9), (1005, [float("nan")] * 9)]
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "key long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:30] * 2)] + [(90, None), (91, [0.0] * 9), (92, [2.0])], "query_id long, embedding array<double>")
    for vectors in (stored, stored.where("key < 1000")):
        for k in (1, 7):
            shown = lambda df: sorted((r["query_id"], r["rank"], r["key"], repr(r["score"])) for r in df.collect())
            assert shown(vector.search(vectors, asked, k)) == shown(plain(vectors, asked, k))
    # sound rows do not meet the queries one by one
    text = vector.search(stored.where("key < 1000"), asked.where("query_id < 30"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text


def test_embedder_forgets_words(monkeypatch):
    texts = ["a b c a", "", "c d", None]
    want = HashEmbedder(8).embed(texts)
    monkeypatch.setattr(HashEmbedder, "REMEMBERED", 1)
    assert HashEmbedder(8).embed(texts) == want and want[1] == want[3] == []


def test_single_searches_build_no_index(spark, sf, tmp_path, monkeypatch):
    """Queries that search ``documents`` once scan it; a stored index, if there is one, is read."""
    from tessera.operators import blocks
    from tessera.plans import catalog

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    want = {n: sorted(map(tuple, catalog.queries()[n](spark, sf).collect())) for n in ("bm25_topk", "missing_topics")}
    catalog.stored_index(spark, sf)
    for name, rows_ in want.items():
        assert sorted(map(tuple, catalog.queries()[name](spark, sf).collect())) == rows_ and rows_
    spark.sparkContext.setCheckpointDir(str(tmp_path / "other"))
    monkeypatch.setattr(blocks, "build", None)
    monkeypatch.setattr(lexical, "build_index", None)
    for name in ("bm25_topk", "rrf_fusion", "missing_topics"):
        assert catalog.queries()[name](spark, sf).count()
