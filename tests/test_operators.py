import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.models import HashEmbedder, OverlapReranker, RuleLlm, rerank_with
from tessera.operators import agentic, cache, fusion, ingest, lexical, observability, pipelines, sections, vector
from tessera.plans import catalog
from tessera.sources import files


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, key long, score double")


def test_bm25_scores_only_chunks_that_share_a_token(spark):
    docs = [(i, f"kubectl apply number{i}" if i < 50 else f"cooking recipe number{i}") for i in range(100)]
    index = lexical.build_index(spark.createDataFrame(docs, "key long, content string"), "key")
    q = spark.createDataFrame([(0, "kubectl")], "query_id long, query string")
    got = lexical.scores(index, q).collect()
    assert len(got) == 50 and all(r["key"] < 50 for r in got)
    idf = math.log((100 - 50 + 0.5) / 50.5 + 1)
    assert got[0]["score"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75)))


def test_index_survives_saving(spark, tmp_path):
    docs = spark.createDataFrame([(1, "pod restarts"), (2, "pod logs")], "key long, content string")
    index = lexical.build_index(docs, "key")
    index.save(str(tmp_path / "i"))
    q = spark.createDataFrame([(0, "logs")], "query_id long, query string")
    assert [r["key"] for r in lexical.search(lexical.LexicalIndex.load(spark, str(tmp_path / "i")), q).collect()] == [2]


def test_rank_fusion_prefers_items_of_both_lists(spark):
    got = {r["key"]: r["score"] for r in fusion.fuse(hits(spark, [(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7)]), hits(spark, [(0, 2, 5.0), (0, 4, 4.0), (0, 5, 3.0)])).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and max(got, key=got.get) == 2
    assert got[1] == pytest.approx(1 / 61 + 1 / (60 + 63))


def test_weighted_fusion(spark):
    got = {r["key"]: r["score"] for r in fusion.fuse(hits(spark, [(0, 1, 0.5), (0, 2, 1.0)]), hits(spark, [(0, 2, 2.0), (0, 3, 4.0)]), "weighted").collect()}
    assert got == pytest.approx({1: 0.3, 2: 0.6 + 0.2, 3: 0.4})
    with pytest.raises(ValueError):
        fusion.fuse(hits(spark, []), hits(spark, []), "other")


def test_vector_search_zero_norm_and_order(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "key long, embedding array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["key"], round(r["score"], 4)) for r in vector.search(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 0.7071), (3, 0.0)]
    blocks = vector.similarities(v, q.union(q.selectExpr("1L as query_id", "embedding")), broadcast_numbers=2)
    assert blocks.count() == 6


def test_ann_topk_recall_without_the_query_itself(spark):
    d = "/root/testdata/sf0.01"
    got = {(r["query_id"], r["key"]) for r in catalog.ann_topk(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = {r[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id").collect()} & set(ids.tolist())
    best = {(q, int(k)) for q in asked for k in ids[np.argsort(-(x @ x[ids == q][0]), kind="stable")[:5]] if k != q}
    assert len(got & best) >= 0.9 * len(best)


DOC = "# Guide\nintro\n## Install\nstep\n### Linux\nrun\n## Use\ntry\n## End\nbye"


def tree(spark, text, title="T"):
    docs = spark.createDataFrame([(1, title, text)], "doc_id long, title string, content string")
    return docs, sections.build_sections(docs)


def test_sections_answer_every_question(spark):
    docs, _ = tree(spark, DOC)
    asked = spark.range(1001).select(F.col("id").alias("query_id"), F.lit("How to install on Linux?").alias("query"))
    got = pipelines.answer_from_sections(docs, asked, 2).collect()
    assert sorted(r["query_id"] for r in got) == list(range(1001)) and len({r["answer"] for r in got}) == 1


def test_section_tree(spark):
    _, got = tree(spark, DOC)
    rows = got.orderBy("ord").collect()
    assert [r["node_id"] for r in rows] == ["1", "1.1", "1.1.1", "1.2", "1.3"]
    assert [(r["line_start"], r["line_end"]) for r in rows] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    assert [r["parent_id"] for r in rows] == [None, "1", "1.1", "1", "1"]


def test_skipped_levels(spark):
    _, got = tree(spark, "# a\n### b\n## c\n#### d\n# e")
    assert [r["node_id"] for r in got.orderBy("ord").collect()] == ["1", "1.1", "1.2", "1.2.1", "2"]


def test_flat_text_gets_a_heading_and_unknown_nodes_nothing(spark):
    docs, got = tree(spark, "no headings here\nat all")
    assert [(r["node_id"], r["title"]) for r in got.collect()] == [("1", "T")]
    wanted = spark.createDataFrame([(1, "9.9"), (2, "1")], "doc_id long, node_id string")
    assert sections.section_text(docs, got, wanted).count() == 0


def test_toc_indents(spark):
    _, got = tree(spark, DOC)
    assert sections.toc(got).first()["toc"].split("\n")[:3] == ["[1] Guide (lines 1-2)", "  [1.1] Install (lines 3-4)", "    [1.1.1] Linux (lines 5-6)"]


def store(spark, rows):
    return spark.createDataFrame(rows, "id string, query string, response string, embedding array<double>, created_at timestamp, last_used_at timestamp")


def test_cache(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    full = store(spark, [("a", "qa", "ra", [1.0, 0.0], t[0], t[0]), ("b", "qb", "rb", [0.0, 1.0], t[1], t[1]), ("c", "qc", "rc", [0.6, 0.8], t[2], t[2])])
    ask = lambda v: spark.createDataFrame([(0, v)], "query_id long, embedding array<double>")
    now = F.lit(t[3])
    assert cache.lookup(full.limit(0), ask([1.0, 0.0]), now).first()["hit"] is False
    assert cache.lookup(full, ask([0.0, 2.0]), now, ttl_seconds=7200).first()["cache_id"] == "b"
    assert cache.lookup(full, ask([1.0, 0.0]), now, ttl_seconds=7200).first()["hit"] is False  # expired
    assert cache.lookup(full, ask([-1.0, 0.0]), now, ttl_seconds=1e6).first()["hit"] is False
    assert {r["id"] for r in cache.evict(full, now, 2, 1e6).collect()} == {"b", "c"}
    touched = cache.touch(full, cache.lookup(full, ask([1.0, 0.0]), now, ttl_seconds=1e6), now)
    assert {r["id"] for r in cache.evict(touched, now, 2, 1e6).collect()} == {"a", "c"}


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    got = observability.nearest_rank(df, "v", {"median": 0.5, "p95": 0.95}).first()
    assert (got["min"], got["max"], got["median"], got["p95"]) == (1.0, 10.0, 6.0, 10.0)


DOCS = [(1, "pods", "# Pods\n" + "A pod is the smallest unit that can be deployed. " * 8), (2, "soup", "# Soup\n" + "Boil water, add salt and vegetables, and wait. " * 8), (3, "tiny", "x")]


def docs_of(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, content string")


def test_ingest_reports_documents_without_chunks(spark):
    chunks, report = ingest.ingest(docs_of(spark), HashEmbedder(16))
    got = {r["doc_id"]: r for r in report.collect()}
    assert got[3]["error"] and got[3]["n_chunks"] == 0 and not got[1]["error"]
    assert [r["chunk_index"] for r in chunks.where("doc_id = 1").orderBy("chunk_index").collect()][0] == 0
    assert ingest.totals(report).first()["errors"] == 1


def test_failing_models_do_not_fail_the_job(spark):
    # inside the test, so that it is shipped by value
    class Broken:
        def embed(self, texts):
            raise OSError

        def score(self, pairs):
            raise OSError

        def complete(self, prompt):
            raise OSError

    chunks, report = ingest.ingest(docs_of(spark), Broken())
    assert chunks.count() == 0 and report.where("error is null").count() == 0
    rows = spark.createDataFrame([(0, 1, 1, 0.9, "q", "a"), (0, 2, 2, 0.5, "q", "b")], "query_id long, key long, rank long, score double, query string, content string")
    assert [r["key"] for r in rerank_with(Broken())(rows, 1).collect()] == [1]
    q = spark.createDataFrame([("what is it",)], "query string")
    assert agentic.decompose(q, Broken()).first()["sub_questions"] == ["what is it"]
    assert agentic.self_check(q.withColumn("answer", F.lit("a")), Broken()).first()["check"]["complete"] is True


def test_pipelines(spark):
    q = spark.createDataFrame([(0, "smallest pod unit deployed")], "query_id long, query string")
    corpus = pipelines.Corpus(docs_of(spark), HashEmbedder(32))
    for method in ("rrf", "weighted", "vector", "bm25"):
        assert corpus.search(q, 1, method).first()["doc_id"] == 1
    assert corpus.search(q, 1, rerank=rerank_with(OverlapReranker())).first()["doc_id"] == 1
    assert {r["strategy"] for r in pipelines.compare(corpus, q, 2).collect()} == {"rrf", "weighted", "vector"}
    log = pipelines.answer_agentic(docs_of(spark), q, 3, embedder=HashEmbedder(32)).first()
    assert log["iterations"] == 1 and log["complete"] and log["answer"]


def test_cached_answers(spark):
    q = spark.createDataFrame([(0, "smallest pod unit")], "query_id long, query string")
    now, empty = F.lit("2024-01-01").cast("timestamp"), store(spark, [])
    first, after = pipelines.answer_cached(empty, docs_of(spark), q, now, 2)
    assert first.first()["cache_hit"] is False
    again, _ = pipelines.answer_cached(after, docs_of(spark), q, now, 2)
    assert again.first()["cache_hit"] is True


def test_iterations_are_bounded(spark):
    with pytest.raises(ValueError):
        agentic.run(spark, "q", None, None, RuleLlm(), max_iterations=10)
    with pytest.raises(ValueError):
        pipelines.benchmark(spark.createDataFrame([], "query_id long, seconds double"), spark.createDataFrame([], "query_id long, seconds double"))


def test_file_sources(spark, tmp_path):
    (tmp_path / "concepts").mkdir()
    (tmp_path / "concepts" / "my-page.md").write_text("# Page\n" + "An overview of pods and services in the cluster. " * 2)
    (tmp_path / "concepts" / "_index.md").write_text("# Index\n" + "x" * 80)
    (tmp_path / "setup.yaml").write_text("kind: Pod")
    (tmp_path / "skip.bin").write_text("no")
    got = {r["title"]: r["metadata"] for r in files.load_domain_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"Page", "Setup", "Index"}  # one document a file, also of names that Spark's readers pass over
    assert got["Page"]["category"] == "concepts" and got["Page"]["doc_type"] == "concept" and "pod" in got["Page"]["tags"]
    assert got["Setup"]["doc_type"] == "config"
    only = files.load_markdown(spark, str(tmp_path), "Kubernetes").collect()
    assert [(r["title"], r["metadata"]["file"], r["metadata"]["category"]) for r in only] == [("Kubernetes: My Page", "concepts/my-page.md", "concepts")]
    (tmp_path / "_notes.md").write_text("# Notes\n" + "long enough " * 9)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00 broken")
    assert {r["title"] for r in files.load_markdown(spark, str(tmp_path), "Kubernetes").collect()} == {"Kubernetes: My Page", "Kubernetes:  Notes"}
    assert "Bad" not in {r["title"] for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert [(r["path"].endswith("bad.txt"), r["error"]) for r in files.load_errors(spark, str(tmp_path)).collect()] == [(True, "UnicodeDecodeError")]
    one = files.load_documents(spark, str(tmp_path / "concepts" / "my-page.md")).first()
    assert one["content"].count("\n") == 1
    up = files.from_upload(spark, "# Hé\ntext".encode(), "a.txt").first()
    assert (up["title"], up["content"]) == ("a.txt", "# Hé\ntext")
    with pytest.raises(ValueError):
        files.from_upload(spark, b"\xff\xfe", "a.bin")
    with pytest.raises(ValueError):
        files.load_documents(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        files.from_records(spark, [{"title": "only"}])


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    files.upsert(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), "k")
    files.upsert(spark, path, spark.createDataFrame([(2, "c")], "k long, v string"), "k")
    assert sorted(map(tuple, files.read_table(spark, path).collect())) == [(1, "a"), (2, "c")]
    (tmp_path / "t" / "data" / "rows-dead").mkdir()  # the folder of a writer that died
    assert sorted(map(tuple, files.read_table(spark, path).collect())) == [(1, "a"), (2, "c")]
    files.reset(spark, path)
    with pytest.raises(ValueError):
        files.read_table(spark, path)


def test_streaming_ingest(spark, tmp_path):
    from tessera.streaming import incremental

    docs_of(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, title string, content string").parquet(str(tmp_path / "in"))
    incremental.start(stream, str(tmp_path / "index"), str(tmp_path / "cp"), HashEmbedder(16)).awaitTermination(120)
    q = spark.createDataFrame([(0, "vegetables")], "query_id long, query string")
    got = lexical.search(incremental.load_index(spark, str(tmp_path / "index")), q).collect()
    assert got and all(r["key"].startswith("2#") for r in got)


def test_cache_survives_saving_without_expired_entries(spark, tmp_path):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    full = store(spark, [("a", "qa", "ra", [1.0], t[0], t[0]), ("b", "qb", "rb", [1.0], t[3], t[3])])
    cache.save(full, str(tmp_path / "c"))
    assert [r["id"] for r in cache.load(spark, str(tmp_path / "c"), F.lit(t[4]), 7200).collect()] == ["b"]
    assert cache.clear(full).count() == 0
    vector.save(full.select("id", "embedding"), str(tmp_path / "v"))
    assert vector.load(spark, str(tmp_path / "v")).count() == 2


def test_ingest_dispatch(spark):
    chunks, tree, counts = ingest.dispatch(docs_of(spark), "both", HashEmbedder(16))
    got = counts.first()
    assert (got["successful"], got["errors"]) == (3, 1) and got["chunks"] == chunks.count() + tree.count()
    chunks, tree, counts = ingest.dispatch(docs_of(spark), "pageindex", HashEmbedder(16))
    assert chunks is None and counts.first()["successful"] == 3
    with pytest.raises(ValueError):
        ingest.dispatch(docs_of(spark), "other", HashEmbedder(16))


def test_agentic_loop_over_many_questions(spark):
    class Checker(RuleLlm):
        def complete(self, prompt):
            if prompt.startswith("TASK check"):
                return '{"complete": false, "confidence": 0.4, "gaps": ["boil water"]}' if "pod" in prompt.split("Answer")[0] else '{"complete": true, "confidence": 0.9}'
            return super().complete(prompt)

    q = spark.createDataFrame([(1, "smallest pod unit"), (2, "water and salt"), (3, "zzz")], "query_id long, query string")
    got = {r["query_id"]: r for r in pipelines.answer_agentic(docs_of(spark), q, 3, 2, HashEmbedder(32), Checker()).collect()}
    assert set(got) == {1, 2, 3} and (got[1]["iterations"], got[1]["complete"]) == (2, False) and (got[2]["iterations"], got[2]["complete"]) == (1, True)
    with pytest.raises(ValueError):
        agentic.run_all(q, None, None, RuleLlm(), max_iterations=0)


def test_health_and_tips(spark):
    v = spark.createDataFrame([(1, [1.0])], "key long, embedding array<double>")
    assert observability.health(v, True)["status"] == "healthy" and observability.health(None, True)["status"] == "degraded"


def test_summary_of_few_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 7.0), (None, 2.0), (None, 2.0), ("a", None)], "k string, v double")
    got = {r["k"]: r for r in observability.summary(df, "v", "k").collect()}
    assert (got["a"]["median"], got["b"]["median"], got["b"]["stdev"], got[None]["median"], got[None]["max"]) == (2.5, 7.0, 0.0, 2.0, 2.0)


def test_settings_from_env():
    assert Settings.from_env({"CHUNK_SIZE": "512", "USE_RERANKER": "true", "unknown": "1"}) == Settings(CHUNK_SIZE=512, USE_RERANKER=True)
