"""Replies of the navigator are ranked without joining all of them with the sections."""

from tessera.operators import sections


def test_replies_rank_as_choices(spark):
    docs = spark.createDataFrame([(i, "t", f"# a{i}\n\nx\n## b\ny\n## c\nz") for i in range(6)], "doc_id long, title string, content string")
    tree = sections.build_sections(docs)
    said = spark.createDataFrame([(q, d, ["9.9", "1.2", "1", "1.1"][d % 3 :] + ["1.7"]) for q in (1, 2) for d in range(6)], "query_id long, doc_id long, ids array<string>").selectExpr("*", "doc_id as doc_ord")
    with_nodes = said.join(sections.toc(tree, with_nodes=True).select("doc_id", "nodes"), "doc_id")
    shown = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["node_id"], r["title"]) for r in df.collect())
    got = sections.rank_replies(with_nodes, tree, 5)
    assert shown(got) == shown(sections.rank_sections(said, tree, 5)) and len(shown(got)) == 10
