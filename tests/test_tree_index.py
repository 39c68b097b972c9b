"""The index over section trees against scoring every section, and retrieval through it."""

import random
import re

import pytest

from tessera.operators import pipelines, tree_index
from tessera.models import RuleLlm


def trees(spark, n=400, seed=3):
    """Documents of twelve sections; every tenth has a section of its topic's own words, a third share one section."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = [f"# Guide {i}"] + [f"## Part {j}\n" + " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(30)) for j in range(12)]
        if i % 10 == 0:
            parts.insert(rng.randrange(1, 12), f"### About topic{i} and matter{i}\ntopic{i} matter{i} substance{i}")
        if i % 3 == 0:
            parts.append("## Licence\nshared words of all licences")
        out.append((i, f"t{i}", "\n".join(parts)))
    return spark.createDataFrame(out, "doc_id long, title string, content string")


def asked(spark, seed=5):
    rng = random.Random(seed)
    rows = [(i, f"topic{i} matter{i} w{rng.randrange(1, 40)} w{rng.randrange(40, 3000)}") for i in range(0, 400, 40)]
    return spark.createDataFrame(rows + [(1000, "shared licences"), (1001, None), (1002, ""), (1003, "unheard")], "query_id long, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["node_id"], round(r["score"], 8)) for r in df.collect())


def test_bounds_give_the_rows_of_scoring_all_sections(spark, tmp_path):
    index = tree_index.build(trees(spark))
    index.save(str(tmp_path / "i"))
    index = tree_index.load(spark, str(tmp_path / "i"))
    for k in (1, 5):
        got = rows(tree_index.search(index, asked(spark), k))
        assert got == rows(tree_index.search_all(index, asked(spark), k)) and {g[0] for g in got} == {*range(0, 400, 40), 1000}
    weighted = tree_index._weighted(index, asked(spark).where("query_id < 1000"), "query")
    known, possible = tree_index.candidates(index, weighted, 1)
    assert possible.count() < 0.2 * known.count()
    assert len(rows(tree_index.search(index, asked(spark), 1000))) == len(rows(tree_index.search_all(index, asked(spark), 1000)))


def test_brute_force(spark):
    import math

    docs, questions = trees(spark, 60), asked(spark).where("query_id < 60 or query_id = 1000")
    held = {}
    for d in docs.collect():
        ids, counts = [], [0, 0, 0]
        for part in re.split(r"\n(?=#)", d["content"]):
            level = len(part) - len(part.lstrip("#"))
            counts = counts[: level - 1] + [counts[level - 1] + 1] + [0] * (3 - level)
            held[d["doc_id"], ".".join(str(c) for c in counts[:level])] = set(re.findall(r"[a-z0-9]{2,}", part.lower()))
    df = lambda t: sum(t in s for s in held.values())
    want = []
    for q in questions.collect():
        idf = {t: math.log((len(held) - df(t) + 0.5) / (df(t) + 0.5) + 1) for t in set(q["query"].split())}
        best = {}
        for (doc, node), s in sorted(held.items()):
            score = round(sum(v for t, v in idf.items() if t in s), 8)
            if s & set(idf) and score > best.get(doc, (-1.0, ""))[0]:
                best[doc] = (score, node)
        ranked = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:5]
        want += [(q["query_id"], r + 1, doc, node, score) for r, (doc, (score, node)) in enumerate(ranked)]
    assert rows(tree_index.search(tree_index.build(docs), questions, 5)) == sorted(want)


def test_the_navigator_sees_the_best_documents(spark):
    """A navigator that picks headings sharing a word with the question finds through the index what it finds in all documents."""

    class ByWords(RuleLlm):
        def complete(self, prompt):
            if not prompt.startswith("TASK navigate"):
                return super().complete(prompt)
            toc, _, question = prompt.rpartition("\nQuestion: ")
            words = set(question.split())
            ids = [i for i, title in re.findall(r"\[([\d.]+)\] (.*) \(lines", toc) if words & set(title.lower().split())]
            return '{"relevant_nodes": [' + ", ".join(f'"{i}"' for i in ids[:4]) + "]}"

    docs, questions = trees(spark), asked(spark).where("query_id < 1000")
    every = {r["query_id"]: r["answer"] for r in pipelines.answer_from_sections(docs, questions, 3, ByWords()).collect()}
    pruned = {r["query_id"]: r["answer"] for r in pipelines.answer_from_sections(docs, questions, 3, ByWords(), documents_per_query=5).collect()}
    assert len(every) == 10
    assert sum(pruned.get(q) == a for q, a in every.items()) / len(every) >= 0.9


def test_awkward_documents(spark):
    schema = "doc_id long, title string, content string"
    index = tree_index.build(spark.createDataFrame([(1, "a", ""), (2, None, None), (3, "b", "# One\nword\n# One\nword")], schema))
    q = spark.createDataFrame([(0, "word")], "query_id long, query string")
    assert [(r["doc_id"], r["node_id"], r["rank"]) for r in tree_index.search(index, q).collect()] == [(3, "1", 1)]
    assert tree_index.search(tree_index.build(spark.createDataFrame([], schema)), q).count() == 0
    for bad in ([(1, "a", "x"), (1, "a", "y")], [(None, "a", "x")]):
        with pytest.raises(ValueError):
            tree_index.build(spark.createDataFrame(bad, schema))
