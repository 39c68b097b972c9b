"""Set and phrase joins against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import set_join

WORDS = [f"w{i}" for i in range(60)] + ["the"]


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    docs = ["the " + " ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(61)], k=rng.randint(1, 25))) for _ in range(n)]
    docs += docs[:40] + ["the the", "", "...", "xw1 w2y", "w1-w2", "İ Σ ΑΣ", "long " * 3000 + "w3"]
    asked = [d.upper() for d in docs[:25]] + [" ".join(d.split()[1:4]) for d in docs[:25]] + [" w1 w2 ", "w1 w2", "w1", "", ".", "1 w2 w", "absent w1 word", "ΑΣ"]
    return [(i, d) for i, d in enumerate(docs)] + [(998, None), (None, "the w1")], [(i, a) for i, a in enumerate(asked)] + [(500, None), (0, "w5 the w6")]


def words(s):
    return set(re.findall(r"\w+", s.lower()))


def jaccard(q, d):
    return len(words(q) & words(d)) / len(words(q) | words(d)) if words(q) else 0.0


@pytest.fixture(scope="module")
def sides(spark):
    docs, asked = corpus()
    d = spark.createDataFrame(docs, "key long, content string").withColumn("n", F.lit("clash")).repartition(5)
    return docs, asked, d, spark.createDataFrame(asked, "query_id long, query string").withColumn("id", F.lit(1))


def lower(s):
    return s.lower()


def test_summary_equals_all_pairs(sides):
    docs, asked, d, q = sides
    texts = [t for _, t in docs if t is not None]
    want = {}
    for i in {i for i, _ in asked}:
        mine = [a for j, a in asked if j == i and a is not None]
        if not mine:
            want[i] = (0, None, None)
            continue
        scores = [[jaccard(a, t) for t in texts] for a in mine]
        want[i] = (sum(lower(a) in lower(t) for a in mine for t in texts), max(map(max, scores)), sum(map(sum, scores)) / len(texts) / len(mine))
    got = {r["query_id"]: (r["exact"], r["best"], r["mean"]) for r in set_join.summary(d, q).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i] == (pytest.approx(want[i]) if want[i][1] is not None else want[i]), (i, asked[i] if i < len(asked) else None)


@pytest.mark.parametrize("t, limit", [(0.2, 1 << 25), (0.5, 0), (0.8, 1 << 25), (1.0, 0)])
def test_prefix_filter_loses_nothing_and_prunes(sides, t, limit):
    docs, asked, d, q = sides
    texts, mine = set_join.classes(d, "content", "key"), set_join.classes(q, "query")
    found = set_join.similar(texts, mine, t, limit)
    named = found.join(texts.select("id", "text"), "id").join(mine.select(F.col("id").alias("asked_id"), F.col("text").alias("asked")), "asked_id")
    got = sorted((r["asked"], r["text"], round(r["score"], 9)) for r in named.collect())
    left, right = {lower(a) for _, a in asked if a is not None}, {lower(t) for _, t in docs if t is not None}
    assert got == sorted((a, b, round(jaccard(a, b), 9)) for a in left for b in right if jaccard(a, b) >= t) and got
    if t >= 0.8:
        assert set_join.prefix_candidates(texts, mine, t)[0].count() < 0.25 * len(left) * len(right)


def test_candidates_are_few_and_no_pairs_are_crossed(sides):
    docs, asked, d, q = sides
    texts, mine = set_join.classes(d, "content"), set_join.classes(q.where("query_id between 25 and 49"), "query")
    likely = set_join.phrase_candidates(texts, mine)
    assert likely.count() < 0.6 * texts.count() * mine.count()
    for df in (set_join.overlaps(texts, mine), set_join.similar(texts, mine, 0.5), set_join.phrase_hits(texts, set_join.classes(q.where("query_id < 5"), "query"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty_sides(sides):
    _, _, d, q = sides
    assert set_join.summary(d.limit(0), q).count() == 0
    assert set_join.summary(d, q.limit(0)).count() == 0
    none = set_join.classes(d.limit(0), "content")
    assert set_join.similar(none, set_join.classes(q, "query"), 0.5).count() == 0
    with pytest.raises(ValueError):
        set_join.similar(none, none, 0.0)
