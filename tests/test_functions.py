import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.splitter import split_code, split_recursive, split_text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_domain_terms_survive_tokenising(spark):
    got = one(spark, "Use kubectl to apply the NetworkPolicy of kube-system, not my_app", T.tokens)
    assert {"kubectl", "networkpolicy", "kube-system", "kube", "system", "my_app", "my", "app"} <= set(got)
    assert len(got) == len(set(got)) and all(len(t) > 1 for t in got)


@pytest.mark.parametrize("raw, want", [("What area codes correspond to Athens, Greece?", "what area codes correspond to athens greece"), ("  How to debug   pod networking? ", "how to debug pod networking"), ("kube-system", "kube-system")])
def test_normaliser(spark, raw, want):
    assert one(spark, raw, T.normalize_query) == want


def test_overlap_and_phrase(spark):
    row = spark.createDataFrame([("red fox", "A Red Fox jumps"), ("", "x"), ("cat", "dog")], "q string, c string").select(T.overlap(F.col("q"), F.col("c")), T.exact_phrase(F.col("q"), F.col("c"))).collect()
    assert [tuple(r) for r in row] == [(0.5, True), (0.0, True), (0.0, False)]


def quality(content):
    if not content:
        return 0.0
    score = min(1.0, len(content) / 50) * min(2 * len(set(content.lower())) / min(len(content), 100), 1.0)
    words = content.split()
    if len(words) > 5:
        score *= 0.7 + 0.3 * len(set(words)) / len(words)
    return max(score, 0.1)


@pytest.mark.parametrize("content", ["", "a", "a" * 200, "the quick brown fox jumps over the lazy dog again and again", "x y " * 40])
def test_quality(spark, content):
    assert one(spark, content, T.quality) == pytest.approx(quality(content))


def test_classifier_takes_the_first_class(spark):
    assert one(spark, "Why does the deploy fail?", T.classify) == "configuration"
    assert one(spark, "Why is it slow?", T.classify) == "troubleshooting"
    assert one(spark, "hello", T.classify) == "general"


def test_node_ids(spark):
    assert one(spark, '{"relevant_nodes": ["1.1", "2"]}', T.json_nodes) == ["1.1", "2"]
    assert one(spark, 'Sure: {"relevant_nodes": ["3"]} done', T.json_nodes) == ["3"]
    assert one(spark, '{"relevant_nodes": []}', T.json_nodes) == []
    assert one(spark, "no json", T.json_nodes) == []
    assert one(spark, "[1, 2]", T.json_nodes) == []


def test_json_list(spark):
    assert one(spark, '["first one", " second "]', T.json_list) == ["first one", "second"]
    assert one(spark, 'Here: ["a b c"] ok', T.json_list) == ["a b c"]
    assert one(spark, '"a question of length" x', T.json_list) == ["a question of length"]
    assert one(spark, "nothing", T.json_list) is None


def test_self_check(spark):
    got = one(spark, '{"complete": false, "confidence": 1.7, "gaps": [" x ", ""]}', T.json_check)
    assert (got["complete"], got["confidence"], got["gaps"]) == (False, 1.0, ["x"])
    got = one(spark, "garbage", T.json_check)
    assert (got["complete"], got["confidence"], got["gaps"]) == (True, 0.5, [])


@pytest.mark.parametrize("reply, want", [('{"score": 0.8, "reason": "ok"}', 0.8), ("bad", 0.5), ('{"score": 1.5}', 1.0), ('{"score": -0.5}', 0.0), ('text {"score": 0.3} end', 0.3), ('"score": 0.7 broken', 0.7), ("0.9", 0.5)])
def test_score_parsing(spark, reply, want):
    assert one(spark, reply, T.json_score) == pytest.approx(want)


def test_titles(spark):
    rows = [("# Top\ntext", "a/b.md"), ("---\ntitle: Front\n---\nx", "a/b.md"), ("none", "docs/my-file_name.md")]
    got = spark.createDataFrame(rows, "c string, p string").select(T.title(F.col("c"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["Top", "Front", "My File Name"]


def test_lines_drop_only_the_last_empty_one(spark):
    assert one(spark, "a\r\nb\n\nc\n", T.lines) == ["a", "b", "", "c"]
    assert one(spark, "", T.lines) == []


def test_splitter_keeps_fences_whole_with_their_context():
    text = "# How to apply\nUse this manifest to create the object:\n```yaml\nkind: Pod\nmetadata:\n  name: x\n```\nThen wait until the pod is ready and look at its logs for errors."
    chunks = split_text(text)
    assert any(c.startswith("Use this manifest") and c.endswith("```") for c in chunks)
    assert sum("kind: Pod" in c for c in chunks) == 1


def test_splitter_sizes_and_overlap():
    words = " ".join(f"word{i:04d}" for i in range(200))
    chunks = split_recursive(words, 100, 30)
    assert all(len(c) <= 100 for c in chunks)
    assert all(a.split()[-1] in b.split() for a, b in zip(chunks, chunks[1:]))
    assert {w for c in chunks for w in c.split()} == set(words.split())


def test_splitter_small_cases():
    assert split_text("short") == []
    assert split_text("") == split_text(None) == []
    assert split_text("x" * 2000) == ["x" * 2000]
    assert split_recursive("aaa bbb ccc", 7, 0, (" ",)) == ["aaa bbb", "ccc"]


def test_large_code_is_fenced_anew():
    block = "```yaml\n" + "\n---\n".join("k: " + "v" * 60 for _ in range(4)) + "\n```"
    chunks = split_code(block, 150)
    assert len(chunks) == 2 and all(c.startswith("```\n") and c.endswith("\n```") for c in chunks)
