"""Arguments and null ids with defined results."""

import pytest

from tessera.llm import simhash, suffix_dedup


def test_null_ids_link_nothing(spark):
    # texts of 2, 1 and 0 words; the second is held by null ids only
    rows = [(None, "only here"), (None, "shared text"), (3, "shared text"), (2, "other"), (None, None), (7, "")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(2, 2), (3, 3), (7, 7)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] * 3


@pytest.mark.parametrize("width, gram", [(53, 20), (20, 20), (50, 0), (60, 32)])
def test_width_out_of_range(spark, width, gram):
    docs = spark.createDataFrame([(1, "x" * 200), (2, "x" * 200)], "doc_id long, text string")
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(docs, width, gram)


@pytest.mark.parametrize("width, gram", [(52, 20), (40, 31)])
def test_other_widths_within_range(spark, width, gram):
    docs = spark.createDataFrame([(1, "abcdefghij" * 12), (2, "--" + "abcdefghij" * 12), (3, "unlike")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_substrings(docs, width, gram).collect()}
    assert got == {1: (0, 0), 2: (120, 1), 3: (0, 0)}
