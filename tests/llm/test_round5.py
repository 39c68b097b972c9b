"""Findings of round 3, second reading: what failed before the change that goes with each test."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import common, simhash


def test_rows_without_an_id_are_not_packed_by_a_worker_of_their_own(spark):
    """The task that cuts passages runs one Python worker, so an executor keeps one for each core."""
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, "c")], "doc_id long, text string")
    packed, without_id = common.packed_texts(docs)
    assert "MapInArrow" in packed._jdf.queryExecution().toString() and "MapInArrow" not in without_id._jdf.queryExecution().toString()
    rows = packed.unionByName(without_id).collect()
    got = common.raw_texts(pa.array([r["id"] for r in rows]), pa.array([r["packed"] for r in rows], pa.binary()))
    assert sorted(got) == [b"", b"a b", b"c"]


def test_pipeline_stage_finds_fingerprints_at_three_bits_by_the_ring(spark, monkeypatch):
    """the stage's first candidates are those of the pigeonring, all fingerprints at 3 bits or fewer."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(200)]
    prints += [x ^ sum(1 << b for b in rng.sample(range(64), k % 5)) for k, x in enumerate(prints)]
    rows = [(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(prints)]
    got = {(r["a"], r["b"]) for r in simhash.ring_pairs(spark.createDataFrame(rows, "rep long, first long")).collect()}
    assert got == {(k, k + 200) for k in range(200) if k % 5 <= 3}
    text = [f"v{rng.randrange(10**6)}" for _ in range(2000)]
    docs = spark.createDataFrame([(i, " ".join([*text[: 10 * i], "other", *text[10 * i + 1 :]])) for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "_ring_keys", lambda *a: lambda batches: iter(()))
    assert simhash.keep_first(docs).count() < 20
