"""Chunks leave the worker in batches of bounded size."""

import pyarrow as pa

from tessera.functions import splitter
from tessera.functions.splitter import split_text
from tessera.operators import ingest


def test_chunks_leave_the_worker_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(splitter, "HELD", 1000)
    texts = ["word " * 300, None, "", "short", "line of words. " * 90]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["doc_id", "content"])
    out = list(splitter.split_rows(200, 40)(iter([batch])))
    assert len(out) > 1
    got = [r for b in out for r in b.to_pylist()]
    assert got == [{"doc_id": i, "chunk_index": j, "content": c} for i, t in enumerate(texts) for j, c in enumerate(split_text(t, 200, 40))]
    docs = spark.createDataFrame([(1, "t", "x " * 700), (2, None, None)], "doc_id long, title string, content string")
    assert [(r["doc_id"], r["chunk_index"], r["title"]) for r in ingest.chunk(docs).collect()] == [(1, j, "t") for j in range(len(split_text("x " * 700)))]
