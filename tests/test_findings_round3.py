"""Tests for the findings of round 3."""

from pathlib import Path

from tessera.operators import lexical, set_join
from tessera.sources import files, recursive


def test_texts_as_files_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recursive, "FOLDER_FILES", 3)
    rows = [(f"p{i % 5}", f"text {i}\n") for i in range(20)] + [("p0", ""), (None, "x"), ("gone", None)]
    root = f"{tmp_path}/.kept/_pages"
    assert files.save_texts(spark.createDataFrame(rows, "name string, content string").repartition(2), root) == 21
    assert files.save_texts(spark.createDataFrame([], "name string, content string"), root) == 0
    found = [p for p in Path(root).rglob("*") if p.is_file()]
    assert len(found) == 21 and all(p.suffix == ".txt" for p in found)
    assert max(sum(q.is_file() for q in p.iterdir()) for p in Path(root).rglob("*") if p.is_dir()) <= 3
    got = files.load_documents(spark, str(tmp_path)).select("content").collect()
    assert sorted(r["content"] for r in got) == sorted(c for n, c in rows if n and c is not None)


def test_files_leave_the_reader_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(recursive, "BATCH_FILES", 4)
    monkeypatch.setattr(recursive, "BATCH_BYTES", 10)
    for i in range(9):
        (tmp_path / f"{i}.txt").write_text("1234" if i else "longer than a batch")
    reader = recursive.FilesReader(str(tmp_path), 15)
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in got] == [3, 2, 2, 2]
    assert [e for b in got for e in b.column(2).to_pylist()] == ["FileTooLarge", *[None] * 8]


def test_sets_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(set_join, "TASK_ROWS", 50)
    texts = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(20))) for i in range(40)]
    rows = set_join.classes(spark.createDataFrame(texts, "key long, content string"), "content", "key")
    _, left, right = set_join.prefix_candidates(rows, rows, 0.5)
    # 800 words by 50 a task: 17 shares, more than the session's 8
    assert right.inputFiles() and len(right.inputFiles()) > 8
    words = {r["id"]: set(r["text"].split()) for r in rows.collect()}
    want = {(a, b) for a in words for b in words if len(words[a] & words[b]) >= 0.5 * len(words[a] | words[b])}
    got = {(bytes(r["asked_id"]), bytes(r["id"])) for r in set_join.similar(rows, rows, 0.5).collect()}
    assert got == {(bytes(a), bytes(b)) for a, b in want}


def test_index_rows_are_written_once(spark):
    docs = spark.createDataFrame([(1, "a pod restarts"), (2, None), (3, "")], "key long, content string")
    index = lexical.build_index(docs, "key")
    # postings and corpus are read off columns of one table, not off a checkpoint of whole rows
    assert index.postings.inputFiles() and set(index.postings.inputFiles()) == set(index.corpus.inputFiles())
    assert index.corpus.first()["n"] == 3 and {r["key"] for r in index.postings.collect()} == {1}
