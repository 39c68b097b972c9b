"""The file source: every file once whatever its name, causes of errors, partitions, awkward trees."""

import pytest

from tessera.sources import files, recursive


@pytest.fixture
def tree(tmp_path):
    for name in ("a/_b/c.md", "_d=e.md", "_posts/x.md", ".hid/y.txt", "k=v/z.md", ".z.md", "plain.md", "with space/ü 1.md", "skip.bin", "_SUCCESS"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"# {name}\n\ntext of {name}")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "none").mkdir()
    return tmp_path


def test_every_supported_file_comes_once(spark, tree):
    got = files.load_documents(spark, str(tree)).collect()
    found = sorted(r["metadata"]["source_file"].split(f"{tree}/")[1] for r in got)
    assert found == sorted(["a/_b/c.md", "_d=e.md", "_posts/x.md", ".hid/y.txt", "k=v/z.md", ".z.md", "plain.md", "with space/ü 1.md", "empty.md"])
    assert all(r["metadata"]["source_file"].startswith("file:/") for r in got)
    assert {r["content"] for r in got} >= {"# a/_b/c.md\n\ntext of a/_b/c.md", ""}


def test_errors_by_cause(spark, tree):
    assert [(r["path"].rsplit("/", 1)[1], r["error"]) for r in files.load_errors(spark, str(tree)).collect()] == [("bad.txt", "UnicodeDecodeError")]
    spark.dataSource.register(recursive.FilesSource)
    large = spark.read.format(recursive.NAME).option("mostBytes", 3).load(str(tree)).where("error is not null").collect()
    assert {r["error"] for r in large} == {"FileTooLarge"} and all(r["bytes"] is None for r in large)
    reader = recursive.FilesReader(str(tree), recursive.MOST_BYTES)
    part = reader.partitions()[0]
    (tree / "plain.md").unlink()
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [r["error"] for r in rows if r["error"]] == ["FileNotFoundError"] and len(rows) == len(part.names)


def test_files_are_packed_into_partitions(tree, monkeypatch):
    monkeypatch.setattr(recursive, "PART_FILES", 3)
    parts = recursive.FilesReader(str(tree), recursive.MOST_BYTES).partitions()
    names = [n for p in parts for n, _ in p.names]
    assert len(parts) == 4 and len(names) == len(set(names)) == 12 and all(len(p.names) <= 3 for p in parts)


def test_one_file_no_file_and_no_path(spark, tree):
    assert files.load_documents(spark, str(tree / "_d=e.md")).count() == 1
    assert files.load_documents(spark, str(tree / "none")).count() == 0
    with pytest.raises(ValueError):
        files.load_documents(spark, str(tree / "absent"))
    assert len(files.load_markdown(spark, str(tree / "a"), "Docs").collect()) == 0  # under 50 characters
