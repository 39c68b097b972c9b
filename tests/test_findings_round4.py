"""Tests for the findings of round 4."""

import os

import pytest
from pyspark.errors import PySparkException

from tessera.plans import catalog
from tessera.sources import files, recursive


def test_a_file_that_cannot_be_read_ends_the_load(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "other.bin").touch()
    os.truncate(tmp_path / "other.bin", recursive.MOST_BYTES + 1)
    assert files.load_documents(spark, str(tmp_path)).count() == 1  # not UTF-8, and not asked for
    with pytest.raises(PySparkException, match="bad.txt: UnicodeDecodeError"):
        files.load_documents(spark, str(tmp_path), failed="raise").count()
    (tmp_path / "big.md").touch()
    os.truncate(tmp_path / "big.md", recursive.MOST_BYTES + 1)
    for load in (lambda **o: files.load_documents(spark, str(tmp_path), **o), lambda **o: files.load_markdown(spark, str(tmp_path), "S", **o)):
        with pytest.raises(PySparkException, match="big.md: FileTooLarge"):
            load().count()
        assert load(failed="skip").count() <= 1
    assert sorted(r["error"] for r in files.load_errors(spark, str(tmp_path)).collect()) == ["FileTooLarge", "UnicodeDecodeError"]
    with pytest.raises(ValueError):
        files.load_documents(spark, str(tmp_path), failed="never")


def test_file_documents_keeps_every_page(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "u", "<p>ü</p>"), (2, "u", None), (None, "u", "no id"), (-3, "u", ""), (None, None, None), (1, "v", "again")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.oracles()["file_documents"]).fetchall()
    got = catalog.queries()["file_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_file_documents_fails_on_a_page_that_is_no_text(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>"), (2, "x")], "page_id long, html string")
    pages.selectExpr("page_id", "if(page_id = 2, cast(x'fffe' as string), html) as html").write.parquet(str(tmp_path / "pages.parquet"))
    with pytest.raises(PySparkException, match="UnicodeDecodeError"):
        catalog.queries()["file_documents"](spark, str(tmp_path)).count()
