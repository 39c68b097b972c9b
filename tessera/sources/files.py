"""File sources and report sinks.

Files are read whole, by tasks, through the data source in ``recursive``: every file below a folder comes once, also
one whose name or folder begins with ``_`` or ``.``. Paths of file systems that only Spark can open go through Spark's
reader; as it passes over such names, a folder that holds any is refused there (``ValueError``).
A supported file that cannot be read (too large, gone, no permission, broken) ends a load with its path and cause, so a
failed read never looks like a smaller folder; one that is not UTF-8 gives no document but a row of ``load_errors``. With
``failed="raise"`` that ends the load as well, with ``failed="skip"`` neither does and ``load_errors`` tells both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import recursive, snapshots

#: Which files without a document end a load: all, those that cannot be read, none.
FAILED = ("raise", "unread", "skip")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, error) of a file or of all files below a folder."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise ValueError(f"invalid source path: {path}")
    if fs.getScheme() in recursive.SCHEMES:
        spark.dataSource.register(recursive.FilesSource)
        own = path if "://" in path else at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
        return spark.read.format(recursive.NAME).load(own)
    found, top = fs.listFiles(at, True), at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    while found.hasNext():
        below = found.next().getPath().toString()[len(top) :].split("/")
        if any(part[:1] in ("_", ".") and "=" not in part for part in below):
            raise ValueError("names that begin with '_' or '.' cannot be read from this file system")
    whole = {"recursiveFileLookup": True, "ignoreMissingFiles": False, "ignoreCorruptFiles": False}
    rows = spark.read.format("binaryFile").options(**whole).load(path)
    return rows.select("path", F.col("content").alias("bytes"), F.lit(None).cast("string").alias("error"))


def _error() -> Column:
    return F.coalesce("error", F.when(~F.is_valid_utf8(F.col("bytes").cast("string")), "UnicodeDecodeError"))


def _texts(spark: SparkSession, path: str, wanted: Column, failed: str) -> DataFrame:
    """(path, content) of the wanted files; ``failed``: which of them without a text end the query."""
    if failed not in FAILED:
        raise ValueError(f"failed must be one of {', '.join(FAILED)}")
    ends = {"raise": _error().isNotNull(), "unread": F.col("error").isNotNull(), "skip": F.lit(False)}[failed]
    told = F.raise_error(F.concat(F.lit("no document of "), "path", F.lit(": "), _error())).cast("boolean")
    # one condition, and a filter: it is neither pruned with the columns nor asked of files that are not wanted
    rows = _raw(spark, path).where(F.when(wanted & ends, told).otherwise(wanted & _error().isNull()))
    return rows.select("path", F.col("bytes").cast("string").alias("content"))


def load_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the supported files that give no document."""
    rows = _raw(spark, path).where(T.suffix(F.col("path")).isin(*K.SUFFIXES))
    return rows.select("path", _error().alias("error")).where("error is not null")


def load_documents(spark: SparkSession, path: str, version: str = "latest", component: str = "generic", domain: bool = False, failed: str = "unread") -> DataFrame:
    """(title, content, metadata) of a file or of a folder's supported files, read recursively."""
    rows = _texts(spark, path, T.suffix(F.col("path")).isin(*K.SUFFIXES), failed)
    tags = T.tags(F.col("content")) if domain else F.array().cast("array<string>")
    category = T.category(F.col("path"), K.DOMAIN_CATEGORIES if domain else K.CATEGORIES)
    entries = {"version": F.lit(version), "category": category, "doc_type": T.doc_type(F.col("content"), F.col("path")), "component": F.lit(component), "tags": F.array_join(tags, ","), "source_file": F.col("path"), "file_type": T.suffix(F.col("path"))}
    metadata = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    return rows.select(T.title(F.col("content"), F.col("path")).alias("title"), "content", metadata.alias("metadata"))


def load_domain_documents(spark: SparkSession, path: str, version: str = "latest", failed: str = "unread") -> DataFrame:
    return load_documents(spark, path, version, "kubernetes", True, failed)


def load_markdown(spark: SparkSession, path: str, source: str, failed: str = "unread") -> DataFrame:
    """Markdown only, without index files and texts under 50 characters; title ``Source: Stem``."""
    rows = _texts(spark, path, (T.suffix(F.col("path")) == ".md") & ~F.endswith(T.file_name(F.col("path")), F.lit("_index.md")), failed)
    rows = rows.where(F.length(F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))) >= 50)
    base = path.rstrip("/").split("/")[-1]
    relative = F.when(F.lit(base.endswith(".md")), T.file_name(F.col("path"))).otherwise(F.regexp_extract("path", rf"/{base}/(.*)$", 1))
    parent = F.try_element_at(F.split("path", "/"), F.lit(-2))
    metadata = F.create_map(F.lit("source"), F.lit(source.lower()), F.lit("file"), relative, F.lit("category"), parent)
    return rows.select(F.concat(F.lit(f"{source}: "), T.stem_title(T.stem(F.col("path")))).alias("title"), "content", metadata.alias("metadata"))


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Documents sent as records {title, content, metadata?}; a missing title or content is refused."""
    for r in records:
        if not isinstance(r.get("title"), str) or not isinstance(r.get("content"), str):
            raise ValueError("a document needs a title and a content")
    rows = [(r["title"], r["content"], {str(k): str(v) for k, v in (r.get("metadata") or {}).items()}) for r in records]
    return spark.createDataFrame(rows, "title string, content string, metadata map<string,string>")


def from_upload(spark: SparkSession, data: bytes, filename: str | None = None, title: str | None = None) -> DataFrame:
    """One uploaded UTF-8 file as a document; its title is the given one, else the file's name, else "Untitled"."""
    try:
        content = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError("an upload must be UTF-8 text") from e
    return from_records(spark, [{"title": title or filename or "Untitled", "content": content}])


def save_texts(rows: DataFrame, path: str) -> int:
    """Writes rows (name, content) as ``<path>/<folder>/<name>-<part>-<number>.txt`` by tasks, one file a row; returns their number.

    A repeated name gives a file for each of its rows, in folders of at most ``recursive.FOLDER_FILES`` files; a null name or content is no file. Files are
    written under their last names: a task that runs again writes the same ones, so the rows' order in a partition must not change.
    """
    done = rows.select("name", "content").where("name is not null and content is not null").mapInArrow(recursive.writer(path), "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that ``upsert`` keeps."""
    try:
        return snapshots.open_snapshot(spark, path).read("rows")
    except ValueError as e:
        raise ValueError(f"no table at {path}") from e


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Replace rows of the same key in a table: a new version by ``snapshots.upsert``; older ones but the last go.

    A crash at any time leaves a complete version, which is the one that ``read_table`` takes.
    """
    snapshots.upsert(spark, path, "rows", rows, key)
    snapshots.vacuum(spark, path)


def reset(spark: SparkSession, path: str) -> None:
    """Remove a table with all its versions."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
