"""Ingest: chunk, prefix, embed, drop failures, renumber; documents that give no chunk become error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from ..functions.splitter import split_rows
from ..models import Embedder, embed
from ..sources.shared import materialise
from . import sections


def contextual_prefix(title: Column, content: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("] "), content)


def chunk(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """docs(doc_id, title, content, ...) -> a row for each chunk with ``chunk_index`` from 0; other columns stay."""
    others = [c for c in docs.columns if c != "content"]
    kept = docs.select(*others, "content")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    return kept.mapInArrow(split_rows(settings.CHUNK_SIZE, settings.CHUNK_OVERLAP, settings.USE_CODE_AWARE_SPLITTING), schema)


def embedded(chunks: DataFrame, model: Embedder, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks with ``embedding``, which is empty where it failed."""
    text = contextual_prefix(F.col("title"), F.col("content")) if settings.USE_CONTEXTUAL_PREFIX else F.col("content")
    return chunks.withColumn("embedding", embed(text, model))


def embed_chunks(chunks: DataFrame, model: Embedder, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks with ``embedding``; chunks whose embedding failed drop out, the others are numbered anew."""
    return renumbered(embedded(chunks, model, settings))


def renumbered(chunks: DataFrame) -> DataFrame:
    """Chunks that have a vector, numbered anew from 0 in each document."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.where(F.size("embedding") > 0).withColumn("chunk_index", F.row_number().over(order) - 1)


def ingest(docs: DataFrame, model: Embedder, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, report); report(doc_id, n_chunks, error) has a row for every document."""
    chunks = embed_chunks(chunk(docs, settings), model, settings)
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    report = docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("n_chunks").isNull(), "no chunk could be embedded").alias("error")
    )
    return chunks, report


def ingest_sections(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section tree, report): the section-tree way in, without chunks or vectors."""
    tree = sections.build_sections(docs)
    counts = tree.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    report = docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("n_chunks").isNull(), "no section").alias("error")
    )
    return tree, report


METHODS = ("hybrid", "pageindex", "both")


def dispatch(docs: DataFrame, method: str, model: Embedder, settings: Settings = DEFAULTS) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(chunks, section tree, merged counts) of an ingest by chunks and vectors, by section trees, or both.

    Chunks and errors of both ways add up; ``successful`` is the larger of the two.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    chunks = tree = None
    reports = []
    if method in ("hybrid", "both"):
        chunks, report = ingest(docs, model, settings)
        reports.append(totals(report))
    if method in ("pageindex", "both"):
        tree, report = ingest_sections(docs)
        reports.append(totals(report))
    counts = reports[0] if len(reports) == 1 else reports[0].unionByName(reports[1])
    return chunks, tree, counts.agg(F.max("successful").alias("successful"), F.sum("errors").alias("errors"), F.sum("chunks").alias("chunks"))


def totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))


def batches(docs: DataFrame, key: str, size: int) -> DataFrame:
    """Batch numbers from 1 in key order: positions inside range partitions plus the partitions' offsets.

    The numbered rows are checkpointed: both readers below see the same partitions, also after a retry.
    """
    ordered = materialise(docs.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    # one row for each partition
    offset = counts.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    at = ordered.join(F.broadcast(offset), "_p").withColumn("_n", F.col("_i") - F.col("_first") + F.col("_off"))
    return at.withColumn("batch", F.floor(F.col("_n") / size) + 1).drop("_p", "_i", "_n", "_off", "_first")
