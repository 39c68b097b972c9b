"""Shapes of search results as they are handed out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import preview, source_url

SEARCH_CHARS, LONG_CHARS = 200, 500


def _or(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def search_results(hits: DataFrame, most: int = SEARCH_CHARS, base: str = DEFAULTS.DOCS_BASE_URL) -> DataFrame:
    """hits(query_id, rank, score, content, metadata map) -> result rows.

    The document id is the metadata's, else the file, else "unknown"; the title the metadata's, else
    the category; the URL exists for the one source with public documentation.
    """
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    file = _or(meta("file"))
    return hits.select(
        "query_id", "rank", "score", preview(F.col("content"), most).alias("content"), F.coalesce(_or(meta("document_id")), file, F.lit("unknown")).alias("document_id"),
        _or(meta("title"), meta("category")).alias("title"), source_url(F.coalesce(meta("source"), F.lit("")), F.coalesce(file, F.lit("")), base).alias("url"), file.alias("file_path"),
    )


def section_results(hits: DataFrame, most: int = LONG_CHARS) -> DataFrame:
    """Section hits with shortened contents; a missing section title or node id is empty."""
    return hits.withColumns({"content": preview(F.col("content"), most), "section_title": F.coalesce("section_title", F.lit("")), "node_id": F.coalesce("node_id", F.lit(""))})
