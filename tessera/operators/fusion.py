"""Fusing two rankings, heuristics, metadata boosts, and the hybrid search that joins them.

Options given to a call are honoured; both retrievers share one key, so no hit is matched by
position or by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import exact_phrase, overlap, quality, set_overlap, word_set
from ..sources.shared import materialise
from . import blocks, lexical, vector

METHODS = ("rrf", "weighted")


def _ranked(hits: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    every = Window.partitionBy("query_id")
    return hits.select(
        "query_id", "key", F.col("score").alias(f"{name}_score"), F.row_number().over(order).alias(f"{name}_rank"),
        F.count("*").over(every).alias(f"{name}_n"), F.max("score").over(every).alias(f"{name}_max"),
    )


def join_hits(vector_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """Full outer join of two hit lists (query_id, key, score), with rank, list length and maximum of each side."""
    joined = _ranked(vector_hits, "v").join(_ranked(lexical_hits, "b"), ["query_id", "key"], "full")
    every = Window.partitionBy("query_id")
    for side in ("v", "b"):
        # a row that one side lacks still needs that list's length
        joined = joined.withColumn(f"{side}_n", F.coalesce(F.max(f"{side}_n").over(every), F.lit(0)))
        joined = joined.withColumn(f"{side}_max", F.max(f"{side}_max").over(every))
    return joined


def reciprocal_rank(k: int = DEFAULTS.RRF_K) -> Column:
    """1/(k + rank) of both lists; a row missing from a list of n takes rank n + k there."""
    ranks = [F.coalesce(F.col(f"{s}_rank"), F.col(f"{s}_n") + k) for s in ("v", "b")]
    return 1.0 / (k + ranks[0]) + 1.0 / (k + ranks[1])


def weighted(alpha: float = DEFAULTS.HYBRID_SEARCH_ALPHA) -> Column:
    """alpha * vector + (1 - alpha) * lexical, each over its list's maximum; missing or unscaled sides are 0."""
    scaled = [F.when(F.col(f"{s}_max") > 0, F.coalesce(F.col(f"{s}_score"), F.lit(0.0)) / F.col(f"{s}_max")).otherwise(0.0) for s in ("v", "b")]
    return alpha * scaled[0] + (1 - alpha) * scaled[1]


def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, method: str = "rrf", alpha: float = DEFAULTS.HYBRID_SEARCH_ALPHA, k: int = DEFAULTS.RRF_K) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"fusion method must be one of {METHODS}")
    score = reciprocal_rank(k) if method == "rrf" else weighted(alpha)
    return join_hits(vector_hits, lexical_hits).select("query_id", "key", score.alias("score"))


def heuristic_factor(query: Column, content: Column, exact_boost: float = 0.2, overlap_boost: float = 0.15) -> Column:
    exact = F.when(exact_phrase(query, content), exact_boost).otherwise(0.0)
    return (1 + exact + overlap_boost * overlap(query, content)) * quality(content)


def metadata_factor(timestamp: Column, source: Column, as_of: Column, recency_weight: float = 0.1, source_quality: dict[str, float] | None = None) -> Column:
    """1 + recency + source weight. Age is in whole days and never negative; a missing timestamp adds nothing."""
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(timestamp)) / 86_400_000_000))
    recency = F.coalesce(recency_weight / (1 + days / 30.0), F.lit(0.0))
    weights = F.create_map(*[F.lit(x) for kv in (source_quality or {}).items() for x in kv]) if source_quality else None
    extra = F.coalesce(F.try_element_at(weights, source), F.lit(0.0)) if weights is not None else F.lit(0.0)
    return 1 + recency + extra


def hybrid_search(
    chunks: DataFrame, vectors: DataFrame, index: lexical.LexicalIndex | lexical.Texts | blocks.BlockIndex, queries: DataFrame, k: int = DEFAULTS.TOP_K_RESULTS,
    method: str = "rrf", heuristics: bool = True, rerank=None, boost: dict | None = None, as_of: Column | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Top k chunks of each query: both retrievers over-fetch (3k before a reranker, else 2k), fuse, re-score, cut.

    chunks(key, content[, timestamp, source]); vectors(key, embedding); queries(query_id, query, embedding).
    """
    fetch = k * (3 if rerank else 2)
    by_words = blocks.search if isinstance(index, blocks.BlockIndex) else lexical.search
    fused = fuse(vector.search(vectors, queries, fetch), by_words(index, queries, fetch), method, settings.HYBRID_SEARCH_ALPHA, settings.RRF_K)
    asked = queries.select("query_id", "query")
    if heuristics:
        # a chunk's words and quality are worked out once for all queries that it answers, a query's words once for all its chunks
        fused = materialise(fused)
        chunks = chunks.join(fused.select("key").distinct(), "key", "left_semi")
        chunks = materialise(chunks.withColumns({"_low": F.lower("content"), "_words": word_set(F.col("content")), "_quality": quality(F.col("content"))}))
        asked = materialise(asked.withColumns({"_phrase": F.lower("query"), "_asked": word_set(F.col("query"))}))
    rows = fused.join(chunks, "key").join(asked, "query_id")
    if heuristics:
        boost = {"recency_weight": 0.1, "source_quality": {}, "exact_match_boost": 0.2} | (boost or {})
        exact = F.when(F.contains("_low", F.col("_phrase")), boost["exact_match_boost"]).otherwise(0.0)
        score = F.col("score") * (1 + exact + 0.15 * set_overlap(F.col("_asked"), F.col("_words"))) * F.col("_quality")
        if {"timestamp", "source"} <= set(chunks.columns) and as_of is not None:
            score = score * metadata_factor(F.col("timestamp"), F.col("source"), as_of, boost["recency_weight"], boost["source_quality"])
        rows = rows.withColumn("score", score)
    best = lexical.top_k(rows.drop("_low", "_words", "_quality", "_phrase", "_asked"), fetch if rerank else k)
    return rerank(best, k) if rerank else best
