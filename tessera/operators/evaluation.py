"""Retrieval metrics, judge scores and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits, json_score
from ..models import Llm, complete

CONTEXT_CHUNKS, ANSWER_CHARS, PREVIEW_CHARS = 5, 1500, 200


def retrieval_metrics(ranked: DataFrame, terms: Column, k: int) -> DataFrame:
    """Per query over hits(query_id, rank, content): precision at k (over k, not over hits), mean term hits, coverage, missing."""
    top = ranked.where(F.col("rank") <= k).withColumn("_terms", terms).withColumn("_hits", hits(F.col("content"), F.col("_terms")))
    got = top.groupBy("query_id").agg(
        (F.count_if(F.size("_hits") > 0) / k).alias("precision"), (F.sum(F.size("_hits")) / k).alias("term_coverage"),
        F.array_distinct(F.flatten(F.collect_list("_hits"))).alias("found"), F.first("_terms").alias("_terms"),
    )
    coverage = F.when(F.size("_terms") > 0, F.size("found") / F.size("_terms")).otherwise(0.0)
    return got.select("query_id", "precision", "term_coverage", coverage.alias("coverage"), F.array_except("_terms", "found").alias("missing"))


def overall(faithfulness: Column, relevance: Column, context: Column) -> Column:
    return F.round(0.4 * faithfulness + 0.4 * relevance + 0.2 * context, 4)


def judge(answers: DataFrame, model: Llm) -> DataFrame:
    """answers(query, answer, context array): three judged scores and the weighted overall score."""
    context = F.array_join(F.slice("context", 1, CONTEXT_CHUNKS), "\n\n")
    previews = F.array_join(F.transform(F.slice("context", 1, CONTEXT_CHUNKS), lambda c: F.substring(c, 1, PREVIEW_CHARS)), "\n\n")
    answer = F.substring("answer", 1, ANSWER_CHARS)

    def ask(what: str, *parts: Column) -> Column:
        return json_score(complete(F.concat_ws("\n", F.lit("TASK judge"), F.lit(what), *parts), model))

    scored = answers.select(
        "*", ask("Is the answer supported by the context?", F.col("query"), answer, context).alias("faithfulness"),
        ask("Does the answer address the question?", F.col("query"), answer).alias("relevance"), ask("Does the context fit the question?", F.col("query"), previews).alias("context_relevance"),
    )
    return scored.withColumn("overall", overall(F.col("faithfulness"), F.col("relevance"), F.col("context_relevance")))


def category_means(rows: DataFrame, category: str, *metrics: str) -> DataFrame:
    """Count and null-skipping means by category."""
    return rows.groupBy(category).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def best_configs(runs: DataFrame, name: str = "config") -> DataFrame:
    """Most precise, fastest and best balanced (precision - latency in seconds) run."""
    balance = F.col("precision") - F.col("latency_ms") / 1000
    return runs.agg(F.max_by(name, "precision").alias("most_precise"), F.min_by(name, "latency_ms").alias("fastest"), F.max_by(name, balance).alias("balanced"))


def means_by(runs: DataFrame, *keys: str) -> DataFrame:
    """Mean precision and latency by each key on its own (grouping sets): one row for each key's value."""
    return runs.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.avg("precision").alias("precision"), F.avg("latency_ms").alias("latency_ms"))
