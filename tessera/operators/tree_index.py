"""An index over section trees: each question's best documents are found without reading every tree.

A section scores the sum of idf over the question's tokens that its own text (heading and body) holds; a document scores as its best
section. ``postings(token, doc_id, nodes)`` has one row per document and token with the sections that hold it. Summed over a
whole tree, the idf of the tokens that it holds anywhere bounds what any section in it can score; that takes two columns of the postings.
The documents of largest bound are scored by section first; the k-th of them rules out every document whose bound stays below
it, so the result is that of scoring all sections (``search_all``).

Ties at nine decimals fall to the smaller doc_id, then node_id. Defined results: document ids must be unique and not null (``ValueError``);
null or empty questions and questions without a known token get no rows; a document without text has its one section and no postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import snapshots
from ..sources.shared import as_parquet
from . import lexical, sections

#: Documents, in numbers of k, that are scored before the bounds prune.
LEAD = 4
#: Bounds this close below the k-th score are kept: sums may differ in their last digits.
ROOM = 1e-8
#: Rows of (question, token) or (question, document) that are broadcast, under 100 bytes each unless a token is very long.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class TreeIndex:
    postings: DataFrame
    terms: DataFrame

    def save(self, path: str) -> None:
        snapshots.commit(self.terms.sparkSession, path, replace={"postings": self.postings, "terms": self.terms})


def load(spark: SparkSession, path: str, version: int | None = None) -> TreeIndex:
    pinned = snapshots.open_snapshot(spark, path, version)
    return TreeIndex(pinned.read("postings"), pinned.read("terms"))


def build(docs: DataFrame) -> TreeIndex:
    """Index of docs(doc_id, title, content)."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n != ids:
        raise ValueError("document ids must be unique and not null")
    texts = sections.section_text(docs, sections.build_sections(docs))
    marked = F.concat("tokens", F.array(F.lit(None).cast("string")))
    rows = as_parquet(lexical.with_tokens(texts.select("doc_id", "node_id", "content")).select("doc_id", "node_id", F.explode(marked).alias("token")))
    count = rows.where("token is null").agg(F.count("*").alias("n"))
    grouped = rows.where("token is not null").groupBy("token", "doc_id").agg(F.collect_list("node_id").alias("nodes"))
    postings = as_parquet(grouped.sortWithinPartitions("token"))
    df = postings.groupBy("token").agg(F.sum(F.size("nodes")).alias("df"))
    # one row
    terms = df.crossJoin(F.broadcast(count)).select("token", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return TreeIndex(postings, as_parquet(terms))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _weighted(index: TreeIndex, queries: DataFrame, text: str) -> DataFrame:
    """``(query_id, token, idf)`` of the questions' known tokens."""
    wanted = queries.select("query_id", F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    return as_parquet(index.terms.select("token", "idf").join(_small(wanted), "token"))


def bounds(index: TreeIndex, weighted: DataFrame) -> DataFrame:
    """``(query_id, doc_id, bound)`` of all documents that share a token with a question."""
    held = index.postings.select("token", "doc_id").join(_small(weighted), "token")
    return held.groupBy("query_id", "doc_id").agg(F.sum("idf").alias("bound"))


def _scored(index: TreeIndex, weighted: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``(query_id, doc_id, node_id, score)``: the best section of each of the pairs, or of all."""
    found = index.postings.join(_small(weighted), "token")
    if pairs is not None:
        found = found.join(_small(pairs.select("query_id", "doc_id")), ["query_id", "doc_id"])
    per_section = found.select("query_id", "doc_id", "idf", F.explode("nodes").alias("node_id")).groupBy("query_id", "doc_id", "node_id").agg(F.round(F.sum("idf"), 9).alias("score"))
    best = per_section.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("under"), "node_id")).alias("best"))
    return best.select("query_id", "doc_id", "best.node_id", (-F.col("best.under")).alias("score"))


def search_all(index: TreeIndex, queries: DataFrame, k: int = 5, text: str = "query") -> DataFrame:
    """As ``search``, but every section that shares a token is scored."""
    return lexical.top_k(_scored(index, _weighted(index, queries, text), None), k, key="doc_id")


def candidates(index: TreeIndex, weighted: DataFrame, k: int, lead: int = LEAD) -> tuple[DataFrame, DataFrame]:
    """All pairs with their bounds, and those that may be among a question's k best."""
    known = as_parquet(bounds(index, weighted))
    first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "doc_id")
    leads = known.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k * lead)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = _scored(index, weighted, leads).withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("query_id", F.col("score").alias("kth"))
    return known, known.join(_small(kth), "query_id", "left").where(f"kth is null or bound >= kth - {ROOM}").drop("kth")


def search(index: TreeIndex, queries: DataFrame, k: int = 5, text: str = "query", lead: int = LEAD) -> DataFrame:
    """``(query_id, doc_id, node_id, score, rank)``: the k documents of best score for each question, each with its best section."""
    weighted = _weighted(index, queries, text)
    _, possible = candidates(index, weighted, k, lead)
    return lexical.top_k(_scored(index, weighted, as_parquet(possible)), k, key="doc_id")
