"""Section trees of markdown documents as flat tables.

Headings are lines of a document; the tree is a fold over a document's headings in order. Headings
inside code fences count as headings, text before the first heading belongs to no section, and a
section ends where the next heading of any level starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ensure_h1, lines

HEADING = r"^(#{1,6})\s+(.*\S)\s*$"


def with_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, title, content) with ``lines`` and a heading first."""
    return docs.withColumn("lines", lines(ensure_h1(F.col("title"), F.col("content"))))


def headings(docs_with_lines: DataFrame) -> DataFrame:
    at = docs_with_lines.select("doc_id", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    return at.where(F.regexp_like("line", F.lit(HEADING))).select(
        "doc_id", "n_lines", (F.col("pos") + 1).alias("line_start"), level.alias("level"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title")
    )


def dotted_ids(levels: Column) -> Column:
    """Node ids ``1``, ``1.1``, ... for heading levels in order, as one fold.

    State: levels of the open headings, the number of each among its siblings, ids so far. A heading
    closes all open ones of its level or deeper; it then counts up the slot of its depth.
    """
    kind = "struct<open:array<int>,counts:array<int>,ids:array<string>>"
    empty = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("counts"), F.array().cast("array<string>").alias("ids")).cast(kind)

    def step(s: Column, level: Column) -> Column:
        above = F.filter(s["open"], lambda x: x < level)
        depth = F.size(above)
        counts = F.concat(F.slice(s["counts"], F.lit(1), depth), F.array(F.coalesce(F.try_element_at(s["counts"], depth + 1), F.lit(0)) + 1))
        node = F.array_join(counts.cast("array<string>"), ".")
        return F.struct(F.concat(above, F.array(level)).alias("open"), counts.alias("counts"), F.concat(s["ids"], F.array(node)).alias("ids")).cast(kind)

    return F.aggregate(levels, empty, step)["ids"]


def build_sections(docs: DataFrame) -> DataFrame:
    """``(doc_id, node_id, parent_id, depth, level, title, line_start, line_end, ord)``."""
    prepared = with_lines(docs)
    found = headings(prepared)
    order = Window.partitionBy("doc_id").orderBy("line_start")
    spans = found.withColumn("line_end", F.coalesce(F.lead("line_start").over(order) - 1, F.col("n_lines")))
    item = F.struct("line_start", "line_end", "level", "title")
    trees = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("nodes"))
    trees = trees.withColumn("ids", dotted_ids(F.transform("nodes", lambda n: n["level"])))
    flat = trees.select("doc_id", F.posexplode(F.arrays_zip("nodes", "ids")).alias("ord", "x"))
    named = flat.select("doc_id", F.col("x.ids").alias("node_id"), "x.nodes.level", "x.nodes.title", "x.nodes.line_start", "x.nodes.line_end", (F.col("ord") + 1).alias("ord"))
    bare = prepared.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit("1").alias("node_id"), F.lit(1).alias("level"), F.lit("Document").alias("title"), F.lit(1).alias("line_start"), F.size("lines").alias("line_end"), F.lit(1).alias("ord")
    )
    rows = named.unionByName(bare)
    parent = F.regexp_extract("node_id", r"^(.*)\.\d+$", 1)
    return rows.withColumn("parent_id", F.nullif(parent, F.lit(""))).withColumn("depth", F.size(F.split("node_id", r"\.")) - 1)


def section_text(docs: DataFrame, sections: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Text of sections; wanted(doc_id, node_id) picks some, unknown ids drop out."""
    picked = sections if wanted is None else sections.join(wanted, ["doc_id", "node_id"], "left_semi")
    body = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return picked.join(with_lines(docs).select("doc_id", "lines"), "doc_id").withColumn("content", body).drop("lines")


def toc(sections: DataFrame, with_nodes: bool = False) -> DataFrame:
    """One table of contents per document, two blanks of indent for each depth, in document order; ``nodes``, if asked for: its node ids."""
    line = F.format_string("%s[%s] %s (lines %d-%d)", F.repeat(F.lit("  "), F.col("depth")), "node_id", "title", "line_start", "line_end")
    return sections.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("toc"),
        F.count("*").alias("n_sections"), *([F.collect_list("node_id").alias("nodes")] if with_nodes else []),
    )


def rank_sections(choices: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """choices(query_id, doc_id, doc_ord, ids) -> the k best sections of each query.

    The i-th id (from 0) scores max(0.1, 1 - 0.1 i), ids that no section has included in the count but
    not in the result; ties keep document order, then the order of the ids.
    """
    listed = choices.select("query_id", "doc_id", "doc_ord", F.posexplode("ids").alias("pos", "node_id"))
    # ranked by keys alone: only the k best of a query meet the sections' other columns
    known = listed.join(sections.select("doc_id", "node_id"), ["doc_id", "node_id"])
    return _best_sections(known, k).join(sections, ["doc_id", "node_id"])


def _best_sections(known: DataFrame, k: int) -> DataFrame:
    scored = known.withColumn("score", F.greatest(F.lit(0.1), 1 - 0.1 * F.col("pos")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_ord", "pos")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def rank_replies(replies: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """``rank_sections`` of replies(query_id, doc_id, doc_ord, ids, nodes) where ``nodes`` are all of the document's node ids: ids that no
    section has drop out row by row, so replies to every document are not joined with the sections."""
    listed = replies.select("query_id", "doc_id", "doc_ord", F.posexplode(F.transform("ids", lambda i: F.when(F.array_contains("nodes", i), i))).alias("pos", "node_id"))
    return _best_sections(listed.where("node_id is not null"), k).join(sections, ["doc_id", "node_id"])
