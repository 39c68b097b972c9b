"""Joins of two sets of texts by their distinct words and by exact phrases.

Texts are collapsed to distinct lower-case ones with their count first, so copies meet nothing twice. Only words that the
asking side holds (the vocabulary) travel on; the other words of a text count in its size alone.

- ``overlaps``: Jaccard similarity of every pair that shares a word, for sums over all pairs: the others add 0. Texts
  are dealt by their digest before the vocabulary is looked up, so counting a pair's shared words needs no exchange of pairs.
- ``similar``: pairs at a threshold ``t``, by prefix filter. With rare words first, two sets of Jaccard ``t`` share one of the first
  ``n - ceil(t n) + 1`` words of each. Words outside the vocabulary are the rarest of all: they fill a text's prefix
  first, and most texts drop out there.
- ``phrase_hits``: texts that hold a phrase. A word of the phrase with other characters on both sides is a whole word
  of the text as well, so the rarest such word chooses the candidates, which are then searched. Phrases without
  one (one or two words, or none) are a stated query set against all distinct texts, in blocks.

Defined results: null texts are no texts; an empty text has no words and similarity 0 with everything, but holds the empty
phrase; repeated rows count as often as they occur. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, all_matches, word_set
from ..sources.shared import as_parquet
from .pipelines import against_all

#: Bytes of vocabulary rows that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows (text, word) that a task groups by text.
TASK_ROWS = 2_000_000


def _small(df: DataFrame, column: str, limit: int) -> DataFrame:
    """df, marked for broadcast if its rows are known to fit."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(column) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def classes(rows: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """``(id, text, n, words[, least])``: distinct lower-case texts with a digest, their rows, words and smallest key; split and written once."""
    extra = [F.min(key).alias("least")] if key else []
    found = rows.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.count("*").alias("n"), *extra)
    return as_parquet(found.select(F.unhex(F.md5("text")).alias("id"), "text", "n", word_set(F.col("text")).alias("words"), *(["least"] if key else [])))


def word_rows(texts: DataFrame) -> DataFrame:
    """``(id, n, size, word)``, one row a distinct word."""
    return texts.select("id", "n", F.size("words").alias("size"), F.explode("words").alias("word"))


def _jaccard(both: Column, a: Column, b: Column) -> Column:
    return both / (a + b - both)


def overlaps(texts: DataFrame, asked: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(asked_id, id, n, score)`` of all pairs of classes that share a word; n: rows of the text."""
    words = word_rows(asked).select(F.col("id").alias("asked_id"), F.col("size").alias("asked_size"), "word")
    dealt = word_rows(texts.select("id", "n", "words").repartition("id"))
    pairs = dealt.join(_small(words, "word", broadcast_bytes), "word").groupBy("id", "asked_id").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("size").alias("size"), F.first("asked_size").alias("asked_size"))
    return pairs.select("asked_id", "id", "n", _jaccard(F.col("both"), F.col("size"), F.col("asked_size")).alias("score"))


def _prefixes(sets: DataFrame, t: float) -> DataFrame:
    """``(id, word)``: what is left of each prefix after the words outside the vocabulary."""
    outside = F.col("size") - F.size("held")
    places = F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1 - outside
    chosen = sets.where(places > 0).select("id", F.slice(F.array_sort("held"), F.lit(1), F.greatest(places, F.lit(0)).cast("int")).alias("first"))
    return chosen.select("id", F.explode("first.word").alias("word"))


def prefix_candidates(texts: DataFrame, asked: DataFrame, t: float, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``(asked_id, id)`` that share a prefix word, and the sets ``(id, size, held)`` of both sides."""
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    mine = as_parquet(word_rows(asked))
    vocabulary = mine.select("word").distinct()
    postings = as_parquet(word_rows(texts).join(_small(vocabulary, "word", broadcast_bytes), "word"))
    df = vocabulary.join(postings.groupBy("word").agg(F.count("*").alias("df")), "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
    order = _small(df, "word", broadcast_bytes)

    def sets(rows: DataFrame) -> DataFrame:
        # a task's share stays the same however many rows there are
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS + 1)
        dealt = rows.repartition(n, "id").join(order, "word")
        return as_parquet(dealt.groupBy("id").agg(F.first("size").alias("size"), F.collect_list(F.struct("df", "word")).alias("held")))

    left, right = sets(mine), sets(postings)
    met = _prefixes(left, t).select(F.col("id").alias("asked_id"), "word").join(_prefixes(right, t), "word")
    return met.select("asked_id", "id").distinct(), left, right


def similar(texts: DataFrame, asked: DataFrame, t: float, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(asked_id, id, score)`` of all pairs of classes with Jaccard similarity ``t`` or more."""
    pairs, left, right = prefix_candidates(texts, asked, t, broadcast_bytes)
    sizes = [left.select(F.col("id").alias("asked_id"), F.col("size").alias("asked_size")), right.select("id", "size")]
    fits = F.least("size", "asked_size") >= F.greatest("size", "asked_size") * t - 1e-9
    pairs = as_parquet(pairs.join(sizes[0], "asked_id").join(sizes[1], "id").where(fits))
    # only the sets of pairs that fit travel
    left = left.select(F.col("id").alias("asked_id"), F.col("held.word").alias("asked_held")).join(pairs.select("asked_id").distinct(), "asked_id", "left_semi")
    right = right.select("id", F.col("held.word").alias("held")).join(pairs.select("id").distinct(), "id", "left_semi")
    both = F.size(F.array_intersect("held", "asked_held"))
    found = pairs.join(left, "asked_id").join(right, "id")
    return found.select("asked_id", "id", _jaccard(both, F.col("size"), F.col("asked_size")).alias("score")).where(F.col("score") >= t)


def inner_words(phrase: Column) -> Column:
    """Distinct words of a phrase that have other characters on both sides."""
    words = all_matches(phrase, WORD)
    head, tail = F.regexp_like(phrase, F.lit(f"^{WORD}")).cast("int"), F.regexp_like(phrase, F.lit(f"{WORD}$")).cast("int")
    return F.array_distinct(F.slice(words, head + 1, F.greatest(F.size(words) - head - tail, F.lit(0))))


def phrase_candidates(texts: DataFrame, asked: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(asked_id, id)``: for every phrase with an inner word the texts that hold the rarest one."""
    words = asked.select(F.col("id").alias("asked_id"), F.explode(inner_words(F.col("text"))).alias("word"))
    postings = as_parquet(word_rows(texts).join(_small(words.select("word").distinct(), "word", broadcast_bytes), "word").select("id", "word"))
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    # a phrase with a word that no text holds is in none
    rarest = words.join(df, "word", "left").groupBy("asked_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r")).select("asked_id", F.col("r.word").alias("word"))
    return postings.join(rarest, "word").select("asked_id", "id")


def phrase_hits(texts: DataFrame, asked: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(asked_id, id, n)`` of all pairs where the text holds the asked text as a substring."""
    phrases = asked.select(F.col("id").alias("asked_id"), F.col("text").alias("phrase"))
    held = texts.select("id", "n", "text")
    likely = phrase_candidates(texts, asked, broadcast_bytes).join(phrases, "asked_id").join(held, "id")
    short = phrases.where(F.size(inner_words(F.col("phrase"))) == 0)
    if not short.isEmpty():
        likely = likely.select("asked_id", "phrase", "id", "n", "text").unionByName(against_all(held, short.withColumnRenamed("asked_id", "query_id")).withColumnRenamed("query_id", "asked_id"))
    return likely.where(F.contains("text", F.col("phrase"))).select("asked_id", "id", "n")


def summary(docs: DataFrame, questions: DataFrame, text: str = "content", query: str = "query") -> DataFrame:
    """``(query_id, exact, best, mean)``: documents that hold the query, best and mean Jaccard similarity over all documents.

    A null query has 0, null and null; without documents there are no rows.
    """
    texts, asked = classes(docs, text), classes(questions, query)
    total = texts.agg(F.sum("n").alias("total")).where("total > 0")
    scores = overlaps(texts, asked).groupBy("asked_id").agg(F.max("score").alias("best"), F.sum(F.col("score") * F.col("n")).alias("added"))
    exact = phrase_hits(texts, asked).groupBy("asked_id").agg(F.sum("n").alias("exact"))
    by = asked.select(F.col("id").alias("asked_id")).join(scores, "asked_id", "left").join(exact, "asked_id", "left")
    # total is one row
    by = by.crossJoin(F.broadcast(total)).select("asked_id", F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("added", F.lit(0.0)) / F.col("total")).alias("mean"))
    rows = questions.select("query_id", F.unhex(F.md5(F.lower(query))).alias("asked_id")).crossJoin(F.broadcast(total.select()))
    return rows.join(by, "asked_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("exact"), F.lit(0)).cast("long").alias("exact"), F.max("best").alias("best"), F.avg("mean").alias("mean"))
