"""Counters, histograms, percentiles, ingest and error reports as aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SEARCH_BUCKETS


def counter(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, value: str, buckets: tuple[float, ...], *labels: str) -> DataFrame:
    """Cumulative ``le`` buckets in one pass, with +Inf, sum and count: (labels, le, n, total, count)."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)]
    got = events.groupBy(*labels).agg(*aggs, F.count(value).alias("count"), F.sum(value).alias("total"))
    rows = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return got.select(*labels, F.explode(F.array(*rows)).alias("_x"), "total", "count").select(*labels, "_x.le", "_x.n", "total", "count")


def order_statistics(events: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], *labels: str, buckets: int = 256) -> DataFrame:
    """(labels, n, min, max, one column for each name): the value at 0-based place ``places[name](n)`` of each label's sorted values.

    Values are counted in ``buckets`` equal ranges between a label's extremes; only the ranges that
    hold a wanted place are counted value by value, so no task sorts a label's values.
    """
    from pyspark.sql import Window

    known = events.where(F.col(value).isNotNull()).select(*labels, F.col(value).alias("_v"))
    span = known.groupBy(*labels).agg(F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    on = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in labels]
    width = F.col("max") - F.col("min")
    place = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("min")) / width * buckets))).otherwise(0)
    joined = known.alias("k").join(span.alias("s"), reduce(lambda a, b: a & b, on, F.lit(True)))
    dealt = joined.select(*[F.col(f"k.{c}").alias(c) for c in labels], "_v", place.cast("int").alias("_b"), "n")
    sizes = dealt.groupBy(*labels, "_b").agg(F.count("*").alias("_c"), F.max("n").alias("n"))
    before = Window.partitionBy(*labels).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("at")) for name, at in places.items()])
    asked = sizes.withColumn("_w", F.explode(wanted)).where("_w.at >= _before and _w.at < _before + _c").select(*[F.col(c).alias(f"_l_{c}") for c in labels], F.col("_b").alias("_wb"), "_before", "_w.name", "_w.at")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in labels], F.col("_b") == F.col("_wb"))
    counts = dealt.groupBy(*labels, "_b", "_v").agg(F.count("*").alias("_n")).join(asked, same)
    upto = Window.partitionBy(*labels, "_b", "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto)).where("_upto > at")
    picks = reached.groupBy(*labels).agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places])
    both = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in labels], F.lit(True))
    return span.alias("s").join(picks.alias("p"), both).select(*[F.col(f"s.{c}").alias(c) for c in labels], "n", "min", "max", *places)


def nearest_rank(events: DataFrame, value: str, shares: dict[str, float], *labels: str) -> DataFrame:
    """sorted[int(n * p)] of each label, and its extremes."""
    return order_statistics(events, value, {name: (lambda n, p=p: F.floor(n * p)) for name, p in shares.items()}, *labels)


def summary(events: DataFrame, value: str, *labels: str) -> DataFrame:
    """Mean, minimum, maximum, median (mean of the middle two) and sample deviation (0 for one value)."""
    deviation = F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(0.0)
    means = events.where(F.col(value).isNotNull()).groupBy(*labels).agg(F.avg(value).alias("mean"), deviation.alias("stdev"))
    middle = order_statistics(events, value, {"_a": lambda n: F.floor((n - 1) / 2), "_b2": lambda n: F.floor(n / 2)}, *labels)
    same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}")) for c in labels], F.lit(True))
    joined = means.alias("m").join(middle.alias("o"), same)
    return joined.select(*[F.col(f"m.{c}").alias(c) for c in labels], "mean", "min", "max", ((F.col("_a") + F.col("_b2")) / 2).alias("median"), "stdev")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def throughput(ingest: DataFrame) -> DataFrame:
    """ingest(doc_id, n_chunks, seconds, error) -> one row of counts and rates; rates over 0 are 0."""
    got = ingest.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")
    )
    return got.select(
        "*", ratio(F.col("documents"), F.col("seconds")).alias("docs_per_second"), ratio(F.col("chunks"), F.col("seconds")).alias("chunks_per_second"),
        ratio(F.col("chunks"), F.col("documents")).alias("chunks_per_doc"), ratio(F.col("errors"), F.col("documents")).alias("error_rate"),
    )


def compare_runs(runs: DataFrame, baseline: str, name: str = "run", seconds: str = "seconds") -> DataFrame:
    """Speed-up and time saved against one run; ``fastest`` marks the run with the least time (ties: first name)."""
    base = runs.where(F.col(name) == baseline).select(F.col(seconds).alias("_base"))
    best = runs.agg(F.min_by(name, F.struct(seconds, name)).alias("_best"))
    # one row each
    joined = runs.crossJoin(F.broadcast(base.limit(1))).crossJoin(F.broadcast(best))
    return joined.select(
        name, seconds, ratio(F.col("_base"), F.col(seconds)).alias("speedup"), ratio((F.col("_base") - F.col(seconds)) * 100, F.col("_base")).alias("saved_percent"), (F.col(name) == F.col("_best")).alias("fastest")
    )


def errors_by_type(errors: DataFrame, examples: int = 3) -> DataFrame:
    """Errors of each type with up to three examples (the first by document), for an investigation guide.

    The examples are the smallest (doc_idx, message) pairs, found by window rank, so a type's group is
    never collected.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("error_type").orderBy("doc_idx", "message")
    first = errors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= examples)
    shown = first.groupBy("error_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.substring("message", 1, 200).alias("m")))), lambda x: x["m"]).alias("examples"))
    return errors.groupBy("error_type").agg(F.count("*").alias("n")).join(shown, "error_type").orderBy(F.desc("n"), "error_type")


def cache_effect(events: DataFrame, hit: str, seconds: str) -> DataFrame:
    """Hit rate in percent, effective latency h * hit + (1 - h) * miss, and the gain over misses only."""
    got = events.agg(F.avg(F.col(hit).cast("double")).alias("h"), F.avg(F.when(F.col(hit), F.col(seconds))).alias("a"), F.avg(F.when(~F.col(hit), F.col(seconds))).alias("b"))
    h, a, b = (F.coalesce(F.col(c), F.lit(0.0)) for c in "hab")
    effective = h * a + (1 - h) * b
    return got.select((h * 100).alias("hit_rate"), effective.alias("effective_latency"), ratio(b, effective).alias("throughput_gain"))


def search_times(events: DataFrame, endpoint: str, seconds: str) -> DataFrame:
    """Only the search endpoint observes a search time, labelled ``hybrid``."""
    return histogram(events.where(F.col(endpoint) == "/search").withColumn("method", F.lit("hybrid")), seconds, SEARCH_BUCKETS, "method")


def session_counters(events: DataFrame, hit: str, documents: str, chunks: str, iterations: str, evaluated: str) -> DataFrame:
    """One row: cache hits and misses, documents and chunks ingested, agentic queries and evaluations."""
    return events.agg(
        F.count_if(F.col(hit)).alias("cache_hits_total"), F.count_if(~F.col(hit)).alias("cache_misses_total"), F.coalesce(F.sum(documents), F.lit(0)).alias("documents_ingested_total"),
        F.coalesce(F.sum(chunks), F.lit(0)).alias("chunks_created_total"), F.count(iterations).alias("agentic_queries_total"), F.count(evaluated).alias("evaluation_total"),
    )


def exposition(metric: str, rows: DataFrame, value: str, *labels: str) -> DataFrame:
    """Text lines ``metric{label="value",...} number`` of a counter or of a histogram's buckets."""
    inner = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(metric), F.lit("{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))


#: What helps, by the kinds of error that this engine's own tables hold (``load_errors``, the ingest report, refused records).
TIPS = (
    ("FileTooLarge", "Split the file before loading: a row holds one file whole, and the source refuses files over mostBytes."),
    ("FileNotFoundError", "The folder changed between listing and reading; load it again once its writer has finished."),
    ("PermissionError", "Executors read the files, not the driver: give their account read access."),
    ("UnicodeDecodeError", "Only UTF-8 is loaded; convert the file, or leave it out by its suffix."),
    ("no chunk could be embedded", "Every chunk was under the minimum length, or the embedder returned an empty vector for each."),
    ("no section", "The text has no heading and no line outside fences; check that it is Markdown."),
    ("ValueError", "The record lacks a title or a content of type string; nothing of its batch was ingested."),
)
OTHER_TIP = "No rule covers this kind; group the report by its message and reload one of the documents alone."


def tip(error_type: Column) -> Column:
    return F.coalesce(*[F.when(error_type == kind, text) for kind, text in TIPS], F.lit(OTHER_TIP))


def health(vectors: DataFrame | None, model_available: bool) -> dict[str, object]:
    """Status of the engine: healthy if the vector table can be read and the model answers."""
    try:
        ok = vectors is not None and vectors.limit(1).count() >= 0
    except Exception:  # noqa: BLE001  a table may be unreadable in any way
        ok = False
    return {"status": "healthy" if ok and model_available else "degraded", "vector_store_connected": ok, "llm_available": model_available}
