"""Operator 3: mixing sources to target weights by subset-sum budget fitting.

1. Sizes and source totals come from grouped counts. Sources in code-point order (null last) weigh
   5, 2, 1, repeating, and share 150 % of all words; a target is cut at twice its source's words and
   the excess is shared again by weight until none is above.
2. A source's documents are counted by exact length; each may be taken up to twice. Every length first
   takes the same share of its copies, rounded so that at most ``FINE`` words remain; a target below that
   starts from nothing. The remaining budget is fitted by a bounded-knapsack dynamic programme over
   the copies left, to the nearest sum on either side.
3. In each (source, length) the copies go round the documents in order of a seeded hash. Ranks are exact but
   computed in 256 hash buckets with offsets from their counts, so a length or a group of copies
   holding a third of all rows never meets in one task.

Only histograms (one row for each source and distinct length) reach a grouped Python function.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 are taken with 0 words; an empty table gives no rows; repeated ids and rows each
count as documents; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED, BUCKETS = 1.5, 2, 20_240_501, 256
#: Budget, in words, that is left to the dynamic programme; sums up to twice that are looked at.
FINE = 65_536


def targets(sizes: np.ndarray, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Targets of sources in order; the excess over ``most`` times a source is shared again by weight."""
    w = np.resize(np.array(weights), len(sizes))
    caps, out = most * sizes.astype(float), np.zeros(len(sizes))
    free, budget = np.ones(len(sizes), dtype=bool), share * float(sizes.sum())
    while free.any():
        part = budget * w / w[free].sum()
        over = free & (part > caps)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = caps[over]
        budget -= caps[over].sum()
        free &= ~over
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, fine: int = FINE) -> np.ndarray:
    """How many copies of each size to take (at most its count) for the sum of words nearest to ``budget``.

    If the budget is at most ``fine``, no choice is nearer; else none with the same shares as start.
    """
    take = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    share = max(0, budget - fine) / total
    take = np.floor(counts * share).astype(np.int64)
    rest = budget - int((take * sizes).sum())
    # what rounding down lost goes back, a copy of each length in order of the loss, until ``fine`` words remain
    for i in np.argsort(take - counts * share, kind="stable").tolist():
        if rest - int(sizes[i]) < fine:
            continue
        if take[i] < counts[i] and sizes[i]:
            take[i] += 1
            rest -= int(sizes[i])
    # bounded knapsack: reachable sums up to 2 * rest (beyond that, nothing is nearer) as bits; each sum
    # remembers the part that first reached it
    most = 2 * rest
    bits, mask = 1, (1 << (most + 1)) - 1
    parts: list[tuple[int, int]] = []
    by = np.full(most + 1, -1, dtype=np.int32)
    for i in np.argsort(-(counts - take) * sizes, kind="stable").tolist():
        size, spare = int(sizes[i]), int(counts[i] - take[i])
        if not size or size > most:
            continue
        spare, piece = min(spare, most // size), 1
        while spare > 0:
            m = min(piece, spare)
            new = (bits << (m * size)) & mask & ~bits
            if new:
                at = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
                by[np.flatnonzero(at[: most + 1])] = len(parts)
                parts.append((i, m))
                bits |= new
            spare -= m
            piece *= 2
        if bits >> rest & 1:
            break
    reached = np.flatnonzero(by >= 0)
    reached = np.append(reached, 0)
    at = int(reached[np.argmin(np.abs(reached - rest))])
    while at:
        i, m = parts[by[at]]
        take[i] += m
        at -= m * int(sizes[i])
    return take


def _plan(share: float, most: float, weights: tuple[float, ...]):
    def source_targets(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src", key=lambda s: s.map(lambda v: (v[:1] != "s", v.encode()))).reset_index(drop=True)
        pdf["target"] = targets(pdf["source_size"].to_numpy(np.int64), share, most, weights)
        return pdf[["src", "source_size", "target"]]

    return source_targets


def _fit_source(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        n = pdf["n"].to_numpy(np.int64)
        copies = fit(pdf["size"].to_numpy(np.int64), most * n, round(float(pdf["target"].iloc[0])))
        pdf["passes"], pdf["n_take"] = copies // n, copies % n
        return pdf[["src", "size", "source_size", "target", "passes", "n_take"]]

    return run


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per document."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("src"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            h.alias("h"),
            F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"),
        )
    )
    bucketed = sized.groupBy("src", "size", "bucket").agg(F.count("*").alias("n"))
    hist = sized.groupBy("src", "size").agg(F.count("*").alias("n"))
    total = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    goal = total.withColumn("every", F.lit(0)).groupBy("every").applyInPandas(_plan(share, most, weights), "src string, source_size long, target double")
    plan = hist.join(goal, "src").groupBy("src").applyInPandas(
        _fit_source(most), "src string, size long, source_size long, target double, passes long, n_take long"
    )
    before = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id")) + F.col("offset")
    ranked = sized.join(offsets.join(plan, ["src", "size"]), ["src", "size", "bucket"])
    copies = (F.col("passes") + F.when(rank <= F.col("n_take"), 1).otherwise(0)).cast("long")
    return ranked.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; every row of a repeated id gets the id's most copies."""
    taken = mix(docs, **options).where("copies > 0")
    copies = taken.groupBy(F.col("doc_id").alias("__tessera_id")).agg(F.max("copies").cast("int").alias("__tessera_copies"))
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies["__tessera_id"]))
    repeated = joined.select(F.struct(*[docs[c] for c in docs.columns]).alias("__tessera_row"), F.explode(F.sequence(F.lit(1), copies["__tessera_copies"])))
    return repeated.select("__tessera_row.*")


def source_targets(docs: DataFrame, **options) -> DataFrame:
    """``(source, source_size, target, taken)``, one row per source."""
    return mix(docs, **options).groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))


#: DuckDB: a source's target is its cap or its weight times the level at which all targets sum up to the budget.
ORACLE = f"""
with s as (select source, sum(case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end)::bigint as source_size from documents group by source),
 o as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as w, {MOST}.0::double * source_size as cap from s),
 r as (select *, {SHARE}::double * sum(source_size) over () as budget, sum(w) over () as ws, coalesce(sum(cap) over f, 0) as capped, coalesce(sum(w) over f, 0) as cw
   from o window f as (order by cap / w, source rows between unbounded preceding and 1 preceding)),
 l as (select arg_min((budget - capped) / (ws - cw), cap / w) filter ((budget - capped) / (ws - cw) <= cap / w) as level from r)
select source, source_size, round(least(cap, coalesce(level * w, cap)), 6) as target from r, l
"""
