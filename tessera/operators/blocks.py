"""A stored lexical index in blocks with bounds: searches read their tokens' folders and skip blocks that cannot reach the top k.

A term frequency is 1 here, so a posting's part of a score is its token's idf times a factor that falls with the
chunk's length ``dl``. Postings of a token are dealt into bands of similar length and, within a band, by a hash of
the key into blocks of about ``BLOCK`` rows: ``blocks(bucket, part, token, band, seg, rows)``. One row a band,
``bands(bucket, part, token, band, n, min_dl, segs)``, has what a bound needs; none depends on idf or the mean length,
so appended parts leave the stored ones valid. A hot token is many blocks, never one group.

A search has three passes, all exact:
1. the rarest tokens' bands, up to ``LEAD`` postings a query, give partial scores; the k-th is a bound below
   the k-th full score;
2. in each band a query's tokens are taken by idf, from the smallest on, as long as all of them together stay below that
   bound: a chunk that holds only these cannot be among the k best. Blocks of the other tokens are read; a band
   without one is skipped;
3. chunks that may still reach the bound get the missing tokens by a join on (token, band, block), so that only the
   blocks that can hold them are opened.

Where the tokens' lists are short altogether (``DIRECT`` postings), one pass over all their blocks is cheaper; it gives the
same rows. Tables are stored by ``bucket``, a hash of the token; the buckets of a query batch, ``BUCKETS`` numbers at most, are a
filter on the folders. Ties at nine decimals fall to the smaller key, and bounds leave room for them. Defined results:
null and empty texts have no postings but count as chunks; keys must be unique and not null (a bound is one of a chunk), else
``build`` raises ``ValueError``; a key that another part has too is not noticed; queries without known tokens get no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..constants import PRESERVED_TERMS
from ..functions.text import tokens
from ..sources.shared import as_parquet, materialise
from . import lexical

BLOCK, BUCKETS, LEAD, STEP = 128, 64, 4096, 1.25
#: Postings of a query batch, counted before any is read, up to which bounds do not pay for their passes.
DIRECT = 50_000_000
#: Scores this close below a bound are kept: they may tie at nine decimals.
ROOM = 1e-8
#: Rows of (query, token, band) that are broadcast, about 100 bytes each.
BROADCAST_ROWS = 200_000
_TABLES = ("blocks", "bands", "corpus")


@dataclass(frozen=True)
class BlockIndex:
    blocks: DataFrame
    bands: DataFrame
    corpus: DataFrame
    buckets: int = BUCKETS

    def save(self, path: str) -> None:
        """One folder a bucket; ``append`` adds files to them."""
        _write(self, path, "errorifexists")


def _write(index: BlockIndex, path: str, mode: str) -> None:
    index.blocks.sortWithinPartitions("bucket", "token", "band").write.mode(mode).partitionBy("bucket").parquet(f"{path}/blocks")
    index.bands.repartition("bucket").sortWithinPartitions("bucket", "token", "band").write.mode(mode).partitionBy("bucket").parquet(f"{path}/bands")
    # last, as its presence says that the others are whole
    index.corpus.write.mode(mode).parquet(f"{path}/corpus")


def load(spark: SparkSession, path: str) -> BlockIndex:
    blocks, bands, parts = (spark.read.parquet(f"{path}/{t}") for t in _TABLES)
    # at most one row a part: blocks of a part that was not written to its end are not seen
    whole = F.broadcast(parts.select("part"))
    buckets = parts.agg(F.max("buckets")).first()[0]
    return BlockIndex(blocks.join(whole, "part", "left_semi"), bands.join(whole, "part", "left_semi"), parts, buckets)


def build(chunks: DataFrame, key: str = "chunk_id", text: str = "content", part: str = "0", buckets: int = BUCKETS, block: int = BLOCK) -> BlockIndex:
    """Index of chunks; ``part`` names them among the parts of one stored index."""
    n, keys = chunks.agg(F.count("*"), F.count_distinct(key)).first()
    if n != keys:
        raise ValueError("keys must be unique and not null")
    spark = chunks.sparkSession
    tokenised = lexical.with_tokens(chunks.select(F.col(key), F.col(text)), text)
    marked = F.concat("tokens", F.array(F.lit(None).cast("string")))
    made = as_parquet(tokenised.select(F.col(key).alias("key"), F.size("tokens").alias("dl"), F.explode(marked).alias("token")))
    corpus = lexical.statistics(made.where("token is null"))
    band = F.floor(F.log("dl") / math.log(STEP)).cast("int")
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    rows = made.where("token is not null").withColumn("band", band)
    bands = rows.groupBy("token", "band").agg(F.count("*").alias("n"), F.min("dl").alias("min_dl"))
    bands = as_parquet(bands.select(bucket.alias("bucket"), F.lit(part).alias("part"), "token", "band", "n", "min_dl", F.ceil(F.col("n") / block).cast("long").alias("segs")))
    # most bands are one block; the others, one in ``block`` postings at most, are few enough to be broadcast, or else joined
    several = _small(bands.where("segs > 1").select("token", "band", "segs"))
    dealt = rows.join(several, ["token", "band"], "left").withColumn("seg", F.coalesce(F.pmod(F.xxhash64("key"), F.col("segs")), F.lit(0).cast("long")))
    # dealt once for grouping and for writing: a folder gets up to ``lanes`` files
    lanes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    dealt = dealt.select(bucket.alias("bucket"), F.pmod(F.xxhash64("token", "band", "seg"), F.lit(lanes)).alias("lane"), "token", "band", "seg", "key", "dl").repartition("bucket", "lane")
    grouped = dealt.groupBy("bucket", "lane", "token", "band", "seg").agg(F.collect_list(F.struct("key", "dl")).alias("rows"))
    blocks = grouped.select("bucket", F.lit(part).alias("part"), "token", "band", "seg", "rows")
    return BlockIndex(blocks, bands, corpus.withColumns({"part": F.lit(part), "buckets": F.lit(buckets)}), buckets)


def append(path: str, chunks: DataFrame, part: str, **options) -> BlockIndex:
    """Adds chunks to a stored index as a part of its own; nothing stored is read again or rewritten."""
    parts = chunks.sparkSession.read.parquet(f"{path}/corpus")
    if parts.where(F.col("part") == part).count():
        raise ValueError(f"the index has a part {part}")
    _write(build(chunks, part=part, buckets=parts.agg(F.max("buckets")).first()[0], **options), path, "append")
    return load(chunks.sparkSession, path)


def _factor(dl, settings: Settings):
    k1, b = settings.BM25_K1, settings.BM25_B
    return (k1 + 1) / (1 + k1 * (1 - b + b * dl / F.col("avgdl")))


def _small(df: DataFrame) -> DataFrame:
    """The query side, broadcast if its counted rows allow."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _wanted(index: BlockIndex, queries: DataFrame, text: str, preserved) -> tuple[BlockIndex, DataFrame]:
    """``(query_id, token, bucket)``, and the index cut down to these buckets' folders."""
    wanted = queries.select("query_id", F.explode(tokens(F.coalesce(F.col(text), F.lit("")), preserved)).alias("token"))
    wanted = materialise(wanted.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(index.buckets)).cast("int")))
    # at most ``buckets`` numbers
    own = F.col("bucket").isin([r[0] for r in wanted.select("bucket").distinct().collect()])
    return BlockIndex(index.blocks.where(own), index.bands.where(own), index.corpus, index.buckets), wanted


def query_bands(index: BlockIndex, wanted: DataFrame) -> DataFrame:
    """``(query_id, bucket, part, token, band, n, min_dl, segs, idf, df, avgdl)``: the bands of the queries' tokens."""
    found = index.bands.join(_small(wanted), ["bucket", "token"])
    df = F.sum("n").over(Window.partitionBy("query_id", "token"))
    corpus = lexical.combined(index.corpus).select("n", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"))
    # one row
    found = found.withColumn("df", df).crossJoin(F.broadcast(corpus.withColumnRenamed("n", "_n")))
    return found.withColumn("idf", F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).drop("_n")


def _opened(index: BlockIndex, bands: DataFrame, *columns: str) -> DataFrame:
    """The rows of whole bands, with columns of ``bands``."""
    on = ["bucket", "part", "token", "band"]
    joined = index.blocks.join(_small(bands.select(*on, "query_id", "idf", *columns)), on)
    return joined.select("query_id", "band", "idf", *columns, F.inline("rows"))


def plan(index: BlockIndex, bands: DataFrame, k: int, settings: Settings = DEFAULTS, lead: int = LEAD) -> DataFrame:
    """``query_bands`` with ``bound`` (the k-th best partial score, null below k of them) and ``essential`` (its blocks are read)."""
    first = Window.partitionBy("query_id").orderBy("df", "token", "band", "part").rowsBetween(Window.unboundedPreceding, 0)
    leads = bands.withColumn("upto", F.sum("n").over(first)).where((F.col("upto") <= lead) | (F.col("upto") == F.col("n")))
    partial = _opened(index, leads, "avgdl").groupBy("query_id", "key").agg(F.sum(F.col("idf") * _factor(F.col("dl"), settings)).alias("s"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"))
    kth = partial.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query_id", (F.col("s") - ROOM).alias("bound"))
    known = bands.join(kth, "query_id", "left")
    together = Window.partitionBy("query_id", "band")
    # the parts of a token share its idf, which counts once
    one = F.row_number().over(Window.partitionBy("query_id", "band", "token").orderBy("part")) == 1
    known = known.withColumn("_idf", F.when(one, F.col("idf")).otherwise(0.0)).withColumn("_top", _factor(F.min("min_dl").over(together), settings))
    upto = F.sum("_idf").over(together.orderBy("idf", "token"))  # rows of one token are peers
    return known.withColumn("essential", F.col("bound").isNull() | (upto * F.col("_top") >= F.col("bound")))


def search(index: BlockIndex, queries: DataFrame, k: int = 5, text: str = "query", settings: Settings = DEFAULTS, preserved=PRESERVED_TERMS, lead: int = LEAD, direct: int = DIRECT) -> DataFrame:
    """``(query_id, key, score, rank)``: the k best chunks of each query, as of ``lexical.search``."""
    index, wanted = _wanted(index, queries, text, preserved)
    bands = materialise(query_bands(index, wanted))
    if bands.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= direct:
        by_token = _small(bands.select("query_id", "bucket", "token", "idf", "avgdl").distinct())
        every = index.blocks.select("bucket", "token", "rows").join(by_token, ["bucket", "token"]).select("query_id", "idf", "avgdl", F.inline("rows"))
        scored = every.groupBy("query_id", "key").agg(F.sum(F.col("idf") * _factor(F.col("dl"), settings)).alias("score"))
        return lexical.top_k(scored, k).select("query_id", "key", "score", "rank")
    known = materialise(plan(index, bands, k, settings, lead))
    read = _opened(index, known.where("essential"), "avgdl", "bound")
    held = read.groupBy("query_id", "key", "band", "dl", "avgdl", "bound").agg(F.sum("idf").alias("sum"))
    others = known.where("not essential")
    rest = others.groupBy("query_id", "band").agg(F.sum("_idf").alias("rest"))
    could = held.join(_small(rest), ["query_id", "band"], "left").where(
        F.col("bound").isNull() | ((F.col("sum") + F.coalesce("rest", F.lit(0.0))) * _factor(F.col("dl"), settings) >= F.col("bound"))
    )
    could = materialise(could.drop("rest"))
    # the blocks that can hold a chunk's other tokens
    on = ["bucket", "part", "token", "band", "seg"]
    asked = could.select("query_id", "key", "band").join(_small(others.select("query_id", "bucket", "part", "token", "band", "segs", "idf")), ["query_id", "band"])
    asked = asked.withColumn("seg", F.pmod(F.xxhash64("key"), F.col("segs")))
    opened = index.blocks.join(_small(asked.select(*on, "query_id", "key", "idf")), on).where(F.array_contains(F.col("rows.key"), F.col("key")))
    times = F.size(F.filter("rows", lambda r: r["key"] == F.col("key")))
    more = opened.groupBy("query_id", "key").agg(F.sum(F.col("idf") * times).alias("more"))
    full = could.join(more, ["query_id", "key"], "left").groupBy("query_id", "key").agg(
        F.sum((F.col("sum") + F.coalesce("more", F.lit(0.0))) * _factor(F.col("dl"), settings)).alias("score")
    )
    return lexical.top_k(full, k).select("query_id", "key", "score", "rank")
