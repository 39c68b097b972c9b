"""Shared pieces of the training-data operators: table access, checkpoints, components."""

from __future__ import annotations

import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where none is set, a folder in the warehouse, which is shared too."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-checkpoints")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: cuts the lineage like ``cut``, and the shuffles behind it leave the disks at once.

    Small results are read back in few tasks, so that what follows does not make as many files as there are partitions, squared.
    """
    spark, path, key = df.sparkSession, f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` as ``(node, component)``, component = smallest node id.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round moves each edge
    towards the smallest known neighbour, so the edge count never grows and hubs are only reached
    through a map-side combined ``min``. Each round is stored and the one before discarded; only two numbers per round
    reach the driver. Nodes without an edge are absent. Null ends and self loops are ignored.
    """
    e = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo")))
        )
        last, e = e, stored(small.distinct())
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            star = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _compress(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(v.as_py() or b"") for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["id", "packed", "rest"])


def packed_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, packed, rest)`` of rows with an id, and of rows without one.

    packed: the UTF-8 text, zstd-compressed, so that it waits on disk at half the size of Spark's own
    compression. Rows without an id are read by the task that uses them, so theirs is the plain text: such a
    task then runs one Python worker, not two, and an executor keeps one for each core (``raw_texts`` reads both).
    rest: the other columns as one struct, whatever their names. With the explicit filter and the new
    names every join on ``id`` that takes all three columns reads the same exchange.
    """
    others = [docs[c] for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").cast("binary").alias("_text"), F.struct(*others).alias("rest"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("packed", T.BinaryType()), rows.schema["rest"]])
    with_id = rows.where("_id is not null").mapInArrow(_compress, schema).where("id is not null")
    plain = F.coalesce("_text", F.lit("").cast("binary"))
    return with_id, rows.where("_id is null").select(F.col("_id").alias("id"), plain.alias("packed"), "rest")


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def raw_texts(ids: pa.Array, packed: pa.Array) -> list[bytes]:
    """Texts of rows as ``packed_texts`` gives them."""
    return [unpacked(v.as_py()) if i.is_valid else v.as_py() for i, v in zip(ids, packed)]
