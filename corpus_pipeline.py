"""Training-data pipeline over ``documents``: classify, deduplicate twice, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame whose decisions have taken effect. All
but the last keep the columns of ``docs`` (any further ones included). ``run`` applies them in order;
between stages the rows are written as Parquet to the shared folder and read again, so a lost
executor costs at most the stage at work, and no stage is computed twice.

Empty tables pass through as empty tables. What each stage does with nulls, ties, repeated rows and
very long texts is stated in its operator's module.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.byte_bpe import digests
from tessera.llm.chaining import drop_passages
from tessera.llm.common import shared_dir, table
from tessera.llm.mixing import repeat_documents
from tessera.llm.quality import reject
from tessera.llm.simhash import keep_first

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality or toxic go."""
    return reject(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from the later ones."""
    return drop_passages(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return repeat_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the text decoded from them."""
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The classifier, fingerprints, chains and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result's Parquet files stay in the shared folder."""
    docs, base, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        out = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if last:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, last = spark.read.parquet(out), out
    return docs
