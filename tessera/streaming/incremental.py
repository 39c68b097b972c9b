"""Incremental ingest: a stream of documents appended to the index tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..models import Embedder, HashEmbedder
from ..operators import ingest, lexical
from ..sources import snapshots


def write_batch(docs: DataFrame, batch_id: int, path: str, embedder: Embedder, settings: Settings = DEFAULTS, writer: str = "stream") -> None:
    """Chunks, postings and counts of one batch in one snapshot; a batch that is replayed is passed over."""
    spark = docs.sparkSession
    if snapshots.open_snapshot(spark, path).batches.get(writer, -1) >= batch_id:
        return
    chunks = ingest.embed_chunks(ingest.chunk(docs, settings), embedder, settings).withColumn("key", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    stored = snapshots.stage(spark, path, "chunks", chunks)
    index = lexical.build_index(stored.read(), "key")
    snapshots.commit(spark, path, append={"chunks": stored, "postings": index.postings, "corpus": index.corpus}, batch=(writer, batch_id))


def start(stream: DataFrame, path: str, checkpoint: str, embedder: Embedder | None = None, settings: Settings = DEFAULTS, **trigger) -> StreamingQuery:
    """stream(doc_id, title, content) -> snapshots under ``path``; exactly once by batch id and checkpoint folder."""
    embedder = embedder or HashEmbedder()
    writer = stream.writeStream.foreachBatch(lambda df, i: write_batch(df, i, path, embedder, settings, checkpoint)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def load_index(spark, path: str, version: int | None = None) -> lexical.LexicalIndex:
    """The index over all batches of a version: sums of the batches' counts, no text is read again."""
    pinned = snapshots.open_snapshot(spark, path, version)
    postings = pinned.read("postings").select("key", "dl", "token")
    corpus = lexical.combined(pinned.read("corpus"))
    return lexical.LexicalIndex(postings, lexical.term_table(postings, corpus), corpus)
