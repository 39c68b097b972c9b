"""The response cache as a stateful stream: get, put, expiry and least-recently-used eviction, in order of event time.

Events ``(seq, id, op, at, response)`` become one answer ``(seq, id, hit, response)`` for each ``get``. The cache is *set-associative*: an id
belongs to one of ``sets`` groups by hash, and each is a cache of its own with ``size`` entries. One set is the plain cache of ``size`` entries;
several run in parallel, and none knows more than its ``size`` entries and the rows of one micro-batch.

- ``put`` stores the response: created and used now. It first drops what has expired and then, if the set is full, the least
  recently used entry; replacing an id needs no room.
- ``get`` answers and makes the entry the most recently used. An entry older than ``ttl_seconds`` is gone.

Rows are taken by time, then ``seq``. A micro-batch may end anywhere in that order, also between equal times: the answers do
not change, since expiry follows the events' own time. A timer at the expiry of a set's newest entry empties sets that no event reaches any more; it fires only
when the watermark has passed, so nothing that it drops could have been a hit. Rows that arrive after the watermark
(``late_seconds``) are dropped by Spark. Rows with a null id, time or seq or another op are left out; a null response is a response.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import DEFAULTS

ANSWERS = "seq long, id string, hit boolean, response string"
_STATE = "response string, created long, used long, used_seq long"


class CacheSet:
    """One set in memory: entries (response, created, used, used_seq) by recency of use; microseconds."""

    def __init__(self, entries, size: int, ttl: int):
        self.size, self.ttl = size, ttl
        self.by_use = OrderedDict(sorted(entries, key=lambda e: (e[1][2], e[1][3])))
        self.by_birth = OrderedDict((k, v[1]) for k, v in sorted(self.by_use.items(), key=lambda e: (e[1][1], e[1][3])))
        self.touched: set[str] = set()

    def _drop(self, id_: str) -> None:
        del self.by_use[id_], self.by_birth[id_]
        self.touched.add(id_)

    def expire(self, at: int) -> None:
        while self.by_birth and at - next(iter(self.by_birth.values())) > self.ttl:
            self._drop(next(iter(self.by_birth)))

    def put(self, id_: str, response: str | None, at: int, seq: int) -> None:
        self.expire(at)
        if id_ in self.by_use:
            self._drop(id_)
        elif len(self.by_use) >= self.size:
            self._drop(next(iter(self.by_use)))
        self.by_use[id_], self.by_birth[id_] = (response, at, at, seq), at
        self.touched.add(id_)

    def get(self, id_: str, at: int, seq: int) -> tuple[bool, str | None]:
        self.expire(at)
        if id_ not in self.by_use:
            return False, None
        response, created, _, _ = self.by_use.pop(id_)
        self.by_use[id_] = (response, created, at, seq)
        self.touched.add(id_)
        return True, response


class CacheProcessor(StatefulProcessor):
    def __init__(self, size: int, ttl_seconds: float):
        self.size, self.ttl = size, int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "id string", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = CacheSet([(k[0], tuple(v)) for k, v in self.entries.iterator()], self.size, self.ttl)
        before = set(held.by_use)
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")
        answers = []
        for seq, id_, op, at, response in zip(*(batch[c].tolist() for c in ("seq", "id", "op", "micros", "response"))):
            if op == "put":
                held.put(id_, response, at, seq)
            else:
                answers.append((seq, id_, *held.get(id_, at, seq)))
        for id_ in held.touched:
            if id_ in held.by_use:
                self.entries.updateValue((id_,), held.by_use[id_])
            elif id_ in before:
                self.entries.removeKey((id_,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held.by_birth:
            self.handle.registerTimer((next(reversed(held.by_birth.values())) + self.ttl) // 1000 + 1)
        yield pd.DataFrame(answers, columns=["seq", "id", "hit", "response"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        return iter([])


def answers(events: DataFrame, size: int = DEFAULTS.CACHE_MAX_SIZE, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS, sets: int = 1, late_seconds: int = 1) -> DataFrame:
    """A stream of events -> the stream of answers; needs the RocksDB state store (``prepare``)."""
    rows = events.select(F.col("seq").cast("long"), F.col("id").cast("string"), "op", F.col("at").cast("timestamp"), F.col("response").cast("string"))
    rows = rows.where("seq is not null and id is not null and at is not null and op in ('get', 'put')")
    rows = rows.withColumn("micros", F.unix_micros("at")).withColumn("cache_set", F.pmod(F.xxhash64("id"), F.lit(sets)))
    timed = rows.withWatermark("at", f"{late_seconds} seconds")
    return timed.groupBy("cache_set").transformWithStateInPandas(CacheProcessor(size, ttl_seconds), ANSWERS, "append", "eventtime")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def start(events: DataFrame, path: str, checkpoint: str, size: int = DEFAULTS.CACHE_MAX_SIZE, ttl_seconds: float = DEFAULTS.CACHE_TTL_SECONDS, sets: int = 1, late_seconds: int = 1, **trigger) -> StreamingQuery:
    """Answers as Parquet files under ``path``, exactly once."""
    prepare(events.sparkSession)
    writer = answers(events, size, ttl_seconds, sets, late_seconds).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)
