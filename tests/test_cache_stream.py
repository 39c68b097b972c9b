"""The streaming cache against a replay row by row, for several cuts into micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog
from tessera.streaming import cache_stream

START = dt.datetime(2024, 1, 1)
KINDS = "seq long, id string, op string, at timestamp, response string"


def replay(events, size, ttl, set_of=lambda i: 0):
    """Every event by hand over plain lists."""
    held, out = {}, []
    for seq, id_, op, at, response in sorted((e for e in events if None not in e[:4] and e[2] in ("get", "put")), key=lambda e: (e[3], e[0])):
        entries = held.setdefault(set_of(id_), {})
        for k in [k for k, e in entries.items() if (at - e["born"]).total_seconds() > ttl]:
            del entries[k]
        if op == "put":
            if id_ not in entries and len(entries) >= size:
                del entries[min(entries, key=lambda k: entries[k]["used"])]
            entries[id_] = {"born": at, "used": (at, seq), "response": response}
        else:
            e = entries.get(id_)
            if e:
                e["used"] = (at, seq)
            out.append((seq, id_, e is not None, e["response"] if e else None))
    return sorted(out)


def events(n=600, seed=4):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 30]) if i != n // 2 else 5000  # equal times, and a silence in which all expires
        rows.append((i, f"k{int(rng.paretovariate(0.7)) % 25}", rng.choice(["get", "put"]), START + dt.timedelta(seconds=t), None if rng.random() < 0.1 else f"r{i}"))
    return rows


@pytest.mark.parametrize("cuts, sets", [([], 1), ([100, 101, 333, 400], 1), ([250], 4)])
def test_equals_the_replay_in_any_cut(spark, tmp_path, cuts, sets):
    rows, src = events(), tmp_path / "in"
    odd = [(None, "k1", "get", START, "x"), (9001, None, "get", START, "x"), (9002, "k1", "drop", START, "x"), (9003, "k1", "get", None, "x")]
    src.mkdir()
    stream = spark.readStream.schema(KINDS).parquet(str(src))
    edges = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = rows[a:b] + (odd if i == 0 else [])
        random.Random(i).shuffle(part)
        # a late second: a cut between equal times must not lose the second half to the watermark
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(str(src))
        cache_stream.start(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 8, 120, sets, 1).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("seq", "id", "hit", "response").collect())
    of = {r["id"]: r["s"] for r in spark.createDataFrame(rows, KINDS).select("id", F.pmod(F.xxhash64("id"), F.lit(sets)).alias("s")).distinct().collect()}
    want = replay(rows, 8, 120, of.get)
    assert got == want and 0.1 < sum(r[2] for r in want) / len(want) < 0.9


def test_query_equals_the_replay(spark, sf):
    rows = catalog.cache_events(spark.read.parquet(f"{sf}/events.parquet")).select(*[c.split()[0] for c in KINDS.split(", ")]).collect()
    sets = {r["id"]: r["s"] for r in spark.createDataFrame(rows, KINDS).select("id", F.pmod(F.xxhash64("id"), F.lit(catalog.CACHE_SETS)).alias("s")).distinct().collect()}
    want = replay([tuple(r) for r in rows], catalog.CACHE_SET_SIZE, catalog._TTL, sets.get)
    got = sorted((r["event_id"], r["id"], r["hit"], r["response"]) for r in catalog.cache_stream_answers(spark, sf).collect())
    assert got == want and 0 < sum(r[2] for r in want) < len(want)
