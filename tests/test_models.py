"""Requests to models: a bounded window over batches, retries, order."""

import threading
import time

from pyspark.sql import functions as F

from tessera.models import complete, embed, in_window


def slow():
    class Slow:
        """Answers with the number of calls under way."""

        def __init__(self):
            self.live = set()

        def complete(self, prompt):
            self.live.add(threading.get_ident())
            time.sleep(0.05)
            n = len(self.live)
            self.live.discard(threading.get_ident())
            return f"{prompt}:{n}"

    return Slow()


def test_twenty_calls_are_under_way_over_batches(spark):
    """A task of five Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rows = spark.range(200).coalesce(1).select("id", complete(F.col("id").cast("string"), slow()).alias("r")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["r"].split(":")[0] for r in rows] == [str(r["id"]) for r in rows] and len(rows) == 200
    assert max(int(r["r"].split(":")[1]) for r in rows) == 20


def test_the_window_reaches_over_small_batches():
    model, most = slow(), []
    got = list(in_window(iter([[f"{i}"] * 4 for i in range(10)]), lambda p: most.append(1) or model.complete(p), 6))
    assert [g[0].split(":")[0] for g in got] == [str(i) for i in range(10)] and {len(g) for g in got} == {4}
    seen = [int(x.split(":")[1]) for g in got for x in g]
    assert 4 < max(seen) <= 6 and len(most) == 40
    assert list(in_window(iter([[], [1], []]), lambda x: x, 2)) == [[], [1], []] and list(in_window(iter([]), lambda x: x, 2)) == []


def test_a_slow_call_does_not_hold_up_the_others():
    began = time.time()
    got = list(in_window(iter([[0.5, 0.0, 0.0], [0.0] * 3]), lambda s: time.sleep(s) or s, 3))
    assert got == [[0.5, 0.0, 0.0], [0.0] * 3] and time.time() - began < 0.9


def flaky():
    class Flaky:
        """Fails at every first call for a prompt, and always for one."""

        def __init__(self):
            self.seen = {}

        def complete(self, prompt):
            self.seen[prompt] = self.seen.get(prompt, 0) + 1
            if prompt == "bad" or self.seen[prompt] == 1:
                raise TimeoutError
            return f"{prompt} {self.seen[prompt]}"

        def embed(self, texts):
            if "bad" in texts:
                raise TimeoutError
            return [[float(len(t))] for t in texts]

    return Flaky()


def test_one_failure_costs_one_row(spark):
    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, None), (3, "b")], "id long, p string").coalesce(1)
    got = df.select(complete(F.col("p"), flaky(), pause=0.01).alias("r"), embed(F.col("p"), flaky(), per_request=2, pause=0.01).alias("v")).collect()
    assert [r["r"] for r in got] == ["a 2", "", " 2", "b 2"]
    assert [list(r["v"]) for r in got] == [[1.0], [], [0.0], [1.0]]
    assert [r["r"] for r in df.select(complete(F.col("p"), flaky(), attempts=3, pause=0.01).alias("r")).where("r <> ''").collect()] == ["a 2", " 2", "b 2"]
    assert df.limit(0).select(complete(F.col("p"), flaky()).alias("r")).collect() == []
