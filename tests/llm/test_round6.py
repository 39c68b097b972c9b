"""Findings of round 3, taken up again: seeds made once, shuffles that leave the disks."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import chaining, chroma, simhash
from tessera.llm.common import components, stored


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle") for i in range(files.size()))


def test_ranges_equal_a_count_of_the_ends_before():
    rng = np.random.default_rng(5)
    ends = np.array(sorted(zip(rng.integers(-4, 4, 12), rng.integers(0, 9, 12))))
    key, doc = rng.integers(-6, 6, 500), rng.integers(-2, 12, 500)
    want = [sum((a, b) <= (k, d) for a, b in ends.tolist()) for k, d in zip(key.tolist(), doc.tolist())]
    assert chaining.ranges(key, doc, (ends[:, 0], ends[:, 1])).tolist() == want
    none = np.zeros(0, dtype=np.int64)
    assert not chaining.ranges(key, doc, (none, none)).any()


def test_seeds_are_made_once(spark, tmp_path, monkeypatch):
    made = chaining._seeds

    def counted(*args, **options):
        run = made(*args, **options)

        def count(batches):
            for batch in batches:
                with open(tmp_path / "rows", "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield from run([batch])

        return count

    monkeypatch.setattr(chaining, "_seeds", counted)
    monkeypatch.setattr(chaining, "EACH", 1)
    words = F.expr("transform(sequence(0, 60), x -> concat('w', pmod(xxhash64(id % 900, x), 5000)))")
    texts = spark.range(1000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").cast("binary").alias("text"))
    got = chaining.seed_matches(texts)
    copies = got.where("doc >= 900").select("doc", "m.src").distinct().where("src = doc - 900").count()
    assert copies == 100
    assert sum(map(int, (tmp_path / "rows").read_text().split())) < 1500


def test_shuffles_behind_a_stored_table_leave_the_disks(spark):
    before = _shuffle_files(spark)
    table = stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count())
    assert _shuffle_files(spark) <= before
    assert (table.count(), table.agg(F.sum("count")).first()[0]) == (700, 5000)
    assert stored(table.where("k < 0")).count() == 0


def test_components_leave_one_table(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    components(edges)
    files = [f.getPath() for f in _listed(spark, folder.get())]
    tables = {p.getParent().toString() for p in files if p.getName().startswith("part-")}
    again = components(edges)
    files = [f.getPath() for f in _listed(spark, folder.get())]
    now = {p.getParent().toString() for p in files if p.getName().startswith("part-")}
    assert len(now - tables) == 1
    assert again.select("component").distinct().count() == 1


def test_steps_of_near_dedup_leave_no_shuffles(spark):
    reps = spark.range(300).select(F.col("id").alias("rep"), (F.xxhash64(F.col("id") % 250)).alias("first"))
    before = _shuffle_files(spark)
    pairs = simhash.ring_pairs(reps)
    assert _shuffle_files(spark) <= before
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(k, k + 250) for k in range(50)}


def test_pairs_of_recordings_leave_no_shuffles(spark):
    rng = np.random.default_rng(3)
    audio = [rng.integers(0, 256, 4000, dtype=np.uint8).tobytes() for _ in range(3)]
    rows = [(k, chroma.pack(chroma.fingerprint(a, "u8"))) for k, a in enumerate([*audio, audio[0][:3600]])]
    marks = spark.createDataFrame(rows, "id long, items binary").mapInArrow(chroma._anchors, chroma._ROW_TYPE)
    before = _shuffle_files(spark)
    pairs = chroma.likely_pairs(marks)
    assert _shuffle_files(spark) <= before
    assert {r["a"] for r in pairs.collect()} | {r["b"] for r in pairs.collect()} >= {0, 3}


def _listed(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while found.hasNext():
        yield found.next()
