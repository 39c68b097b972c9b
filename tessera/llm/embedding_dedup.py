"""Operator 5: embedding near-duplicates by sorted projection passes.

Equal vectors are one class first, shown by its smallest id and counted. Each pass draws 64 random
hyperplanes; a class vector's sign bits, concatenated, are its sort key. Vectors are ordered by key
(range partitions, so no key meets in one task) and each is compared with the next ``WINDOW`` in
order. Passes are independent; their number follows from the number of classes so that a pair at the
threshold is expected to meet in 99 % of cases at every size.

What travels with a pass is the vector in one byte a component, with its scale and the length of its
rounding error. That bounds the error of a cosine: pairs are sure, out of question, or doubtful. A
partition emits a spanning forest of its sure pairs and the doubtful pairs that the forest does not
join; those are decided by cosine in double precision. The union of all passes' edges gives the
components.

Links are then counted exactly inside each component, in double precision: its classes are dealt into
blocks of about ``BLOCK``, pairs of blocks are compared as matrices and only counts come out. Every link of a
found component is counted, however dense, and every counted link is at or above the threshold.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length never link; a null id links with nothing and has a null
component, so it is not kept; an id that repeats is one vector (of different ones the smallest in
byte order) and each row gets its result; ties in the order fall by id. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, partitions

THRESHOLD, WINDOW, BLOCK, SEED = 0.9, 64, 512, 5
RECALL = 0.99


def n_passes(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``.

    Two such vectors share a hyperplane's side with probability 1 - angle / pi, and meet in a pass if
    they share the bits that leave about ``window`` vectors together.
    """
    bits = max(0.0, math.log2(max(1, n) / window))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(meet, 0.99))))


def _usable(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return x


def _unit(rows: np.ndarray) -> np.ndarray:
    # scale first: squares of very large or small components stay finite
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _units(batches):
    """Usable vectors as unit vectors in double precision."""
    for batch in batches:
        ids, blobs = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (x := _usable(v)) is not None:
                ids.append(i)
                blobs.append(_unit(x[None])[0].astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["vec_id", "unit"])


def rounded(unit: np.ndarray) -> list[bytes]:
    """Unit rows as scale and error (float32 each) and one byte a component; the error is never too small."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    small = np.round(unit / scale[:, None]).clip(-127, 127).astype(np.int8)
    error = np.linalg.norm(unit - small * scale.astype(float)[:, None], axis=1)
    head = np.stack((scale, (error * 1.0001 + 1e-6).astype(np.float32)), axis=1).astype("<f4")
    return [h.tobytes() + r.tobytes() for h, r in zip(head, small)]


def _keys(passes: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids = np.array(batch.column(0).slice(at, 1000).to_pylist(), dtype=np.int64)
                held = batch.column(1).slice(at, 1000).to_pylist()
                sizes = np.array([len(b) // 8 for b in held])
                for dim in np.unique(sizes).tolist():
                    pick = np.flatnonzero(sizes == dim)
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, passes * 64))
                    unit = np.frombuffer(b"".join(held[k] for k in pick), dtype="<f8").reshape(-1, dim)
                    side = (unit @ planes[dim] > 0).reshape(len(pick), passes, 64)
                    key = np.packbits(side, axis=2).view(">u8")[:, :, 0].astype(np.uint64)
                    key = (key ^ np.uint64(1 << 63)).view(np.int64)  # signed order is bit order
                    blobs = pa.array(rounded(unit), pa.binary())
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(pick), p, np.int32)), pa.array(np.full(len(pick), dim, np.int32)), pa.array(key[:, p]), pa.array(ids[pick]), blobs],
                            ["pass", "dim", "key", "vec_id", "small"],
                        )

    return run


def _forest(a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, bool]]:
    """Edges of a spanning forest of the sure pairs, and the doubtful pairs that it does not join."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for x, y in zip(a[sure].tolist(), b[sure].tolist()):
        if (r := root(x)) != (s := root(y)):
            parent[r] = s
            out.append((x, y, True))
    return out + [(min(x, y), max(x, y), False) for x, y in zip(a[~sure].tolist(), b[~sure].tolist()) if root(x) != root(y)]


def _windows(threshold: float, window: int):
    def compare(ids, error, vectors, new):
        """Pairs of each of the rows from ``new`` on with at most ``window`` rows before it."""
        found = []
        for at in range(new, len(ids), 256):
            lo, hi = max(0, at - window), min(len(ids), at + 256)
            about = vectors[at:hi] @ vectors[lo:hi].T
            # |ab - a'b'| <= |a - a'| |b| + |a'| |b - b'|, and the rounding of the product itself
            off = error[at:hi, None] + (1 + error[at:hi, None]) * error[lo:hi] + 1e-4
            i, j = np.nonzero(about >= threshold - off)
            ok = (j + lo < i + at) & (i + at - j - lo <= window) & (ids[i + at] != ids[j + lo])
            i, j = i[ok], j[ok]
            found.append(np.stack((ids[j + lo], ids[i + at], about[i, j] >= threshold + off[i, j])))
        a, b, sure = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        return _forest(a, b, sure.astype(bool))

    def run(batches):
        group, ids, error, vectors = None, np.zeros(0, np.int64), None, None
        for batch in batches:
            labels = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            cuts = np.flatnonzero(np.concatenate(([True], (labels[:, 1:] != labels[:, :-1]).any(axis=0), [True])))
            for a, z in zip(cuts, cuts[1:]):
                label = tuple(labels[:, a].tolist())
                new_ids = batch.column(3).slice(a, z - a).to_numpy(zero_copy_only=False)
                raw = np.frombuffer(b"".join(batch.column(4).slice(a, z - a).to_pylist()), dtype=np.uint8).reshape(z - a, 8 + label[1])
                head = np.ascontiguousarray(raw[:, :8]).view("<f4")
                new, new_error = raw[:, 8:].view(np.int8) * head[:, :1], head[:, 1].astype(float)
                if label == group:
                    ids, error, vectors, first = np.concatenate((ids, new_ids)), np.concatenate((error, new_error)), np.concatenate((vectors, new)), len(ids)
                else:
                    group, ids, error, vectors, first = label, new_ids, new_error, new, 0
                edges = compare(ids, error, vectors, first)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64()), pa.array([e[2] for e in edges], pa.bool_())], ["a", "b", "sure"])
                ids, error, vectors = ids[-window:], error[-window:], vectors[-window:]

    return run


def _decide(threshold: float):
    def run(batches):
        for batch in batches:
            near = [float(np.frombuffer(a.as_py(), "<f8") @ np.frombuffer(b.as_py(), "<f8")) >= threshold for a, b in zip(batch.column(2), batch.column(3))]
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _counts(threshold: float):
    """Rows of one (component, i, j) together -> links of each class in that pair of blocks, copies counted."""

    def close(rows):
        side, ids, blobs, copies = zip(*rows)
        side, ids, copies = np.array(side), np.array(ids, dtype=np.int64), np.array(copies, dtype=np.int64)
        dims = np.array([len(b) for b in blobs])
        out = []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            unit = np.frombuffer(b"".join(blobs[k] for k in at), dtype="<f8").reshape(len(at), -1)
            one = at[side[at] <= 1]
            two = at[side[at] >= 1]
            a, b = unit[side[at] <= 1], unit[side[at] >= 1]
            link = (a @ b.T >= threshold) & (ids[one][:, None] != ids[two][None])
            out.append((ids[one], link @ copies[two]))
            if (side[at] == 2).any():
                out.append((ids[two], copies[one] @ link))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([i for i, _ in out])), pa.array(np.concatenate([n for _, n in out]).astype(np.int64))], ["vec_id", "n"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for component, i, j, side, vec, blob, copies in zip(*cols):
                if (component, i, j) != key:
                    if rows:
                        yield close(rows)
                    key, rows = (component, i, j), []
                rows.append((side, vec, blob, copies))
        if rows:
            yield close(rows)

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors`` (vec_id, embedding)."""
    n = partitions(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    units = cut(rows.where("vec_id is not null").mapInArrow(_units, "vec_id long, unit binary").groupBy("vec_id").agg(F.min("unit").alias("unit")))
    # equal vectors link with each other and with the same others
    classes = cut(units.groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    passes = passes or n_passes(classes.count(), threshold, window)
    keyed = classes.select("vec_id", "unit").mapInArrow(_keys(passes), "pass int, dim int, key long, vec_id long, small binary")
    ordered = keyed.repartitionByRange(n, "pass", "dim", "key", "vec_id").sortWithinPartitions("pass", "dim", "key", "vec_id")
    near = cut(ordered.mapInArrow(_windows(threshold, window), "a long, b long, sure boolean").distinct())
    one, two = (classes.select(F.col("vec_id").alias(c), F.col("unit").alias(f"unit_{c}")) for c in ("a", "b"))
    decided = near.where("not sure").join(one, "a").join(two, "b").select("a", "b", "unit_a", "unit_b").mapInArrow(_decide(threshold), "a long, b long")
    groups = components(near.where("sure").select("a", "b").unionByName(decided))
    member = groups.select(F.col("node").alias("_node"), "component")
    linked = classes.join(member, F.col("vec_id") == F.col("_node")).drop("_node")
    sizes = member.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = linked.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        # 1: the only block (i = j); 0: the first of two, 2: the second
        F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2).alias("side"),
        "vec_id",
        "unit",
        "copies",
    )
    counted = (
        pairs.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
        .mapInArrow(_counts(threshold), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("others"))
    )
    of_class = classes.join(counted, "vec_id", "left").join(member, F.col("vec_id") == F.col("_node"), "left").select(
        F.col("unit").alias("_unit"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component")
    )
    found = cut(units.join(of_class, F.col("unit") == F.col("_unit")).select(F.col("vec_id").alias("_id"), "n_links", "component"))
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(found, F.col("vec_id") == F.col("_id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
