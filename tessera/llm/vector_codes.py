"""Operator 12: vectors as codes of learned entries, assigned by vantage-point trees.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each part position has a
codebook of at most ``ENTRIES`` entries that a fixed number of rounds refines. All sums and distances
are integers, so that the result does not depend on the order of rows.

*Assignment.* Each part position's entries stand in a vantage-point tree: an entry, and the others by
whether they are nearer to it than the median. A part visits the side it falls on first and the other
side only if its shell, by the triangle inequality, may hold an entry that is as near as the best one.
Radii and distances are square roots, each rounded away from the decision, and the comparison is not
strict, so that an entry at equal distance with a lower index is still visited. Which entry is nearest
is decided by the integer squared distances, then by index.

*Rounds.* The trees are built on the driver from the 128 entries and travel with the tasks. A task adds up
its parts by entry; the sums of all tasks are grouped, and at most ``PARTS * ENTRIES`` rows of counts
and as many of sums a component reach the driver. The integer rows are made once and checkpointed.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are left out; so are
those whose length is not that of the vector with the smallest id (or whose length is no multiple
of the parts: then every row is). Integers are held to a bound that keeps a squared distance in 63 bits
(2^27 for 64 components, which is |x| < 32,768; beyond it a component counts as the bound). A null id is
coded but starts no entry unless fewer than ``ENTRIES`` ids are known (nulls come last); rows of one id
stand in order of their components. With fewer rows than entries the codebook has as many entries as
rows. Repeated rows count each time. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows assigned at a time.
ROWS = 4096
#: Relative error that covers the roundings of a square root of an integer.
_SLACK = 2.0**-50


def bound(width: int) -> int:
    """Largest integer component: the squared distance of two vectors of ``width`` components stays below 2^63."""
    return 1 << int((61 - math.log2(max(1, width))) // 2)


def _integers(batches):
    for batch in batches:
        keep, blobs, widths = [], [], []
        for i, v in enumerate(batch.column(2).to_pylist()):
            if not v:
                continue
            x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
            if np.isfinite(x).all():
                most = float(bound(len(x)))
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(SCALE * x), -most, most)
                keep.append(i)
                blobs.append(x.astype("<i4").tobytes())
                widths.append(len(x))
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary()), pa.array(widths, pa.int32())], ["vec_id", "label", "v", "width"])


class Tree:
    """A vantage-point tree over the rows of ``entries`` (integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._build(list(range(len(entries))))

    def _build(self, at: list[int]):
        """(entry, near shell, near subtree, far shell, far subtree); a shell is its least and greatest radius, rounded outwards."""
        if not at:
            return None
        top, rest = at[0], at[1:]
        gap = self.entries[rest] - self.entries[top]
        square = (gap * gap).sum(axis=1) if rest else np.zeros(0, dtype=np.int64)
        by = np.argsort(square, kind="stable")
        half = len(rest) // 2
        sides = []
        for some in (by[:half], by[half:]):
            r = np.sqrt(square[some].astype(np.float64)) if len(some) else np.zeros(1)
            sides += [(r.min() * (1 - _SLACK), r.max() * (1 + _SLACK)), self._build([rest[k] for k in some])]
        return (top, *sides)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of and squared distance to the nearest entry of every row, ties to the lower index; and the distances computed."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.zeros(len(x), dtype=np.int64)
        visits = 0

        def reach(shell, d, rows):
            """Rows that may have an entry in the shell at the best distance or nearer."""
            limit = np.sqrt(best[rows].astype(np.float64)) * (1 + _SLACK)
            return (d * (1 - _SLACK) - shell[1] <= limit) & (shell[0] - d * (1 + _SLACK) <= limit)

        def visit(node, rows):
            nonlocal visits
            if node is None or not len(rows):
                return
            top, near_shell, near, far_shell, far = node
            gap = x[rows] - self.entries[top]
            square = np.einsum("ij,ij->i", gap, gap)
            visits += len(rows)
            better = (square < best[rows]) | ((square == best[rows]) & (top < index[rows]))
            best[rows[better]], index[rows[better]] = square[better], top
            if near is None and far is None:
                return
            d = np.sqrt(square.astype(np.float64))
            inside = d <= (near_shell[1] + far_shell[0]) / 2 if near is not None else np.zeros(len(rows), dtype=bool)
            for mine, order in ((inside, ((near_shell, near), (far_shell, far))), (~inside, ((far_shell, far), (near_shell, near)))):
                some, at = rows[mine], d[mine]
                for shell, side in order:
                    if side is not None and len(some):
                        visit(side, some[reach(shell, at, some)])

        visit(self.root, np.arange(len(x)))
        return index, best, visits


def _parts(blobs: list[bytes], parts: int) -> np.ndarray:
    """(part, row, component) of packed rows."""
    rows = np.frombuffer(b"".join(blobs), dtype="<i4").reshape(len(blobs), parts, -1)
    return rows.transpose(1, 0, 2).astype(np.int64)


def _packed(column: pa.Array):
    held = column.to_pylist()
    for at in range(0, len(held), ROWS):
        yield at, held[at : at + ROWS]


def _sums(books: list[np.ndarray]):
    """Rows -> for each part, entry and component the sum over its parts; component -1 is their number."""
    trees = [Tree(b) for b in books]
    shape = (len(books), len(books[0]), books[0].shape[1])

    def run(batches):
        total, count = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            for _, blobs in _packed(batch.column(0)):
                for p, x in enumerate(_parts(blobs, len(books))):
                    index = trees[p].nearest(x)[0]
                    np.add.at(total[p], index, x)
                    count[p] += np.bincount(index, minlength=shape[1])
        p, e = np.nonzero(count)
        every = np.concatenate((count[p, e][:, None], total[p, e]), axis=1)
        place = np.tile(np.arange(-1, shape[2]), len(p))
        wide = lambda a: pa.array(np.repeat(a, shape[2] + 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([wide(p), wide(e), pa.array(place.astype(np.int32)), pa.array(every.ravel())], ["part", "entry", "place", "n"])

    return run


def _codes(books: list[np.ndarray]):
    trees = [Tree(b) for b in books]

    def run(batches):
        for batch in batches:
            for at, blobs in _packed(batch.column(2)):
                found = [trees[p].nearest(x)[:2] for p, x in enumerate(_parts(blobs, len(books)))]
                index, error = np.stack([i for i, _ in found], axis=1), np.sum([e for _, e in found], axis=0)
                width = 2 * len(books)
                text = np.stack((index // 16, index % 16), axis=2).reshape(len(blobs), width).astype(np.uint8)
                text = (text + np.where(text < 10, 48, 87)).astype(np.uint8).tobytes().decode()
                codes = [text[k : k + width] for k in range(0, len(text), width)]
                part = batch.slice(at, len(blobs))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _refined(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry by the floor of the mean of its parts; an entry without parts stays."""
    sums = rows.select("v").mapInArrow(_sums(books), "part int, entry int, place int, n long")
    # at most parts x entries x (components of a part + 1) rows
    found = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    count = {(r["part"], r["entry"]): int(r["n"]) for r in found if r["place"] < 0}
    new = [b.copy() for b in books]
    for r in found:
        if r["place"] >= 0:
            new[r["part"]][r["entry"], r["place"]] = int(r["n"]) // count[r["part"], r["entry"]]
    return new


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of every usable row, and the codebooks: one array (entry, component) a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    read = vectors.select(F.col("vec_id").cast("long"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = read.schema["label"].dataType.simpleString()
    made = read.mapInArrow(_integers, f"vec_id long, label {kind}, v binary, width int")
    first = made.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    width = first[0]["width"] if first else 0
    rows = cut(made.where((F.col("width") == width) & (F.col("width") % parts == 0)).select("vec_id", "label", "v"))
    # at most ``entries`` rows
    start = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect()
    if len(start) < entries:
        start += rows.where("vec_id is null").orderBy("v").limit(entries - len(start)).collect()
    if not start:
        return rows.selectExpr("vec_id", "label", "'' as code", "0L as error"), []
    books = list(_parts([bytes(r["v"]) for r in start], parts))
    for _ in range(rounds):
        books = _refined(rows, books)
    return rows.mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long"), books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label, label_error, codebooks_sha256)``, one row per usable row of ``vectors`` (vec_id, embedding, label).

    A label may hold a third of all rows: errors are added up before they are shuffled, and the sum of a
    label meets its rows in several shares.
    """
    coded, books = encode_vectors(vectors, parts, entries, rounds)
    coded = cut(coded)
    shares = partitions(vectors.sparkSession)
    share = F.pmod(F.xxhash64("vec_id", "code"), F.lit(shares))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("_share"))
    joined = coded.withColumn("_mine", share).join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_mine") == F.col("_share")))
    return joined.select("vec_id", "code", "error", "label", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows as DuckDB SQL: every part against every entry."""
    last = entries - 1
    first = f"""with recursive base as (select vec_id, label, embedding as e, len(embedding) // {parts} as w from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 part as materialized (select vec_id, label, p.range as part, list_transform(e[p.range * w + 1 : (p.range + 1) * w], lambda x: floor({SCALE} * x::double)::bigint) as x from base, range({parts}) p),
 b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from part qualify entry <= {last})"""
    square = "list_sum(list_transform(list_zip(part.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} as materialized (select vec_id, label, part, any_value(part.x) as x, min(row({square}, entry)) as best
  from part join b{k} b using (part) group by vec_id, label, part)""")
        if k < rounds:
            steps.append(f"""s{k} as (select part, best[2] as entry, pos, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::bigint as c
  from (select part, best, unnest(x) as c, generate_subscripts(x, 1) as pos from a{k}) group by all),
 n{k} as (select part, entry, list(c order by pos) as x from s{k} group by part, entry),
 b{k + 1} as materialized (select part, entry, coalesce(n.x, b.x) as x from b{k} b left join n{k} n using (part, entry))""")
    return f"""{first}, {", ".join(steps)},
 code as (select vec_id, label, string_agg(printf('%02x', best[2]), '' order by part) as code, sum(best[1])::bigint as error from a{rounds} group by vec_id, label),
 book as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds})
 select vec_id, code, error, label, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from code, book"""
