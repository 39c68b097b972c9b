"""Approximate vector search by an inverted file with residual product codes, its recall measured.

*Build.* Unit vectors are dealt to the nearest of ``cells`` centroids, and the rest (vector minus centroid) is
coded in one byte for each ``SUB`` components. Centroids and code entries are fitted on at most
``SAMPLE`` vectors (those with the smallest hash of the key) in one executor task; every vector is
indexed. Cells are stored in blocks of at most ``BLOCK`` rows, so that a cell with a third of all vectors is
many groups, not one.

*Search.* A query visits its ``probes`` nearest cells. Queries and blocks meet by an equi-join on cell and block;
inside, a row's score is a sum of table entries. The best ``k * refine`` rows of each query are scored anew with
their vectors in double precision.

*Recall.* ``calibrated`` asks with a sample of stored vectors, each left out of its own answer, compares with the
exact search, and takes the fewest probes, then the smallest ``refine``, that reach the target. Where this takes
more than half of all pairs the index is marked exact, and ``search`` compares all.

*Exact answers.* ``search_exact`` takes the k-th score of the approximate answer as a bound: a row nearer than that lies in a cell
whose centroid is no farther from the query than the bound's distance and the cell's radius together. These cells are compared in
double precision with the vectors as given, all others are passed over, so its rows and scores are those of the exact search.

Defined results: null, zero and non-finite vectors and vectors of another length than the most frequent one are not
indexed and, as queries, get no rows; repeated keys are rows of their own; an empty table gives no rows. Ties at
nine decimals fall to the smaller key.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..sources.shared import materialise
from . import scan, vector

SAMPLE, SUB, CODES, BLOCK, ROUNDS, SEED = 50_000, 4, 256, 4096, 12, 13
TARGET, ASKED, MOST_SHARE = 0.9, 200, 0.5
#: Queries that meet one block in one group.
BATCH = 2048


@dataclass(frozen=True)
class AnnIndex:
    """``rows(key, cell, block, code, unit, embedding)``; centroids (cell, component); books (part, entry, component).

    recall and share: of the calibration, None before it; exact: the search compares all pairs.
    """

    rows: DataFrame
    centroids: np.ndarray
    books: np.ndarray
    probes: int = 1
    refine: int = 4
    recall: float | None = None
    share: float | None = None
    exact: bool = False


def _units(rows: DataFrame, name: str, vector_column: str) -> DataFrame:
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(name), v.alias("v")).where(fine).withColumn("_n", norm(F.col("v"))).where((F.col("_n") > 0) & (F.col("_n") < float("inf")))
    return kept.select(name, F.transform("v", lambda x: (x / F.col("_n")).cast("float")).alias("unit"), F.col("v").alias("embedding"))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from ``k`` of the rows; an empty cell takes the row farthest from its centroid."""
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        near, gap = _nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c, dtype=np.float64)
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c).astype(np.float32)
        for cell, row in zip(np.flatnonzero(count == 0), np.argsort(-gap, kind="stable")):
            c[cell] = x[row]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, gap = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    half = (c.astype(np.float64) ** 2).sum(axis=1) / 2
    for at in range(0, len(x), 4096):
        score = half - x[at : at + 4096].astype(np.float64) @ c.T.astype(np.float64)
        near[at : at + 4096] = score.argmin(axis=1)
        gap[at : at + 4096] = score.min(axis=1)
    return near, gap


def _rest(x: np.ndarray, c: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Residuals in parts of ``SUB`` components, the last filled with zeros: (part, row, component)."""
    rest = x - c[cell]
    pad = -rest.shape[1] % SUB
    return np.pad(rest, ((0, 0), (0, pad))).reshape(len(x), -1, SUB).transpose(1, 0, 2)


def _fit(cells: int):
    def run(batches):
        rows = [v for batch in batches for v in batch.column(1).to_pylist()]
        x = np.array(rows, dtype=np.float32)
        rng = np.random.default_rng(SEED)
        c = _means(x, min(cells, len(x)), ROUNDS, rng)
        parts = _rest(x, c, _nearest(x, c)[0])
        books = np.stack([np.resize(_means(p, min(CODES, len(p)), ROUNDS // 2, rng), (CODES, SUB)) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([a.astype("<f4").tobytes()], pa.binary()) for a in (c, books)], ["centroids", "books"])

    return run


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float32)


def _coded(c: np.ndarray, books: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _vectors(part.column(1))
                cell = _nearest(x, c)[0]
                code = np.stack([_nearest(p, b)[0] for p, b in zip(_rest(x, c, cell), books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell), pa.array([r.tobytes() for r in code], pa.binary()), part.column(1), part.column(2)], ["key", "cell", "code", "unit", "embedding"])

    return run


def build(vectors: DataFrame, cells: int | None = None) -> AnnIndex | None:
    """Index of vectors(key, embedding); about the square root of their number of cells, 4096 at most. None without a usable vector."""
    units = _units(vectors, "key", "embedding")
    widths = units.groupBy(F.size("unit").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return None
    units = units.where(F.size("unit") == widths["w"])
    cells = cells or max(1, min(4096, round(widths["count"] ** 0.5)))
    # bounded: the sample meets in one task
    sample = units.orderBy(F.xxhash64(F.lit(SEED), "key"), "key", "unit").limit(SAMPLE).repartition(1).sortWithinPartitions("key", "unit")
    made = sample.mapInArrow(_fit(cells), "centroids binary, books binary").first()
    c = np.frombuffer(made["centroids"], "<f4").reshape(-1, widths["w"])
    books = np.frombuffer(made["books"], "<f4").reshape(-1, CODES, SUB)
    kind = units.schema["key"].dataType.simpleString()
    rows = units.mapInArrow(_coded(c, books), f"key {kind}, cell long, code binary, unit array<float>, embedding array<double>")
    sizes = rows.groupBy("cell").count()
    # at most one row a cell
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("key", "code"), F.ceil(F.col("count") / BLOCK)))
    return AnnIndex(materialise(dealt.select("key", "cell", "block", "code", "unit", "embedding")), c, books)


def save(index: AnnIndex, path: str) -> None:
    """Rows by cell: a search reads the folders of the cells that its queries visit. Centroids, entries and settings beside them."""
    spark = index.rows.sparkSession
    index.rows.repartition("cell", "block").write.partitionBy("cell").parquet(f"{path}/rows")
    shape = [(index.centroids.tobytes(), index.books.tobytes(), index.centroids.shape[1], index.probes, index.refine, index.recall, index.share, index.exact)]
    spark.createDataFrame(shape, "centroids binary, books binary, width int, probes int, refine int, recall double, share double, exact boolean").write.parquet(f"{path}/settings")


def load(spark, path: str) -> AnnIndex:
    s = spark.read.parquet(f"{path}/settings").first()
    rows = spark.read.parquet(f"{path}/rows").withColumn("cell", F.col("cell").cast("long"))
    c, books = np.frombuffer(s["centroids"], "<f4").reshape(-1, s["width"]), np.frombuffer(s["books"], "<f4").reshape(-1, CODES, SUB)
    return AnnIndex(rows, c, books, s["probes"], s["refine"], s["recall"], s["share"], s["exact"])


def _visits(c: np.ndarray, probes: int):
    """Queries -> their nearest cells, nearest first."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _vectors(part.column(1))
                gap = (c.astype(np.float64) ** 2).sum(axis=1) / 2 - x.astype(np.float64) @ c.T.astype(np.float64)
                order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
                take = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
                turn = np.tile(np.arange(order.shape[1]), len(x))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(order.ravel().astype(np.int64)), pa.array(turn)], ["query_id", "q", "cell", "turn"])

    return run


def visits(index: AnnIndex, queries: DataFrame, probes: int) -> DataFrame:
    """``(query_id, q, cell, turn)``: the cells that each query visits."""
    asked = _units(queries, "query_id", "embedding").where(F.size("unit") == index.centroids.shape[1])
    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.mapInArrow(_visits(index.centroids, probes), f"query_id {kind}, q array<float>, cell long, turn long")


def _scored(c: np.ndarray, books: np.ndarray, keep: int, without_self: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block and the queries that visit it -> each query's best rows by code."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "key": right.column("key").slice(0, 0), "near": pa.array([], pa.float64())})
        q = np.array(left.column("q").to_pylist(), dtype=np.float64)
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint8).reshape(right.num_rows, -1)
        cell = left.column("cell")[0].as_py()
        parts = np.pad(q, ((0, 0), (0, -q.shape[1] % SUB))).reshape(len(q), -1, SUB)
        near = np.repeat((q @ c[cell].astype(np.float64))[:, None], len(code), axis=1)
        for p, book in enumerate(books):
            near += (parts[:, p] @ book.T.astype(np.float64))[:, code[:, p]]
        if without_self:
            near[np.array(left.column("query_id").to_pylist())[:, None] == np.array(right.column("key").to_pylist())[None]] = -np.inf
        n = min(keep, len(code))
        best = np.argpartition(-near, n - 1, axis=1)[:, :n]
        i = np.repeat(np.arange(len(q)), n)
        return pa.table({"query_id": left.column("query_id").take(pa.array(i)), "key": right.column("key").take(pa.array(best.ravel())), "near": pa.array(near[i, best.ravel()])})

    return run


def search(index: AnnIndex, queries: DataFrame, k: int = 5, probes: int | None = None, refine: int | None = None, without_self: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """``(query_id, key, score, rank)``: about the k nearest rows of each query; exactly, if the index is marked exact.

    vectors(key, embedding), if given, are what the exact search reads; else the index's unit vectors, in single precision.
    """
    if index.exact and probes is None:
        stored = index.rows.select("key", F.col("unit").alias("embedding")) if vectors is None else vectors
        return vector.search(stored, queries, k)
    keep = k * (refine or index.refine)
    asked = visits(index, queries, probes or index.probes)
    blocks = index.rows.groupBy("cell").agg(F.max("block").alias("last"))
    kinds = {"key": index.rows.schema["key"].dataType.simpleString(), "query_id": asked.schema["query_id"].dataType.simpleString()}
    # one row a cell
    dealt = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    n = queries.count()
    batches = -(-n // BATCH) or 1
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)))
    # at most one row a cell; where the rows are stored by cell, only the folders of visited cells are read
    wanted = F.broadcast(asked.select("cell").distinct())
    rows = index.rows.join(wanted, "cell", "left_semi").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    on = ("cell", "block", "batch")
    near = dealt.select(*on, "query_id", "q").groupBy(*on).cogroup(rows.select(*on, "key", "code").groupBy(*on)).applyInArrow(
        _scored(index.centroids, index.books, keep, without_self), f"query_id {kinds['query_id']}, key {kinds['key']}, near double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "key")
    some = near.where(F.col("near") > float("-inf")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).select("query_id", "key").distinct()
    full = some.join(index.rows.select("key", "unit"), "key").join(_units(queries, "query_id", "embedding").select("query_id", F.col("unit").alias("q")), "query_id")
    score = dot(F.col("unit"), F.col("q")) / (norm(F.col("unit")) * norm(F.col("q")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    ranked = full.select("query_id", "key", score.alias("score")).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= k)


def _radii(c: np.ndarray):
    """Rows (cell, unit) -> each batch's largest distance from a centroid, by cell."""

    def run(batches):
        for batch in batches:
            cell = batch.column(0).to_numpy()
            gap = np.sqrt(((_vectors(batch.column(1)).astype(np.float64) - c[cell]) ** 2).sum(axis=1))
            most = np.full(len(c), -1.0)
            np.maximum.at(most, cell, gap)
            held = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(most[held])], ["cell", "radius"])

    return run


def _reached(c: np.ndarray, radius: np.ndarray):
    """Queries (query_id, q, embedding, bound) -> a row for each cell that may hold a row at the bound or above; a null bound reaches all."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                x = _vectors(part.column(1)).astype(np.float64)
                bound = part.column(3).fill_null(-1.0).to_numpy()
                away = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (c.astype(np.float64) ** 2).sum(axis=1) - 2 * x @ c.T.astype(np.float64)))
                row, cell = np.nonzero(away - radius <= (np.sqrt(np.maximum(0, 2 - 2 * bound)) + 1e-3)[:, None])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), part.column(3).take(at), pa.array(cell.astype(np.int64))], ["query_id", "embedding", "bound", "cell"])

    return run


def _compared(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block and the queries that reach its cell -> rows that may be among their k best, with cosines."""
        left, right = left.combine_chunks(), right.combine_chunks()
        out = [pa.table({"query_id": left.column("query_id").slice(0, 0), "key": right.column("key").slice(0, 0), "score": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            one = lambda t, name: pa.concat_arrays(t.column(name).chunks)
            ids, q, keys = one(left, "query_id"), scan.matrix(one(left, "embedding")), one(right, "key")
            best = scan.Best(len(q), k, one(left, "bound").fill_null(-np.inf).to_numpy(zero_copy_only=False))
            length = np.sqrt(scan.ordered_dot(q, q))
            x, size = scan.matrix(one(right, "embedding")), scan.step(len(q))
            for i in range(0, len(x), size):
                row, query, score = scan.scored(best, x[i : i + size], q, length, keys.slice(i, size))
                out.append(pa.table({"query_id": ids.take(pa.array(query)), "key": keys.slice(i, size).take(pa.array(row)), "score": pa.array(score)}))
        return pa.concat_tables(out)

    return run


def search_exact(index: AnnIndex, queries: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """``(query_id, key, score, rank)``: the k nearest rows of each query, exactly; query ids are unique."""
    if index.exact:
        return search(index, queries, k, vectors=vectors)
    bound = search(index, queries, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    # at most one row a cell
    found = dict(index.rows.select("cell", "unit").mapInArrow(_radii(index.centroids), "cell long, radius double").groupBy("cell").agg(F.max("radius")).collect())
    radius = np.array([found.get(i, -np.inf) for i in range(len(index.centroids))])
    asked = _units(queries, "query_id", "embedding").where(F.size("unit") == index.centroids.shape[1]).join(bound, "query_id", "left")
    kind, key = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index.rows, "key")))
    # the approximate scores are of single precision
    near = asked.select("query_id", "unit", "embedding", (F.col("bound") - 1e-5).alias("bound"))
    near = near.mapInArrow(_reached(index.centroids, radius), f"query_id {kind}, embedding array<double>, bound double, cell long")
    blocks = index.rows.groupBy("cell").agg(F.max("block").alias("last"))
    batches = -(-queries.count() // BATCH) or 1
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    near = near.join(F.broadcast(blocks), "cell").withColumn("block", upto(F.col("last"))).withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)))
    on = ("cell", "block", "batch")
    rows = index.rows.withColumn("batch", upto(F.lit(batches - 1).cast("long"))).select(*on, "key", "embedding")
    pairs = near.select(*on, "query_id", "embedding", "bound").groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(_compared(k), f"query_id {kind}, key {key}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def exact_without_self(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The exact search where a stored vector that asks is not its own answer."""
    return vector.search(stored, queries, k + 1).where(F.col("query_id") != F.col("key")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    ).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, key) pairs that were found."""
    hit = F.count("found").cast("double")
    got = truth.select("query_id", "key").join(found.select("query_id", "key", F.lit(1).alias("found")), ["query_id", "key"], "left").agg((hit / F.count("*")).alias("r")).first()[0]
    return 1.0 if got is None else got


def calibrated(index: AnnIndex, k: int = 5, target: float = TARGET, asked: int = ASKED) -> AnnIndex:
    """The index with probes and refine that reach the target on a sample of its own vectors, and what was measured."""
    stored = index.rows.select("key", F.col("unit").alias("embedding"))
    sample = materialise(index.rows.orderBy(F.xxhash64(F.lit(SEED + 1), "key"), "key").limit(asked).select(F.col("key").alias("query_id"), F.col("unit").alias("embedding")))
    truth = materialise(exact_without_self(stored, sample, k))
    n_cells = len(index.centroids)
    # the turn at which a query visits the cell of each of its true neighbours gives recall by number of probes
    turns = visits(index, sample, n_cells).select("query_id", "cell", "turn")
    sizes = index.rows.groupBy("cell").count()
    met = truth.join(index.rows.select("key", "cell"), "key").join(turns, ["query_id", "cell"]).groupBy("turn").count()
    seen = turns.join(F.broadcast(sizes), "cell").groupBy("turn").agg(F.sum("count").alias("rows"))
    hits, rows = ({r[0]: r[1] for r in df.collect()} for df in (met, seen))
    total_hits, total_rows = max(1, sum(hits.values())), max(1, sum(rows.values()))
    got, share, probes = 0.0, 0.0, 0
    while probes < n_cells and (got < min(1.0, target + 0.02) or probes == 0):
        got += hits.get(probes, 0) / total_hits
        share += rows.get(probes, 0) / total_rows
        probes += 1
    if share > MOST_SHARE:
        return dataclasses.replace(index, probes=n_cells, recall=1.0, share=1.0, exact=True)
    for refine in (4, 16, 64):
        reached = recall(search(index, sample, k, probes, refine, without_self=True), truth)
        if reached >= target:
            return dataclasses.replace(index, probes=probes, refine=refine, recall=reached, share=share)
    return dataclasses.replace(index, probes=n_cells, recall=1.0, share=1.0, exact=True)
