"""Best rows of bounded query sets in one scan of the stored rows: the core of exact vector search and of lexical search without an index.

Queries are arrays in every task; stored rows come in Arrow batches and are scored against all queries in slices of bounded
size. A task emits a row for a query only if it is among the k best of its slice and not below the k-th of an earlier one, so what is
shuffled grows with tasks times queries times k, never with pairs. Order: score at nine decimals, then the smaller key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a slice, and numbers gathered at once.
ROWS, NUMBERS = 2048, 4_000_000
#: Scores this close below a k-th best are kept: they may tie at nine decimals.
ROOM = 2e-9


class Best:
    """The k best of each query, slice by slice; ``floor`` is a bound below each query's k-th best score."""

    def __init__(self, n_queries: int, k: int, floor: np.ndarray | float = -np.inf):
        self.k, self.floor = k, np.full(n_queries, floor, dtype=np.float64)

    def candidates(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of near(row, query) that may be among the k best."""
        held = near >= self.floor - ROOM
        # queries with more than k rows: their k-th best raises the bound
        many = np.flatnonzero(np.count_nonzero(held, axis=0) > self.k)
        if len(many):
            some = near[:, many]
            self.floor[many] = np.maximum(self.floor[many], np.partition(some, len(some) - self.k, axis=0)[len(some) - self.k])
            held[:, many] = some >= self.floor[many] - ROOM
        return np.nonzero(held)

    def cut(self, row: np.ndarray, query: np.ndarray, score: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Positions of the k best of each query among candidates."""
        if not len(row):
            return np.zeros(0, dtype=np.int64)
        if np.bincount(query).max() <= self.k:
            return np.arange(len(row))
        t = pa.table({"q": pa.array(query), "s": pa.array(np.floor(score * 1e9 + 0.5)), "key": keys.take(pa.array(row))})
        at = pc.sort_indices(t, sort_keys=[("q", "ascending"), ("s", "descending"), ("key", "ascending")], null_placement="at_start").to_numpy()
        q = query[at]
        first = np.concatenate(([True], q[1:] != q[:-1]))
        turn = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        return at[turn < self.k]


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up in order of the components: equal to the native column to the bit."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def scored(best: Best, x: np.ndarray, q: np.ndarray, q_length: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, cosine) of the rows ``x`` that may be among the best of the queries ``q``."""
    length = np.sqrt(ordered_dot(x, x))
    row, query = best.candidates((x / length[:, None]) @ (q / q_length[:, None]).T)
    score = np.concatenate([ordered_dot(x[row[i : i + 65536]], q[query[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    score /= length[row] * q_length[query]
    at = best.cut(row, query, score, keys)
    return row[at], query[at], score[at]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def step(n_queries: int) -> int:
    return max(64, min(ROWS, NUMBERS // max(1, n_queries)))


def nearest(ids: pa.Array, q: np.ndarray, k: int, least: float = -np.inf):
    """Batches (key, embedding) of sound vectors of the queries' length -> (query_id, key, score), rows below ``least`` left out."""
    q_length = np.sqrt(ordered_dot(q, q))

    def run(batches):
        best = Best(len(q), k, least)
        for whole in batches:
            for batch in (whole.slice(i, step(len(q))) for i in range(0, whole.num_rows, step(len(q)))):
                row, query, score = scored(best, matrix(batch.column(1)), q, q_length, batch.column(0))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch.column(0).take(pa.array(row)), pa.array(score)], ["query_id", "key", "score"])

    return run


def coded(tokens: pa.Array):
    """Batches (key, tokens) -> (key, dl, codes): the number of tokens, and the places in ``tokens`` of those that occur there."""

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                lists = batch.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pc.fill_null(pc.index_in(lists.flatten().cast(tokens.type), value_set=tokens), -1).to_numpy(zero_copy_only=False)
                known = code >= 0
                held = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
                offsets = np.concatenate(([0], np.cumsum(held))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[known].astype(np.int32)))], ["key", "dl", "codes"])

    return run


def weighed(ids: pa.Array, place: np.ndarray, query: np.ndarray, idf: np.ndarray, n_tokens: int, k1: float, b: float, avgdl: float, k: int):
    """Batches (key, dl, codes) -> (query_id, key, score): BM25 with the idf of each (token's place, query)."""

    def run(batches):
        weights = np.zeros((n_tokens, len(ids)))
        np.add.at(weights, (place, query), idf)
        best, most = Best(len(ids), k), max(1, NUMBERS // max(1, len(ids)))
        for whole in batches:
            lists = whole.column(2)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, codes = np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy(zero_copy_only=False)
            factor = (k1 + 1) / (1 + k1 * (1 - b + b * whole.column(1).to_numpy(zero_copy_only=False) / avgdl))
            lo = 0
            while lo < len(sizes):
                # rows whose codes fit together, at least one
                hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1))
                some = np.arange(lo, hi)[sizes[lo:hi] > 0]
                near = np.add.reduceat(weights[codes[upto[lo] : upto[hi]]], upto[some] - upto[lo], axis=0) * factor[some, None] if len(some) else np.zeros((0, len(ids)))
                # a chunk without one of a query's tokens is no hit
                row, q = best.candidates(np.where(near > 0, near, -np.inf))
                hit = near[row, q] > 0
                row, q = row[hit], q[hit]
                keys = whole.column(0).slice(lo, hi - lo)
                at = best.cut(some[row] - lo, q, near[row, q], keys)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[at])), keys.take(pa.array(some[row[at]] - lo)), pa.array(near[row[at], q[at]])], ["query_id", "key", "score"])
                lo = hi

    return run
