"""Operator 13: tokens of two tokenizers aligned by byte-owner arrays.

A encodes a space and the text, B the text (it puts the space itself), both without special tokens. Each
token's number is repeated over its bytes; where the pair of owners changes, a new overlap of an
A token with a B token begins (a link), and where both change at once, both tokenizers have a
boundary (a cut): the tokens between cuts are a group.

Texts are encoded in pieces of about ``PIECE`` characters. A piece ends before a single space between
two characters that are not white space: A's pre-tokens always break there, B has no entry that goes on
past such a space (checked when it is loaded; otherwise texts stay whole), and each piece stands to
its own space as the text does to the space put before it. So pieces give the tokens of the whole text.

*Corpus counts.* About ``GROUP`` characters of neighbouring documents are one group of rows: their results,
their distinct id pairs, and for every document which of these it links how often, compressed. The groups
are checkpointed. Pairs of all groups are counted by a grouped sum; a pair's count and whether it is
its A id's highest go back to the groups that hold the pair, by a join on the pair and one on the
group. A frequent pair has one row a group in that join, never one a document.

Defined results: texts that are null, empty, or whose bytes the tokens do not give back have no tokens
(zeros and an empty digest) and count nowhere; a null or repeated ``doc_id`` is a document like any
other, so repeated rows each count; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .token_counts import Encoder

PIECE, BLOCK, GROUP = 1 << 15, 1 << 18, 1 << 22
#: Distinct pairs that a task holds before it hands its counts on.
HELD = 1 << 21
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RESULTS = ("n_a", "n_b", "n_groups", "n_links")


class Plain(Encoder):
    """The byte-level tokenizer; special strings inside texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        if self._twin is None:
            raise ValueError("the first tokenizer must be a plain byte-level BPE file")
        self.bytes = [b""] * len(self.lengths)
        for i in range(len(self.bytes)):
            if i not in self.special.values():
                self.bytes[i] = self._twin.decode_single_token_bytes(i)
        self.ids_of = self._twin.encode_ordinary


class Pieces:
    """A sentencepiece model with the bytes of its entries."""

    def __init__(self, path: str):
        import sentencepiece

        self._lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.breaks = [], True
        for i in range(self._lib.get_piece_size()):
            piece = self._lib.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self._lib.is_byte(i) else piece.replace("▁", " ").encode())
            self.breaks &= self._lib.is_control(i) or self._lib.is_unknown(i) or "▁" not in piece.lstrip("▁")
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return self._lib.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> tuple[Plain, Pieces]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Plain(path_a), Pieces(path_b)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text without the single spaces at which it is cut."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end + 1 if found else end


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> np.ndarray:
    """The digits of the numbers below ``n``, right-aligned, 0 where there is none."""
    wide = len(str(n - 1))
    return np.array([list(str(i).rjust(wide, "\0").encode()) for i in range(n)], dtype=np.uint8)


def owners(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of each link in byte order, and the numbers of the links that begin a group."""
    a, b = np.repeat(np.arange(len(a_len), dtype=np.int32), a_len), np.repeat(np.arange(len(b_len), dtype=np.int32), b_len)
    new_a, new_b = (np.concatenate((np.ones(min(1, len(o)), dtype=bool), o[1:] != o[:-1])) for o in (a, b))
    at = np.flatnonzero(new_a | new_b)
    return a[at].astype(np.int64), b[at].astype(np.int64), np.flatnonzero((new_a & new_b)[at])


class Aligned:
    """Alignment of pieces; results by piece."""

    def __init__(self, texts: list[str], a: Plain, b: Pieces):
        ids_a, ids_b = [a.ids_of(" " + t) for t in texts], b.ids_of(texts)
        raw = [(" " + t).encode() for t in texts]
        self.ok = np.array([b"".join([b.bytes[i] for i in y]) == r and b"".join([a.bytes[i] for i in x]) == r for x, y, r in zip(ids_a, ids_b, raw)], dtype=bool)
        ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, self.ok)] for ids in (ids_a, ids_b))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for x in ids for i in x], dtype=np.int64) for ids in (ids_a, ids_b))
        n = len(texts)
        piece_a = np.repeat(np.arange(n), self.n_a)
        link_a, link_b, starts = owners(a.lengths[flat_a], b.lengths[flat_b])
        self.piece, self.key = piece_a[link_a], flat_a[link_a] * len(b.bytes) + flat_b[link_b]
        self.n_links = np.bincount(self.piece, minlength=n)
        self.n_groups = np.bincount(self.piece[starts], minlength=n)
        # the groups as text: each group's A tokens, then its B tokens
        first_a, first_b = link_a[starts], link_b[starts]
        of_a, of_b = (np.repeat(np.arange(len(starts)), np.diff(np.append(f, len(x)))) for f, x in ((first_a, flat_a), (first_b, flat_b)))
        total = len(flat_a) + len(flat_b)
        place_a, place_b = np.arange(len(flat_a)) + first_b[of_a], np.arange(len(flat_b)) + np.append(first_a[1:], len(flat_a))[of_b]
        number, group, side = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64), np.empty(total, dtype=bool)
        number[place_a], number[place_b] = flat_a, flat_b
        group[place_a], group[place_b] = of_a, of_b
        side[place_a], side[place_b] = False, True
        table = _decimals(max(len(a.bytes), len(b.bytes)))
        text = np.zeros((total, table.shape[1] + 1), dtype=np.uint8)
        text[:, :-1] = table[number]
        same = group[1:] == group[:-1]
        text[:-1, -1] = np.where(same & (side[1:] == side[:-1]), ord(","), np.where(same, ord("|"), ord(";")))
        ends = np.cumsum(self.n_a + self.n_b)
        if total:
            text[ends[ends > 0] - 1, -1] = 0  # no mark after a piece's last token
        shown = text != 0
        upto = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))
        flat = text[shown].tobytes()
        cuts = upto[np.concatenate(([0], ends))].tolist()
        self.groups = [flat[x:y] for x, y in zip(cuts, cuts[1:])]


def _group(number: int, doc_ids: list, texts: list[str], a: Plain, b: Pieces, size: int) -> pa.RecordBatch:
    n, n_keys = len(texts), len(a.bytes) * len(b.bytes)
    totals = {c: np.zeros(n, dtype=np.int64) for c in _RESULTS}
    ok, digests, begun = np.array([bool(t) for t in texts]), [hashlib.sha256() for _ in texts], [False] * n
    held_keys, held_counts = [], []

    def flush(docs, parts):
        done, doc = Aligned(parts, a, b), np.array(docs, dtype=np.int64)
        for c in _RESULTS:
            np.add.at(totals[c], doc, getattr(done, c))
        np.logical_and.at(ok, doc, done.ok)
        for d, text in zip(docs, done.groups):
            digests[d].update(b";" + text if begun[d] else text)
            begun[d] = True
        keys, counts = np.unique(doc[done.piece] * n_keys + done.key, return_counts=True)
        held_keys.append(keys)
        held_counts.append(counts)

    docs, parts, length = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text, size) if b.breaks else [text] * bool(text):
            docs.append(i)
            parts.append(part)
            length += len(part)
            if length >= BLOCK:
                flush(docs, parts)
                docs, parts, length = [], [], 0
    if parts:
        flush(docs, parts)
    keys, counts = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (held_keys, held_counts))
    keys, where = np.unique(keys, return_inverse=True)
    counts = np.bincount(where, counts, len(keys)).astype(np.int64)
    doc, key = keys // n_keys, keys % n_keys
    fine = ok[doc]
    doc, key, counts = doc[fine], key[fine], counts[fine]
    pairs, where = np.unique(key, return_inverse=True)
    press = zstandard.ZstdCompressor(level=1)
    for c in _RESULTS:
        totals[c][~ok] = 0
    shas = [d.hexdigest() if good else "" for d, good in zip(digests, ok)]
    # entries by document: how many each has; which pair each is (as an index), and how often it is linked
    entries = [press.compress(x.astype("<u4").tobytes()) for x in (np.bincount(doc, minlength=n), where, counts)]
    lists = [pa.array([doc_ids], pa.list_(pa.int64())), *(pa.array([totals[c].tolist()], pa.list_(pa.int64())) for c in _RESULTS), pa.array([shas], pa.list_(pa.string()))]
    packed = [press.compress(pairs.astype("<i8").tobytes()), press.compress(np.bincount(where, minlength=len(pairs)).astype("<u4").tobytes()), *entries]
    return pa.RecordBatch.from_arrays([pa.array([number]), *lists, *(pa.array([p], pa.binary()) for p in packed)], _COLUMNS)


_COLUMNS = ["g", "doc_id", *_RESULTS, "sha", "pairs", "documents", "sizes", "which", "times"]
_SCHEMA = "g long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _RESULTS) + ", sha array<string>, " + ", ".join(f"{c} binary" for c in _COLUMNS[-5:])


def _linked(path_a: str, path_b: str, size: int, group: int):
    def run(batches):
        a, b = _pair(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, texts, length = [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(value.as_py() or "")
                length += len(texts[-1])
                if length >= group or len(texts) >= 1 << 14:
                    yield _group(number, ids, texts, a, b, size)
                    number, ids, texts, length = number + 1, [], [], 0
        if texts:
            yield _group(number, ids, texts, a, b, size)

    return run


def _array(value: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), dtype=kind).astype(np.int64)


def _pair_rows(batches):
    """Groups -> one row a distinct pair of the group."""
    for batch in batches:
        for g, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = _array(pairs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), g, dtype=np.int64)), pa.array(keys)], ["g", "key"])


def _pair_counts(batches):
    """Groups -> (pair, documents), added up over as many groups of the task as ``HELD`` allows."""
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def made():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    for batch in batches:
        for pairs, documents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys, where = np.unique(np.concatenate((keys, _array(pairs, "<i8"))), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, _array(documents, "<u4"))), len(keys)).astype(np.int64)
            if len(keys) >= HELD:
                yield made()
                keys, counts = keys[:0], counts[:0]
    yield made()


def _answers(left: pa.Table, right: pa.Table) -> pa.Table:
    """One group, and its pairs with their corpus counts -> its documents' rows."""
    row = {c: left.column(c)[0].as_py() for c in left.column_names}
    n_docs = len(row["doc_id"])
    key, n, best = (right.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "best"))
    by = np.argsort(key)
    n, best = n[by], best[by]  # the group's pairs are its sorted keys
    doc, which, times = np.repeat(np.arange(n_docs), _array(row["sizes"], "<u4")), _array(row["which"], "<u4"), _array(row["times"], "<u4")
    n_best, count_sum = np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
    np.add.at(n_best, doc, times * best[which])
    np.add.at(count_sum, doc, times * n[which])
    out = {"doc_id": pa.array(row["doc_id"], pa.int64())} | {c: pa.array(row[c], pa.int64()) for c in _RESULTS}
    return pa.table(out | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": pa.array(row["sha"], pa.string())})


def linked_groups(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """The documents in groups with their links, checkpointed."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInArrow(_linked(path_a, path_b, piece, group), _SCHEMA))


def pair_counts(groups: DataFrame, n_b: int) -> DataFrame:
    """``(key, n, best)``: for each linked id pair, key = A id * n_b + B id, the documents that hold it and whether none of its A id's has more."""
    counts = cut(groups.select("pairs", "documents").mapInArrow(_pair_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    a = F.expr(f"key div {n_b}")
    most = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_mine", a).join(most, F.col("_mine") == F.col("_a")).select("key", "n", (F.col("n") == F.col("_most")).cast("int").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``."""
    groups = linked_groups(docs, path_a, path_b, piece, group)
    counts = pair_counts(groups, len(_pair(path_a, path_b)[1].bytes))
    held = groups.select("g", "pairs").mapInArrow(_pair_rows, "g long, key long")
    found = held.join(counts, "key").select("g", "key", "n", "best")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*_RESULTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return groups.drop("pairs", "documents").groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_answers, schema)
