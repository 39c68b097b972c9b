"""Operator 8: byte-level BPE encoding and decoding without a regex.

Texts are arrays of code points. A class table (letter, number, white space, other), built once from
the Unicode properties, and a little lookahead give each character a symbol; an eight-state machine
over the symbols says where a pre-token starts. A symbol acts on the machine as a function from
state to state; functions compose associatively, so blocks of 64 characters are reduced to one
function each, the blocks are combined in doubling steps, and a second pass over all blocks at once
writes the boundaries. The slices between boundaries go through a bounded cache of merged pieces.
Every id keeps the byte offset at which it ends; decoding gathers the ids' bytes.

Machine: the pattern's contractions are recognised only where a pre-token starts at the apostrophe;
a run of white space before a character keeps its last one apart, and if that is a space it joins
the following letters, numbers or other characters.

Defined results: a null text counts as empty (no ids; digests of the empty string); rows are
independent, so ties, repeated rows and extra columns do not matter; an empty table gives no rows;
a piece of any length is merged whole, long ones through a heap. A long text is encoded in fragments
cut before a single space between two other characters: a pre-token starts there whatever came
before, so the fragments' ids are the text's. A vocabulary of more than a million mergeable pairs is
refused.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)
# symbols: letter, number, other, apostrophe before a contraction of one or two letters, white space
# inside a run, the last of a run (space; other), end of a text
SYM_L, SYM_N, SYM_O, SYM_A1, SYM_A2, SYM_S, SYM_SX, SYM_WX, SYM_END = range(9)
# states: fresh, in letters, in numbers, in other, in white space, after a joining space, one or two
# contraction letters to come
FRESH, IN_L, IN_N, IN_O, IN_S, JOIN, C1, C2 = range(8)
BLOCK, GROUP_CHARS, CACHE = 64, 1 << 18, 100_000
NO_MERGE = 1 << 40
# hash table of the pairs that merge
_BITS = 21
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - _BITS)
#: Ends a text; not a code point.
SENTINEL = 0x110000


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary bit for (state << 4 | symbol)."""
    to, starts = np.zeros(128, dtype=np.uint8), np.zeros(128, dtype=np.uint8)
    for state in range(8):
        rows = {
            SYM_L: (FRESH, 0) if state == C1 else (C1, 0) if state == C2 else (IN_L, state not in (IN_L, JOIN)),
            SYM_N: (IN_N, state not in (IN_N, JOIN)),
            SYM_O: (IN_O, state not in (IN_O, JOIN)),
            SYM_A1: (IN_O, 0) if state in (IN_O, JOIN) else (C1, 1),
            SYM_A2: (IN_O, 0) if state in (IN_O, JOIN) else (C2, 1),
            SYM_S: (IN_S, state != IN_S),
            SYM_SX: (JOIN, 1),
            SYM_WX: (FRESH, 1),
            SYM_END: (FRESH, 1),
        }
        for symbol, (after, bit) in rows.items():
            to[state << 4 | symbol], starts[state << 4 | symbol] = after, bit
    return to, starts


TO, STARTS = _machine()
#: Symbols after which the state is the same whatever it was.
_RESETS = np.array([len({TO[s << 4 | x] for s in range(8)}) == 1 for x in range(9)])


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, from the Unicode properties L, N and White_Space."""
    import regex

    table = np.full(SENTINEL + 1, OTHER, dtype=np.uint8)
    points = np.array([*range(0xD800), *range(0xE000, SENTINEL)], dtype="<u4")
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    table[0x20], table[SENTINEL] = SPACE, END
    return table


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points of texts that each end in SENTINEL."""
    kind = class_table()[points]
    out = np.array([SYM_L, SYM_N, SYM_O, SYM_S, SYM_S, SYM_END], dtype=np.uint8)[kind]
    white = (kind == SPACE) | (kind == WHITE)
    before_text = np.zeros(len(kind), dtype=bool)
    before_text[:-1] = kind[1:] <= OTHER
    out[white & before_text] = SYM_WX
    out[(kind == SPACE) & before_text] = SYM_SX
    at = np.flatnonzero(points == 0x27)
    if len(at):
        one, two = points[np.minimum(at + 1, len(points) - 1)], points[np.minimum(at + 2, len(points) - 1)]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SYM_A1
        for a, b in ("re", "ve", "ll"):
            out[at[(one == ord(a)) & (two == ord(b))]] = SYM_A2
    return out


def starts(sym: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each symbol: scan of composed transition functions."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, SYM_END, dtype=np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    # 1. each block's function; one start state is enough for blocks that hold a reset
    fixed = _RESETS[grid].any(axis=0)
    state = np.zeros(blocks, dtype=np.uint8)
    for row in grid:
        state = TO[state << 4 | row]
    maps = np.repeat(state[:, None], 8, axis=1)
    free = np.flatnonzero(~fixed)
    if len(free):
        many = np.repeat(np.arange(8, dtype=np.uint8)[None], len(free), axis=0)
        for row in grid[:, free]:
            many = TO[many << 4 | row[:, None]]
        maps[free] = many
    # 2. prefix composition over blocks by doubling, until every prefix is a constant
    step = 1
    while step < blocks and (maps[:, :1] != maps).any():
        later = maps[step:]
        maps = np.concatenate((maps[:step], np.take_along_axis(later, maps[:-step].astype(np.intp), axis=1)))
        step *= 2
    state = np.concatenate(([FRESH], maps[:-1, FRESH])).astype(np.uint8)
    # 3. boundaries
    out = np.empty(grid.shape, dtype=bool)
    for i, row in enumerate(grid):
        at = state << 4 | row
        out[i], state = STARTS[at], TO[at]
    return out.T.reshape(-1)[:n]


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, with a bounded cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            by_id[i] = token
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * len(by_id) + b] = i
        self.pair_keys = np.full(1 << _BITS, -1, dtype=np.int64)
        self.pair_values = np.zeros(1 << _BITS, dtype=np.int64)
        if len(pairs) * 2 > len(self.pair_keys):
            raise ValueError("the vocabulary has more pairs than the table is laid out for")
        for key, i in pairs.items():
            slot = (key * int(_MIX) % (1 << 64)) >> int(_SHIFT)
            while self.pair_keys[slot] >= 0:
                slot = (slot + 1) & (len(self.pair_keys) - 1)
            self.pair_keys[slot], self.pair_values[slot] = key, i
        self._clear()

    def _clear(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int64), 0
        self.begins, self.counts = [], []

    def _look_up(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids start in ``flat``, and how many they are."""
        if len(self.pieces) > CACHE or self.used > 8 * CACHE:
            self._clear()
        known = self.pieces
        missing = [p for p in dict.fromkeys(pieces) if p not in known]
        for piece, ids in zip(missing, self.merge_all(missing)):
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(ids)] = ids
            known[piece] = len(self.begins)
            self.begins.append(self.used)
            self.counts.append(len(ids))
            self.used += len(ids)
        at = np.array([known[p] for p in pieces], dtype=np.int64)
        return np.array(self.begins, dtype=np.int64)[at], np.array(self.counts, dtype=np.int64)[at]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbouring tokens make, NO_MERGE if none: a probed hash table."""
        key = left * len(self.lengths) + right
        slot = ((key.astype(np.uint64) * _MIX) >> _SHIFT).astype(np.int64)
        out = np.full(len(key), NO_MERGE, dtype=np.int64)
        todo = np.arange(len(key))
        while len(todo):
            found = self.pair_keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.pair_values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            slot[todo] = (slot[todo] + 1) & (len(self.pair_keys) - 1)
        return out

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. All short pieces merge together, the best pair of each in every round."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            if not piece:
                out[k] = np.zeros(0, dtype=np.int64)
            elif piece in self.ranks:
                out[k] = np.array([self.ranks[piece]], dtype=np.int64)
            elif len(piece) > 96:
                out[k] = np.array(self._merge_long(piece), dtype=np.int64)
            else:
                short.append(k)
        if not short:
            return out
        owner = np.repeat(np.array(short), [len(pieces[k]) for k in short])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces[k] for k in short), dtype=np.uint8)]

        def ranks_at(at: np.ndarray) -> np.ndarray:
            got = np.full(len(at), NO_MERGE, dtype=np.int64)
            inner = at[at + 1 < len(ids)]
            inner = inner[owner[inner] == owner[inner + 1]]
            got[np.searchsorted(at, inner)] = self._pair_ranks(ids[inner], ids[inner + 1])
            return got

        rank = ranks_at(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            done = best == NO_MERGE
            for i, n in zip(first[done].tolist(), size[done].tolist()):
                out[owner[i]] = ids[i : i + n].copy()
            at = np.flatnonzero((rank == np.repeat(best, size)) & (rank < NO_MERGE))
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))] if len(at) else at
            ids[at] = rank[at]
            keep = np.repeat(~done, size)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            ids, owner, rank, at = ids[keep], owner[keep], rank[keep], new[at]
            changed = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[changed] = ranks_at(changed)
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def rank(i: int) -> int | None:
            j = end[i]
            return ranks.get(piece[i : end[j]]) if j < n else None

        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, upto = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != upto:
                continue
            j = end[i]
            alive[j], end[i] = False, end[j]
            if end[i] < n:
                before[end[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_group(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text, and the byte offset at which each id ends."""
        raw = "".join(texts).encode()
        sizes = [len(t) for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum(sizes)
        # a sentinel after each text
        whole = np.full(len(points) + len(texts), SENTINEL, dtype=np.uint32)
        where = np.arange(len(points)) + np.repeat(np.arange(len(texts)), sizes)
        whole[where] = points
        begin = starts(symbols(whole))
        # sentinels hold no byte
        width = (1 + (whole > 0x7F) + (whole > 0x7FF) + (whole > 0xFFFF)).astype(np.int64)
        mark = ends + np.arange(len(texts))
        width[mark] = 0
        offset = np.cumsum(width) - width
        cuts = offset[begin]
        first = np.searchsorted(np.flatnonzero(begin), mark)  # the pre-token that is the text's sentinel
        limits = np.append(cuts, len(raw)).tolist()
        pieces = [raw[i:j] for i, j in zip(limits, limits[1:])]
        begins, counts = self._look_up(pieces)
        counts[first] = 0  # the sentinels' empty pieces
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(begins - upto[:-1], counts) + np.arange(upto[-1])]
        out = np.split(ids, upto[first[:-1]])
        return out, [np.cumsum(self.lengths[x]) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        total = int(n.sum())
        at = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.bytes[at].tobytes()


def fragments(text: str, most: int = GROUP_CHARS) -> Iterator[str]:
    """Consecutive parts of about ``most`` characters, cut where a pre-token starts whatever came before."""
    white, at = class_table(), 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while 0 <= cut < len(text) - 1 and (white[ord(text[cut - 1])] in (SPACE, WHITE) or white[ord(text[cut + 1])] in (SPACE, WHITE)):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _groups(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of texts of at most about GROUP_CHARS characters; a longer text makes a run of its own."""
    held, size, first = [], 0, 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if held and (size + len(text) > GROUP_CHARS or len(held) >= 1024):
            yield first, i, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, len(column), held


def _encode(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for a, b, texts in _groups(batch.column(1)):
                if len(texts) == 1 and len(texts[0]) > GROUP_CHARS:
                    ids = [np.concatenate([vocab.encode_group([part])[0][0].astype(np.int32) for part in fragments(texts[0])])]
                    offsets = [np.cumsum(vocab.lengths[ids[0]])]
                else:
                    ids, offsets = vocab.encode_group(texts)
                upto = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(v).astype(kind)))
                    for v, kind in ((ids, np.int32), (offsets, np.int64))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["doc_id", "ids", "offsets"])

    return run


def _decode(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            col = batch.column(1)
            texts = [vocab.decode(np.array(v.as_py() or [], dtype=np.int64)) for v in col]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return run


def _digests(path: str, with_ids: bool):
    def run(batches):
        vocab = vocabulary(path)
        for part in _encode(path)(batches):
            flat = part.column(1).flatten().to_numpy().astype("<u4")
            upto = part.column(1).offsets.to_numpy()
            n, h_ids, h_text = [], [], []
            for a, b in zip(upto, upto[1:]):
                ids = flat[a:b]
                n.append(int(b - a))
                h_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                h_text.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            cols, names = [part.column(0), pa.array(n, pa.int64()), pa.array(h_ids), pa.array(h_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, part.column(1)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, offsets)``; offsets[i] is the byte at which token i ends."""
    return _rows(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, decoded)`` of rows with ``doc_id`` and ``ids``."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])`` of encoding and decoding every whole text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _rows(docs).mapInArrow(_digests(path, with_ids), schema)
