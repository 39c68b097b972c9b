"""Words of many texts at once: offsets and 64-bit hashes by prefix sums, no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


#: Bytes hashed at a time; long buffers are cut at white space, so a block is longer only for a longer word.
BLOCK = 1 << 19
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; those of up to two blocks stay in memory."""
    if n <= len(_POWERS[0]):
        return [p[:n] for p in _POWERS]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 2 * BLOCK:
        _POWERS[:] = made
    return made


def _block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of the words of lowered bytes."""
    space = SPACE[b]
    edge = np.flatnonzero(space[:-1] != space[1:]) + 1 if len(b) else np.zeros(0, dtype=np.int64)
    edge = np.concatenate((np.zeros(int(len(b) > 0 and not space[0]), dtype=np.int64), edge, np.full(int(len(b) > 0 and not space[-1]), len(b), dtype=np.int64)))
    lo, hi = edge[::2], edge[1::2]
    power, back = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(7)) * power[:-1], out=sums[1:])
    return lo, hi, mixed((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64) * MIX[2])


class Words:
    """Words (maximal runs of non-white-space, A-Z lowered) of a list of UTF-8 texts.

    text, lo, hi: the word's text number and byte offsets in its text; hash: of its lowered bytes;
    first: where each text's words begin, and their total.
    """

    def __init__(self, raw: list[bytes]):
        b = LOWER[np.frombuffer(b"\n".join(raw), dtype=np.uint8)]
        found, at = [], 0
        while at < len(b) or not found:
            end = min(len(b), at + BLOCK)
            while end < len(b) and not SPACE[b[end]]:
                ahead = np.flatnonzero(SPACE[b[end : end + BLOCK]])
                end = end + int(ahead[0]) if len(ahead) else min(len(b), end + BLOCK)
            lo, hi, h = _block(b[at:end])
            found.append((lo + at, hi + at, h))
            at = end
        lo, hi, self.hash = (np.concatenate(c) if len(found) > 1 else c[0] for c in zip(*found))
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))
        self.text = np.searchsorted(begin, lo, side="right") - 1
        self.lo, self.hi = lo - begin[self.text], hi - begin[self.text]
        self.first = np.searchsorted(self.text, np.arange(len(raw) + 1))


def text_groups(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 19, text_column: int = 1, most_rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about ``most_bytes`` of text and at most ``most_rows`` rows, a null text as empty."""
    for batch in batches:
        first, held, size = 0, [], 0
        for i, value in enumerate(batch.column(text_column)):
            text = value.as_py() or b""
            held.append(text if isinstance(text, bytes) else text.encode())
            size += len(held[-1])
            if size >= most_bytes or len(held) >= most_rows:
                yield batch.slice(first, i + 1 - first), held
                first, held, size = i + 1, [], 0
        if held:
            yield batch.slice(first), held


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every n-gram inside one text."""
    if len(w.hash) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = w.hash[: len(w.hash) - n + 1].copy()
    for k in range(1, n):
        h = mixed(h + MIX[2]) + w.hash[k : len(w.hash) - n + 1 + k]
    inside = np.flatnonzero(w.text[: len(h)] == w.text[n - 1 :])
    return inside, mixed(h[inside])
