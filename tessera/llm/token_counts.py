"""Operator 6: token counts of whole texts, huge documents by overlap resynchronisation.

A text longer than ``CHUNK`` characters is encoded in overlapping chunks with token offsets. Two
neighbouring chunks are spliced at a boundary that is *proven* stable: a white-space character after
a character that is not white space always starts a pre-token, whatever stands further left or
right, and the pre-tokeniser does not look behind. Both chunks must have a token boundary there and
the same tokens up to the next such place of the overlap. If no place qualifies, the overlap is
doubled; when it would reach the last splice, the two chunks become one.

The vocabulary file is the library's own ``.json``. Byte-level files whose merges are in id order
(checked when loading) run through tiktoken's merge engine with the file's ranks and special
strings, which gives the same tokens several times faster; any other file runs through the
tokenizers library itself.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are independent, so ties,
repeated rows and extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 32_768, 512
LIMIT = 1024
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \t\n\r\x0b\x0c]")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(text)`` and the byte length of each token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._twin = self._make_twin(spec)
        if self._twin is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(path)
            self._lib.no_truncation()
            self._lib.no_padding()

    def _make_twin(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
        if spec.get("normalizer") or model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
            return None
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        to_byte, ranks = _byte_of_char(), {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                ranks[bytes(to_byte[c] for c in token)] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        in_order = all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges))
        if not in_order or len(ranks) != 256 + len(merges):
            return None
        import public_tokenizers
        import tiktoken

        self.lengths = np.zeros(max([*model["vocab"].values(), *self.special.values()]) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        for token, i in self.special.items():
            self.lengths[i] = len(token.encode())
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def count(self, text: str) -> int:
        if self._twin is None:
            return len(self._lib.encode(text, add_special_tokens=False))
        return len(self._twin.encode(text, allowed_special="all"))

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and the byte offset after each."""
        if self._twin is None:
            e = self._lib.encode(text, add_special_tokens=False)
            upto = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))).astype(np.int64)
            return np.array(e.ids, dtype=np.int64), upto[[b for _, b in e.offsets]] if e.ids else np.zeros(0, dtype=np.int64)
        ids = np.array(self._twin.encode(text, allowed_special="all"), dtype=np.int64)
        return ids, np.cumsum(self.lengths[ids])


def spliced_count(text: str, ids: Callable[[str], tuple[np.ndarray, np.ndarray]], chunk: int = CHUNK, overlap: int = OVERLAP, holds: tuple[str, ...] = ()) -> int:
    """Tokens of ``text`` from overlapping chunks; equals encoding it whole.

    ``holds``: special strings; a place inside one is never used.
    """
    total, begin, end = 0, 0, min(len(text), chunk)
    left = ids(text[begin:end])
    while end < len(text):
        width = overlap
        while True:
            start = end - width
            if start <= begin + 1:
                # no stable place since the last splice: let the chunk grow instead
                end = min(len(text), 2 * end - begin)
                left = ids(text[begin:end])
                break
            stop = min(len(text), end + chunk)
            right = ids(text[start:stop])
            at = _splice(text, begin, start, end, left, right, holds)
            if at is not None:
                place, n_left = at
                total += n_left
                begin, end = place, stop
                skip = len(text[start:place].encode())
                keep = right[1] > skip
                left = right[0][keep], right[1][keep] - skip
                break
            width *= 2
    return total + len(left[0])


def _splice(text, begin, start, end, left, right, holds) -> tuple[int, int] | None:
    places = [m.start() for m in _STABLE.finditer(text, start + 1, end - 1)]
    for h in holds:
        if any(c.isspace() for c in h):
            places = [p for p in places if h not in text[max(0, p - len(h) + 1) : p + len(h) - 1]]
    if len(places) < 2:
        return None
    head = len(text[begin:start].encode())
    a, b = (len(text[start:p].encode()) for p in (places[0], places[-1]))
    ends_left, ends_right = [np.searchsorted(left[1], head + x) for x in (a, b)], [np.searchsorted(right[1], x) for x in (a, b)]
    on_left = all(i < len(left[1]) and left[1][i] == head + x for i, x in zip(ends_left, (a, b)))
    on_right = all(i < len(right[1]) and right[1][i] == x for i, x in zip(ends_right, (a, b)))
    (la, lb), (ra, rb) = ends_left, ends_right
    if on_left and on_right and np.array_equal(left[0][la + 1 : lb + 1], right[0][ra + 1 : rb + 1]):
        return places[0], int(la) + 1
    return None


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _counts(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                n_bytes, n_tokens = [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                    n_tokens.append(enc.count(text) if len(text) <= chunk else spliced_count(text, enc.ids, chunk, overlap, tuple(enc.special)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per document."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counts(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
