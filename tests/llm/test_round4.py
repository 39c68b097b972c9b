"""Tests for the findings of round 3."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm.queries")

from tessera.llm import chroma, suffix_dedup  # noqa: E402


def test_equal_pieces_are_settled_without_sorting(monkeypatch):
    asked = []
    sort = suffix_dedup.shared_spans
    monkeypatch.setattr(suffix_dedup, "shared_spans", lambda pieces, *rest: asked.extend(pieces) or sort(pieces, *rest))
    rng = np.random.default_rng(5)
    gram, left, right, other = (rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (20, 30, 30, 30))
    rows = [(1, 7, 100, left + gram + other, 30), (1, 4, 500, left + gram + right, 30), (1, 9, 0, left + gram + rng.integers(65, 90, 30).astype(np.uint8).tobytes(), 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()))], ["key", "doc_id", "lo", "bytes", "at"])
    got = [r for b in suffix_dedup._sort_shard(50, 20)([batch]) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(got) == [(7, 100, 150), (9, 0, 50)]
    assert asked == []


def test_fingerprints_of_many_equal_those_alone():
    rng = np.random.default_rng(2)
    audios = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 255, 256, 495, 496, 511, 512, 3001, 700, 3001)]
    audios[-1] = audios[-3]
    for kind in ("u8", "s16le"):
        together = chroma.fingerprints(audios, kind)
        assert all(np.array_equal(got, chroma.fingerprint(a, kind)) for got, a in zip(together, audios, strict=True))
        frames = [max(0, (len(a) // (1 if kind == "u8" else 2) - chroma.FRAME) // chroma.HOP + 1) for a in audios]
        assert [len(got) for got in together] == [max(0, n - chroma.SPAN + 1) for n in frames]
