"""Code-aware recursive text splitter (the one text function without a native form)."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```[\s\S]*?```")
#: Separators of prose, tried in order; each stays at the start of the piece after it.
PROSE = ("\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", " ")
PLAIN = ("\n\n", "\n", " ", "")
SHORTEST = 50
CONTEXT = 300


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of ``text``, the separator at the start of the following piece; without empty pieces."""
    if not sep:
        return list(text)
    head, *tail = text.split(sep)
    return [p for p in (head, *(sep + t for t in tail)) if p]


def _windows(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy windows of neighbouring pieces; the next window starts with up to ``overlap`` characters of the last."""
    out, first, total = [], 0, 0
    for i, piece in enumerate(pieces):
        if total + len(piece) > size and first < i:
            out.append("".join(pieces[first:i]).strip())
            while total > overlap or (total and total + len(piece) > size):
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    out.append("".join(pieces[first:]).strip())
    return [w for w in out if w]


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = PROSE) -> list[str]:
    """Split at the first separator that occurs; pieces that are too long split on with the later ones."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    later = separators[at + 1 :] if separators[at] else ()
    out: list[str] = []
    run: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            run.append(piece)
            continue
        if run:
            out += _windows(run, size, overlap)
            run = []
        out += split_recursive(piece, size, overlap, later) if later else [piece]
    return out + (_windows(run, size, overlap) if run else [])


def _pack(parts: list[str], size: int) -> tuple[list[list[str]], list[str]]:
    """Closed groups of parts within ``size`` (separators do not count), and the open last one."""
    closed, held, total = [], [], 0
    for part in parts:
        if total + len(part) > size:
            if held:
                closed.append(held)
            held, total = [], 0
        held.append(part)
        total += len(part)
    return closed, held


def split_code(block: str, size: int) -> list[str]:
    """A fenced block beyond ``size``, on document separators and wide gaps, then on lines; fenced anew."""
    body = re.sub(r"(?m)^```\w*\n|```$", "", block).strip()
    fenced = lambda parts, glue: f"```\n{glue.join(parts)}\n```"
    out: list[str] = []
    held: list[str] = []
    for part in re.split(r"\n---\n|\n\n\n", body):
        if sum(map(len, held)) + len(part) <= size:
            held.append(part)
            continue
        if held:
            out.append(fenced(held, "\n\n"))
        if len(part) <= size:
            held = [part]
        else:  # the last lines stay open and may be joined by later parts
            closed, held = _pack(part.split("\n"), size)
            out += [fenced(c, "\n") for c in closed]
    return [*out, fenced(held, "\n\n")] if held else out


def _lead(text: str, start: int) -> str | None:
    """The last heading or longer line shortly before a fence."""
    near = text[max(0, start - CONTEXT) : start].strip().split("\n")
    return next((line for line in reversed(near) if line.startswith("#") or len(line) > 20), None)


def split_text(text: str, size: int = 800, overlap: int = 200, code_aware: bool = True) -> list[str]:
    """Chunks of a text. Code-aware: fences stay whole with a line of context, chunks under 50 characters drop."""
    text = text or ""
    if not code_aware:
        return split_recursive(text, size, overlap, PLAIN) if text else []
    chunks, at = [], 0

    def prose(piece: str) -> list[str]:
        piece = piece.strip()
        return split_recursive(piece, size, overlap) if piece else []

    for m in FENCE.finditer(text):
        chunks += prose(text[at : m.start()])
        if len(m.group()) > size:
            chunks += split_code(m.group(), size)
        else:
            lead = _lead(text, m.start())
            chunks.append(m.group() if lead is None else f"{lead}\n\n{m.group()}")
        at = m.end()
    chunks += prose(text[at:])
    tidy = (re.sub(r"\n{4,}", "\n\n", c).strip() for c in chunks)
    return [c for c in tidy if len(c) >= SHORTEST]


def split_column(text: Column, size: int = 800, overlap: int = 200, code_aware: bool = True) -> Column:
    """``array<string>`` of chunks, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap, code_aware))

    return run(text)


#: Characters whose chunks a worker holds at once, but for one longer text.
HELD = 1 << 22


def split_rows(size: int = 800, overlap: int = 200, code_aware: bool = True):
    """Batches whose last column is a text -> a row a chunk: the other columns, ``chunk_index`` from 0, ``content``.

    An Arrow batch may hold thousands of long texts; chunks leave the worker whenever ``HELD`` characters were split.
    """

    def run(batches):
        for batch in batches:
            row, number, chunks, held = [], [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(batch.num_columns - 1)[i].as_py()
                parts = split_text(text, size, overlap, code_aware)
                row += [i] * len(parts)
                number += range(len(parts))
                chunks += parts
                held += len(text or "")
                if held >= HELD or i == batch.num_rows - 1:
                    others = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*others, pa.array(number, pa.int32()), pa.array(chunks, pa.string())], [*batch.schema.names[:-1], "chunk_index", "content"])
                    row, number, chunks, held = [], [], [], 0

    return run
