"""Model interfaces and deterministic offline stand-ins.

A model is any object with the method named here, safe to call from several threads; it is shipped to the workers. Requests
run in a window that reaches over Arrow batches: up to ``concurrent`` of a task's are under way, answers keep the rows' order, and
no more than two batches are held. A request that fails is tried again after a pause; one that keeps failing gives an empty
result, never a failed job.
"""

from __future__ import annotations

import hashlib
import re
import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any, Iterator, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Llm(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashEmbedder:
    """Signed hashes of words added up, unit length; empty texts give an empty vector (a failed embedding)."""

    #: Words whose hashes are remembered at once.
    REMEMBERED = 200_000

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def _place(self, word: str) -> int:
        """Component of a word, and the sign: components beyond ``dimension`` are subtracted."""
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h % self.dimension + (0 if h >> 63 else self.dimension)

    def embed(self, texts: list[str]) -> list[list[float]]:
        known: dict[str, int] = {}
        out = []
        for text in texts:
            words = re.findall(r"\w+", (text or "").lower())
            if len(known) > self.REMEMBERED:
                known = {}
            for word in set(words).difference(known):
                known[word] = self._place(word)
            counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=2 * self.dimension)
            v = (counts[: self.dimension] - counts[self.dimension :]).astype(np.float64)
            n = float((v * v).sum()) ** 0.5
            out.append((v / n).tolist() if n else [])
        return out


class OverlapReranker:
    """Share of the query's words that the content holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(re.findall(r"\w+", t.lower()))
        return [len(words(q) & words(c)) / max(1, len(words(q))) for q, c in pairs]


class RuleLlm:
    """Answers each task's prompt by its first line, in the format that the task asks for."""

    def complete(self, prompt: str) -> str:
        task, _, rest = prompt.partition("\n")
        if task == "TASK decompose":
            parts = [p.strip() for p in re.split(r"\band\b|[?.;]", rest) if len(p.strip()) > 5]
            return "[" + ", ".join('"' + p.replace('"', "'").replace("\\", " ").replace("\n", " ") + '"' for p in parts[:4]) + "]"
        if task == "TASK check":
            return '{"complete": true, "confidence": 0.8, "gaps": []}'
        if task == "TASK judge":
            return f'{{"score": {min(1.0, len(set(rest.lower().split())) / 100):.2f}, "reason": "variety"}}'
        if task == "TASK navigate":
            ids = re.findall(r"\[([\d.]+)\]", rest)[:4]
            return '{"relevant_nodes": [' + ", ".join(f'"{i}"' for i in ids) + "]}"
        return rest[:300]


def tried(call: Callable[[Any], Any], attempts: int, pause: float) -> Callable[[Any], Any]:
    """``call``, up to ``attempts`` times with doubling pauses (seconds) in between; the last error is raised."""

    def run(request):
        for i in range(attempts - 1):
            try:
                return call(request)
            except Exception:  # noqa: BLE001  a model may fail in any way
                time.sleep(pause * 2**i)
        return call(request)

    return run


def in_window(batches: Iterator[list], call: Callable[[Any], Any], concurrent: int) -> Iterator[list]:
    """Answers of each batch, in order. The next batch's requests start while the last one's slow ones are still under way."""
    free = threading.Semaphore(concurrent)
    held: deque[list[Future]] = deque()
    with ThreadPoolExecutor(concurrent) as pool:
        for batch in batches:
            futures = []
            for request in batch:
                free.acquire()
                futures.append(pool.submit(call, request))
                futures[-1].add_done_callback(lambda _: free.release())
            held.append(futures)
            while len(held) > 1 or (held and all(f.done() for f in held[0])):
                yield [f.result() for f in held.popleft()]
        while held:
            yield [f.result() for f in held.popleft()]


def embed(text: Column, model: Embedder, per_request: int = 256, concurrent: int = 20, attempts: int = 2, pause: float = 0.2) -> Column:
    """``array<double>``; a request that fails is tried text by text, a text that fails gives an empty vector."""

    def vectors(texts: list[str]) -> list[np.ndarray]:
        got = [np.asarray(v, dtype=np.float64) for v in model.embed(texts)]
        if len(got) != len(texts):
            raise ValueError("a model must give one vector a text")
        return got

    def one(t: str) -> np.ndarray | list[float]:
        try:
            return tried(vectors, attempts, pause)([t])[0]
        except Exception:  # noqa: BLE001
            return []

    def request(texts: list[str]) -> list:
        try:
            return vectors(texts)
        except Exception:  # noqa: BLE001
            return [one(t) for t in texts]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = ((lambda v: [v[i : i + per_request] for i in range(0, len(v), per_request)])(b.fillna("").tolist()) for b in batches)
        for answers in in_window(cut, request, concurrent):
            yield pd.Series([v for part in answers for v in part], dtype=object)

    return run(text)


def complete(prompt: Column, model: Llm, concurrent: int = 20, attempts: int = 2, pause: float = 0.2) -> Column:
    """Replies; a prompt whose calls all fail gets an empty one."""

    def one(p: str) -> str:
        try:
            return tried(model.complete, attempts, pause)(p)
        except Exception:  # noqa: BLE001
            return ""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for replies in in_window((b.fillna("").tolist() for b in batches), one, concurrent):
            yield pd.Series(replies, dtype=object)

    return run(prompt)


def rerank_with(model: Reranker | None) -> Callable:
    """A reranker for ``hybrid_search``: replaces the score; without a model, or on an error, the order stays and is cut."""

    def run(hits, k: int):
        from .operators.lexical import top_k

        if model is None:
            return hits.where(F.col("rank") <= k)

        @F.pandas_udf("double")
        def score(query: pd.Series, content: pd.Series) -> pd.Series:
            try:
                return pd.Series(model.score(list(zip(query, content))), dtype=float)
            except Exception:  # noqa: BLE001
                return pd.Series([None] * len(query), dtype=float)

        scored = hits.withColumn("rerank_score", score("query", "content"))
        best = F.coalesce(F.col("rerank_score"), -F.col("rank").cast("double"))
        return top_k(scored.withColumn("_best", best).drop("rank"), k, "_best").drop("_best")

    return run
