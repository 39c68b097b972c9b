"""Operator 11: toxicity by subword bags, averaged into a linear softmax.

A word is a run of non-white-space, lowered, without marks at its ends. Its vector is the mean of the
vectors of its character 3- to 5-grams (with the word's edges), so a misspelling shares most of the
vector of the word it stands for. A window of ``WINDOW`` words has the mean of its words' vectors (at the
end of a text the missing words count as zero vectors), a
linear softmax over two classes gives the window's log odds, and a document's log odds are the
log-sum-exp over its windows: one insult in a very long text counts as much as in a short one,
where a mean over the whole text would lose it.

Vectors and softmax are trained jointly, in numpy, by gradient steps with momentum on whole batches. The
gradient of a gram's vector is a number times the difference of the two class rows, so that a step needs
two passes of numbers over the grams and the width of the vectors only enters once for each distinct
gram. Every ``EVERY`` steps all windows are weighed anew; between them a document goes by its ``TOP``
highest ones, which carry nearly all of its sum. Some of the training words stand in a form with one random edit.

The fit is the only bounded part: at most ``SAMPLE`` characters of labelled documents of ``LONGEST``
at most, taken by shares of a hash of the id, in one executor task. Only the weight of each gram
bucket, 4 bytes times ``BUCKETS``, reaches the driver. Scoring reads whole texts in blocks.

Only ``text`` is read for a score. Defined results: a null text, or one without words, has score 0;
without training rows of both classes every score is 0; grams that training never saw have weight 0; an id
with several labels counts as toxic if one of them says so, an id with several texts trains with the one
of the smallest hash; rows of labels with a null are left out; a null ``doc_id`` is not held out and never
trains; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .words import MIX, mixed

BUCKETS, DIM, WINDOW, GRAMS = 1 << 18, 16, 8, (3, 4, 5)
SAMPLE, LONGEST, SHARES = 20_000_000, 300_000, 64
THRESHOLD, SEED, STEPS, EVERY, TOP = 0.7, 11, 300, 30, 8
#: Step sizes of gram vectors, class rows and intercept; momentum.
RATES, MOMENTUM = (2000.0, 0.02, 0.5), 0.9
#: Grams in fewer places keep weight 0; a gram's steps are scaled by 1 / sqrt(places + PRIOR).
RARE, PRIOR = 10, 200
#: Share of training words that stand in a form with one random edit.
EDITED = 0.15
#: Characters read at a time; a block ends at white space, so it is longer only for a longer word.
BLOCK = 1 << 18
_SPACE = re.compile(r"\s")


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """White space, and marks (punctuation, symbols, control characters), by code point; beyond the table neither."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x10000)]
    space = np.array([chr(c).isspace() for c in range(0x10000)])
    return space, np.array([k in "PSC" for k in kinds]) & ~space


def blocks(text: str) -> Iterator[str]:
    """The text in pieces of about ``BLOCK`` characters that end before white space."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class Bag:
    """Words of a list of short texts: for each word its text, and its number among the distinct words."""

    def __init__(self, texts: list[str]):
        code = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        space_table, mark_table = _tables()
        low = np.minimum(code, 0xFFFF)
        space, mark = space_table[low] & (code < 0x10000), mark_table[low] & (code < 0x10000)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]
        core = np.flatnonzero(~space & ~mark)
        first, last = np.searchsorted(core, lo), np.searchsorted(core, hi) - 1
        some = first <= last
        lo, hi = core[first[some]], core[last[some]] + 1
        # lowering may change a text's length: texts are told apart by the separators that were put in
        breaks = np.flatnonzero(code == 10)
        want = np.cumsum([t.count("\n") + 1 for t in texts])[:-1] - 1
        self.text = np.searchsorted(breaks[want], lo, side="right") if len(texts) > 1 else np.zeros(len(lo), dtype=np.int64)
        width = hi - lo
        owner = np.repeat(np.arange(len(lo)), width)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        key = mixed(code[np.repeat(lo, width) + inside].astype(np.uint64) * MIX[0] + inside.astype(np.uint64) * MIX[2])
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(key, dtype=np.uint64)))
        upto = np.cumsum(width)
        hashed = mixed(sums[upto] - sums[upto - width] + width.astype(np.uint64)) if len(width) else np.zeros(0, dtype=np.uint64)
        self.hash, where, self.word = np.unique(hashed, return_index=True, return_inverse=True)
        self._code, self._lo, self._width = code, lo[where], width[where]

    def forms(self) -> list[np.ndarray]:
        """The code points of the distinct words."""
        return [self._code[a : a + n] for a, n in zip(self._lo.tolist(), self._width.tolist())]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word, bucket) of every gram."""
        return _grams(np.concatenate([*self.forms(), np.zeros(0, np.uint32)]), self._width)


def _grams(code: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every gram of words whose code points stand one after the other."""
    size = width + 2
    owner = np.repeat(np.arange(len(width)), size)
    flat = np.ones(len(owner), dtype=np.uint64)  # 1 and 2 are the edges of a word
    begin = np.cumsum(size) - size
    flat[begin + size - 1] = 2
    edges = np.zeros(len(owner), dtype=bool)
    edges[begin] = edges[begin + size - 1] = True
    flat[~edges] = code
    words, buckets = [], []
    h = flat
    for n in range(2, max(GRAMS) + 1):
        h = mixed(h[: max(0, len(flat) - n + 1)] * MIX[1] + MIX[2]) + flat[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            words.append(owner[at])
            buckets.append((mixed(h[at]) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets)


def edited(form: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The word with one letter left out, doubled, replaced or exchanged with the next."""
    if len(form) < 4:
        return form
    at, kind = int(rng.integers(1, len(form) - 1)), int(rng.integers(4))
    if kind == 0:
        return np.delete(form, at)
    if kind == 1:
        return np.insert(form, at, form[at])
    form = form.copy()
    if kind == 2:
        form[at] = rng.integers(48, 58) if rng.random() < 0.5 else rng.integers(97, 123)
    else:
        form[at], form[at + 1] = form[at + 1], form[at]
    return form


def _windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window begins, and its text, for words whose texts ascend."""
    if not len(text):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    place = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    begin = np.flatnonzero(place % WINDOW == 0)
    return begin, text[begin]


def _log_sum_exp(z: np.ndarray, begin: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(z, begin)
    return top + np.log(np.add.reduceat(np.exp(z - np.repeat(top, np.diff(np.append(begin, len(z))))), begin))


def fit(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the intercept: the log odds of class 1 against class 0 of the trained softmax."""
    nothing = np.zeros(BUCKETS, dtype=np.float32), -np.inf
    tokens, owners = [], []
    known: dict[int, int] = {}
    forms: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < BLOCK):
            size += len(texts[end])
            end += 1
        bag = Bag(texts[at:end])
        number = np.empty(len(bag.hash), dtype=np.int32)
        for i, (h, form) in enumerate(zip(bag.hash.tolist(), bag.forms())):
            if (k := known.get(h)) is None:
                k = known[h] = len(forms)
                forms.append(form.copy())
            number[i] = k
        tokens.append(number[bag.word])
        owners.append((bag.text + at).astype(np.int32))
        at = end
    token, owner = (np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in (tokens, owners))
    begin, doc = _windows(owner)
    label = np.array(toxic, dtype=float)
    present = np.unique(doc)
    if not len(present) or label[present].min() == label[present].max():
        return nothing
    rng = np.random.default_rng(seed)
    n_forms = len(forms)
    forms += [edited(f, rng) for f in forms]
    token = token + n_forms * (rng.random(len(token)) < EDITED).astype(np.int32)
    used, token = np.unique(token, return_inverse=True)
    forms = [forms[k] for k in used.tolist()]
    widths = np.array([len(f) for f in forms])
    word, bucket = _grams(np.concatenate(forms), widths)
    by = np.argsort(word, kind="stable")
    word, bucket = word[by], bucket[by]
    del forms, known, by
    seen, gram = np.unique(bucket, return_inverse=True)
    per_word = 1.0 / np.bincount(word, minlength=len(widths))
    places = np.bincount(gram, np.bincount(token, minlength=len(widths))[word], len(seen))
    keep = (places >= RARE)[gram]
    word, gram = word[keep].astype(np.int32), gram[keep].astype(np.int32)
    grams_from = np.searchsorted(word, np.arange(len(widths) + 1))
    group = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    y = label[doc[group]]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    # steps of a gram are scaled by how often it occurs, so that frequent and rare ones move alike
    scale = WINDOW / np.sqrt(places + PRIOR)
    vectors = rng.uniform(-1, 1, (len(seen), DIM)) * 0.01
    rows = np.stack((-(r := rng.uniform(-1, 1, DIM)), r), axis=1)
    bias = np.array([0.0, -1.0])
    params = [vectors, rows, bias]
    moved = [np.zeros_like(p) for p in params]
    ends, chosen = np.append(begin[1:], len(token)), np.arange(len(begin))
    for step in range(steps):
        diff = rows[:, 1] - rows[:, 0]
        if step % EVERY == 0:
            # every window is weighed anew; until the next time each document goes by its highest ones
            unit = scale * (vectors @ diff)
            of_word = np.bincount(word, unit[gram], len(widths)) * per_word
            z = np.add.reduceat(of_word[token], begin) / WINDOW
            if step:
                by = np.lexsort((-z, doc))
                place = np.arange(len(by)) - np.repeat(group, np.diff(np.append(group, len(by))))
                chosen = np.sort(by[place < TOP])
            width = ends[chosen] - begin[chosen]
            here = np.cumsum(width) - width
            some, small = np.unique(token[np.repeat(begin[chosen] - here, width) + np.arange(width.sum())], return_inverse=True)
            n_grams = np.diff(grams_from)[some]
            at = np.repeat(grams_from[some] - (np.cumsum(n_grams) - n_grams), n_grams) + np.arange(n_grams.sum())
            my_gram, my_word, share = gram[at], np.repeat(np.arange(len(some), dtype=np.int32), n_grams), per_word[some]
            window, mine = np.repeat(np.arange(len(chosen), dtype=np.int32), width), doc[chosen]
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            in_doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(mine))))
        unit = scale * (vectors @ diff)
        of_word = np.bincount(my_word, unit[my_gram], len(some)) * share
        z = np.add.reduceat(of_word[small], here) / WINDOW + bias[1] - bias[0]
        whole = _log_sum_exp(z, first)
        slope = (1 / (1 + np.exp(-np.clip(whole, -30, 30))) - y) * weight
        at_window = slope[in_doc] * np.exp(z - whole[in_doc])
        at_word = np.bincount(small, at_window[window], len(some)) * share / WINDOW
        at_gram = scale * np.bincount(my_gram, at_word[my_word], len(seen))
        out = vectors.T @ at_gram
        slopes = [np.outer(at_gram, diff), np.stack((-out, out), axis=1), np.array([-at_window.sum(), at_window.sum()])]
        for p, g, m, rate in zip(params, slopes, moved, RATES):
            m *= MOMENTUM
            m -= g
            p += rate * m
    weights = nothing[0]
    weights[seen] = scale * (vectors @ (rows[:, 1] - rows[:, 0])) * (places >= RARE)
    return weights, float(bias[1] - bias[0])


def window_odds(texts: list[str], weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, log odds) of every window."""
    bag = Bag(texts)
    word, bucket = bag.grams()
    of_word = np.bincount(word, weights[bucket], len(bag.hash)) / np.maximum(1, np.bincount(word, minlength=len(bag.hash)))
    begin, text = _windows(bag.text)
    if not len(begin):
        return text, np.zeros(0)
    return text, np.add.reduceat(of_word[bag.word], begin) / WINDOW + bias


def odds(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of whole texts; minus infinity without words."""
    out = np.full(len(texts), -np.inf)
    held, owner, size = [], [], 0

    def flush():
        text, z = window_odds(held, weights, bias)
        np.logaddexp.at(out, np.array(owner, dtype=np.int64)[text], z)

    for i, text in enumerate(texts):
        for part in blocks(text):
            held.append(part)
            owner.append(i)
            size += len(part)
            if size >= BLOCK:
                flush()
                held, owner, size = [], [], 0
    if held:
        flush()
    return out


def _scores(weights: np.ndarray, bias: float):
    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < 4 * BLOCK:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                z = odds(texts, weights, bias)
                score = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(score)], ["doc_id", "score"])
                at += len(texts)

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, text, toxic)``: labelled documents that are not held out, up to ``sample`` characters."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).na.drop().where(~held_out(F.col("_id")))
    by_id = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("_id is not null and text is not null")
    texts = texts.withColumn("h", F.xxhash64("text"))
    # ids and sizes only: texts are not shuffled
    sized = texts.select("_id", "h", F.length("text").alias("n")).where((F.col("n") > 0) & (F.col("n") <= longest))
    one = sized.join(by_id, "_id")
    one = one.groupBy("_id").agg(F.min("h").alias("h"), F.min_by("n", "h").alias("n"), F.max("toxic").alias("toxic"))
    one = cut(one)
    # ids are dealt by hash into shares of about 1 / SHARES of the bound; as many whole ones are taken as fit, so no task sorts the ids
    total = one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = max(SHARES, -(-SHARES * total // sample))
    one = one.withColumn("share", F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(shares))).where(F.col("share") < 2 * SHARES)
    upto = F.sum("n").over(Window.orderBy("share").rowsBetween(Window.unboundedPreceding, 0))
    taken = one.groupBy("share").agg(F.sum("n").alias("n")).withColumn("upto", upto).where(F.col("upto") <= sample).select("share")
    # at most ``sample`` rows, as every text taken has a character
    picked = one.join(F.broadcast(taken), "share").select("_id", "h", "toxic")
    found = texts.join(F.broadcast(picked), ["_id", "h"])
    return found.groupBy(F.col("_id").alias("doc_id")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _pack(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(v.as_py().encode()) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["doc_id", "packed", "toxic"])


def _fit_rows(batches):
    open_ = zstandard.ZstdDecompressor()
    texts, toxic = [], []
    for batch in batches:
        texts += [open_.decompress(v.as_py()).decode() for v in batch.column(1)]
        toxic += batch.column(2).to_pylist()
    weights, bias = fit(texts, toxic)
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, **options) -> tuple[np.ndarray, float]:
    rows = cut(training_rows(docs, labels, **options).mapInArrow(_pack, "doc_id long, packed binary, toxic int"))
    # bounded by ``sample``: the sample meets in one task
    made = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fit_rows, "weights binary, bias double").first()
    if made is None:  # the plan of an empty sample has no task
        return np.zeros(BUCKETS, dtype=np.float32), -np.inf
    return np.frombuffer(made["weights"], dtype="<f4"), made["bias"]


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``."""
    weights, bias = train(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_scores(weights, bias), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
