"""Toxicity, vector codes and token alignment against brute force, with the awkward cases in the tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")
import public_tokenizers as P  # noqa: E402

from tessera.llm import alignment, toxicity, vector_codes  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, score double, key long, g long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 0.5, 7, 3) for i, t in rows], DOCS).repartition(3)


# 11

BAD = ("idiot", "worthless", "pathetic", "scumbag")


def toxic_corpus(n=900, seed=4):
    rng = random.Random(seed)
    parts = ["an", "re", "the", "on", "ti", "sh", "be", "lo", "wh", "er", "ing", "ed"]
    plain = lambda k: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        words, bad = plain(rng.randrange(10, 300)).split(), i % 5 == 0
        if bad:
            for _ in range(max(2, len(words) // 50)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_corpus()
    extra = [(5000, None), (5001, ""), (5002, " \n "), (5003, "You IDIOT!"), (5004, "x" * 300_000), (None, rows[0][1]), (0, rows[0][1]), (5005, " ".join(t for _, t in rows[1:5]) * 300 + " idiot worthless")]
    docs = frame(spark, rows + extra)
    marks = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    return docs, marks, rows, labels


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, marks, rows, labels = toxic
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    y = {i: t for i, _, t in labels}
    out = [i for i in y if by[i]["held_out"]]
    assert np.mean([by[i]["predicted"] for i in out if y[i]]) >= 0.9
    assert np.mean([by[i]["predicted"] for i in out if not y[i]]) <= 0.02
    assert [by[i]["score"] for i in (5000, 5001, 5002)] == [0, 0, 0]
    assert by[5003]["predicted"] == 1 and by[5004]["predicted"] == 0
    assert by[5005]["predicted"] == 1, "two insults in a very long clean text"
    assert len({r["score"] for r in got if r["doc_id"] in (0, None)}) == 1


def test_misspelled_words_share_vectors():
    rows, labels = toxic_corpus()
    weights, bias = toxicity.fit([t for _, t in rows], [y for *_, y in labels])
    clean = toxicity.odds([t for (_, t), (*_, y) in zip(rows, labels) if not y], weights, bias)
    misspelt = toxicity.odds(["wortless beonre", "worthles anre", "patthetic reon", "idiiot shanlo", "scumbagg on"], weights, bias)
    assert (misspelt > np.quantile(clean, 0.9)).all()


def test_toxicity_scores_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    texts = ["İstanbul ǅ one\ntwo", "", "a\n\nb c", "ß é 日本 " * 50, "word " * 900]
    one = toxicity.odds(texts, weights, -1.0)
    alone = np.concatenate([toxicity.odds([t], weights, -1.0) for t in texts])
    assert np.allclose(one, alone) and np.isneginf(one[1])


def test_toxicity_sample_is_bounded_and_skips_held_out_ids(spark, toxic):
    docs, marks, rows, _ = toxic
    sizes = {i: len(t) for i, t in rows}
    got = [r["doc_id"] for r in toxicity.training_rows(docs, marks, sample=30_000, longest=1000).select("doc_id").collect()]
    assert len(set(got)) == len(got) and 20_000 < sum(sizes[i] for i in got) <= 30_000
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 and sizes[i] <= 1000 for i in got)


@pytest.mark.parametrize("which", ["docs", "labels", "one class"])
def test_toxicity_without_rows(spark, toxic, which):
    docs, marks, *_ = toxic
    if which == "docs":
        assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0
    else:
        marks = marks.limit(0) if which == "labels" else marks.where("toxic = 0")
        assert {r["score"] for r in toxicity.score_toxicity(docs.limit(20), marks).collect()} == {0.0}


# 12


def brute_codes(rows, parts=8, entries=16, rounds=6):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    kept = sorted(((i, lab, [int(np.floor(4096 * x)) for x in v]) for i, lab, v in rows if usable(v)), key=lambda r: r[0])
    width = len(kept[0][2]) // parts
    cutup = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cutup(v)[p] for _, _, v in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda x, book: min((square(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for _, _, v in kept:
                held[assign(cutup(v)[p], books[p])[1]].append(cutup(v)[p])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], collections.Counter()
    for i, lab, v in kept:
        best = [assign(x, books[p]) for p, x in enumerate(cutup(v))]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        sums[lab] += out[-1][3]
    return sorted((i, code, e, sums[lab], sha) for i, lab, code, e in out)


SHOWN = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def vector_rows(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, None if i % 7 == 0 else i % 3, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    rows[40:60] = [(i, lab, rows[3][2]) for i, lab, _ in rows[40:60]]  # equal vectors
    rows[70:75] = [(i, lab, [0.0] * dim) for i, lab, _ in rows[70:75]]
    nan, inf = float("nan"), float("inf")
    return rows + [(n, 1, None), (n + 1, 1, []), (n + 2, 1, [nan] * dim), (n + 3, 1, [inf] + [0.0] * (dim - 1)), (n + 4, 1, [None] + [0.0] * (dim - 1))]


def test_vector_codes_are_those_of_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string").repartition(4)
    assert sorted(tuple(r[c] for c in SHOWN) for r in vector_codes.compress(df).collect()) == brute_codes(rows)
    few = df.where("vec_id < 5")
    assert sorted(tuple(r[c] for c in SHOWN) for r in vector_codes.compress(few).collect()) == brute_codes(rows[:5])
    assert vector_codes.compress(df.limit(0)).count() == 0


def test_vector_codes_awkward_rows(spark):
    rows = [(0, 1, [1.0] * 8), (1, 1, [2.0] * 8), (2, 2, [3.0] * 9), (None, 2, [1e30] * 8), (3, None, [-1e30] * 8), (1, 1, [2.0] * 8)]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted((r["vec_id"] for r in got), key=str) == [0, 1, 1, 3, None]
    assert all(0 <= r["error"] < 2**63 for r in got)
    odd = spark.createDataFrame([(0, 1, [1.0] * 9)], "vec_id long, label int, embedding array<double>")
    assert vector_codes.compress(odd).count() == 0


def test_vantage_point_tree_is_exact_and_skips_entries():
    rng = np.random.default_rng(6)
    for entries, spread in ((rng.integers(-9, 9, (16, 4)), 12), (rng.integers(-2, 2, (16, 2)), 3), (rng.integers(-(1 << 27), 1 << 27, (256, 3)), 1 << 27)):
        x = rng.integers(-spread, spread, (3000, entries.shape[1]))
        square = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2).astype(np.int64)
        index, best, visits = vector_codes.Tree(entries).nearest(x.astype(np.int64))
        assert (index == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
        assert visits < 0.9 * square.size
    one = vector_codes.Tree(np.array([[3, 3]] * 5))
    assert (one.nearest(np.array([[0, 0], [3, 3]]))[0] == 0).all()


# 13


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs, count = [], collections.Counter()
    for i, text in rows:
        a = a_lib.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        in_a = [bytes(table[c] for c in a_lib.id_to_token(x)) for x in a]
        in_b = [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]
        want = f" {text}".encode()
        if not text or b"".join(in_a) != want or b"".join(in_b) != want:
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in in_a]).tolist(), np.cumsum([len(x) for x in in_b]).tolist()
        links, k = [], 0
        for x, end, begin in zip(a, ends_a, [0, *ends_a]):
            while ends_b[k] <= begin:
                k += 1
            j = k
            while j < len(b) and (ends_b[j - 1] if j else 0) < end:
                links.append((x, b[j]))
                j += 1
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        count.update(set(links))
        docs.append((i, a, b, groups, links))
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (i, len(a), len(b), len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, a, b, g, links in docs
    ]


@pytest.fixture(scope="module")
def aligned_rows(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    odd = [None, "", " ", "a▁b c", "x <s> </s> <|endoftext|> <0x41> y", "a  b\t\nc   d　e \U0001f600 fin ", " lead", "ab cd  ef g. " * 4000, "q" * 3000, "same words", "same words"]
    return rows + [(9000 + k, t) for k, t in enumerate(odd)] + [(None, "same words"), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("piece, group", [(alignment.PIECE, alignment.GROUP), (40, 1 << 14)])
def test_alignment_is_that_of_brute_force(spark, aligned_rows, piece, group):
    got = alignment.align(frame(spark, aligned_rows), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), piece, group).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_alignment(aligned_rows), key=repr)


def test_alignment_of_an_empty_table(spark, aligned_rows):
    assert alignment.align(frame(spark, aligned_rows).limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0
