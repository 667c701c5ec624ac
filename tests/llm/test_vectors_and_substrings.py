"""Codebooks, hard negatives and repeated passages against brute force, and their defined cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import codebooks, hard_negatives, substrings
from ledgerloom.llm.vectors import integer_vectors

KINDS = "vec_id long, embedding array<float>, label int, code string, x string"


def _table(spark, rows):
    """Clashing names besides."""
    return spark.createDataFrame([(*r, "other", "other") for r in rows], KINDS)


def _usable(rows):
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v], l) for i, v, l in rows if v is not None and len(v) == width and width and all(c is not None and math.isfinite(c) for c in v)]
    return good, width


def _random_rows(n, width, seed, labels=4):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = [(int(i), [float(c) for c in np.round(rng.normal(size=width), 1)], int(rng.integers(labels))) for i in rng.permutation(n)]
    return rows


ODD = [(1000, None, 1), (1001, [1.0] * 15, 1), (1002, [None] + [1.0] * 15, 1), (1003, [math.nan] + [1.0] * 15, 1), (1004, [math.inf] + [1.0] * 15, 1), (1005, [0.5] * 16, None), (1006, [0.5] * 16, None), (1007, [], 2)]


def _coded(rows, parts, entries, rounds):
    good, width = _usable(rows)
    d = -(-width // parts)
    pieces = [[(v + [0] * (parts * d - width))[p * d : p * d + d] for p in range(parts)] for _, v, _ in good]
    first = {}
    for i, v, _ in good:
        first[i] = min(first.get(i, v), v)
    start = sorted(first)[:entries]
    books = [[(first[i] + [0] * (parts * d - width))[p * d : p * d + d] for i in start] for p in range(parts)]
    best = lambda piece, book: min((sum((a - b) ** 2 for a, b in zip(piece, e)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [best(x[p], books[p])[1] for x in pieces]
            for e in range(len(start)):
                own = [x[p] for x, n in zip(pieces, of) if n == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for (i, _, label), x in zip(good, pieces):
        found = [best(x[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(dist for dist, _ in found)))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("width", "entries"), [(16, 8), (10, 5)])
def test_codebooks(spark, width, entries):
    rows = _random_rows(150, width, 1) + [(3, [0.25] * width, 2)] * 3 + (ODD if width == 16 else [])
    table, w = integer_vectors(_table(spark, rows))
    coded, books = codebooks.compressed(table.repartition(5), w, 4, entries)
    expected, digest = _coded(rows, 4, entries, codebooks.ROUNDS)
    assert sorted(map(tuple, coded.collect()), key=str) == sorted(expected, key=str)
    assert codebooks.digest(books) == digest


def test_codebooks_query_sums_nulls_together(spark, tmp_path):
    _table(spark, _random_rows(60, 16, 2) + ODD).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = codebooks.op11_vector_codes(spark, str(tmp_path)).collect()
    expected, digest = _coded(_random_rows(60, 16, 2) + ODD, 16, 64, 2)
    sums = Counter()
    for _, label, _, error in expected:
        sums[label] += error
    assert sorted(map(tuple, rows)) == sorted((i, code, error, sums[label], digest) for i, label, code, error in expected)


def test_codebooks_of_nothing_and_few(spark):
    table, width = integer_vectors(_table(spark, ODD[:1] + ODD[7:]))
    assert codebooks.compressed(table, width)[0].count() == 0
    table, width = integer_vectors(_table(spark, [(None, [1.0] * 16, None)]))
    assert [tuple(r) for r in codebooks.compressed(table, width)[0].collect()] == [(None, None, "00" * 16, 0)]
    huge, width = integer_vectors(_table(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)]))
    assert all(r["error"] >= 0 for r in codebooks.compressed(huge, width, entries=1)[0].collect())


def _mined(rows, k, n, low, high):
    good, _ = _usable([r for r in rows if r[0] is not None])
    good = sorted({(i, label, tuple(v)) for i, v, label in good if label is not None})
    out = []
    for i, label, v in good:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, m) for j, m, u in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:n]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = _random_rows(120, 16, 3) + ODD + [(None, [1.0] * 16, 1)]
    rows += [(50, r[1], r[2]) for r in rows if r[0] == 50] * 2
    table, width = integer_vectors(_table(spark, rows))
    found = hard_negatives.mined(table, width, F.col("id") % 10 == 0, 4, 3, 30, 90)
    expected = _mined(rows, 4, 3, 30, 90)
    assert len(expected) > 50
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    tied, width = integer_vectors(_table(spark, [(i, [1.0] * 4, i % 2) for i in range(30)]))
    assert sorted(map(tuple, hard_negatives.mined(tied, width, F.col("id") % 10 == 0, 2, 2, 30, 100).collect())) == sorted(_mined([(i, [1.0] * 4, i % 2) for i in range(30)], 2, 2, 30, 100))


def test_hard_negatives_of_nothing(spark):
    for rows in (ODD[:1], [(10, [1.0, 2.0], 1)], [(10, [1.0, 2.0], 1), (11, [1.0, 2.0], 1)]):
        table, width = integer_vectors(_table(spark, rows))
        assert hard_negatives.mined(table, width, F.col("id") % 10 == 0).count() == 0


def test_scores_are_whole():
    big = np.array([[1 << 27, -(1 << 27), (1 << 27) - 1]])
    assert hard_negatives._scores(big, big)[0, 0] == sum(int(v) ** 2 for v in big[0])


def _without(texts, window):
    words = [re.findall(r"[^ \t-\r]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def _texts(seed, n=60):
    rng = np.random.Generator(np.random.PCG64(seed))
    prose = lambda k: [f"w{i}" for i in rng.integers(400, size=k)]
    passages = [prose(int(k)) for k in rng.integers(8, 90, size=12)]
    out = []
    for _ in range(n):
        text = prose(int(rng.integers(0, 60)))
        for p in rng.integers(len(passages), size=int(rng.integers(0, 3))):
            text += passages[p] + prose(int(rng.integers(0, 40)))
        for at in rng.integers(max(len(text), 1), size=int(rng.integers(0, 2))):
            text[at : at + 1] = ["changed"]
        out.append("  ".join(text) if rng.integers(2) else "\t" + "\n".join(text))
    return [*out, *out[:6], None, "", " \n", "a " * 100, "same " * 34, "same " * 34, "x y " * 30, "ohne Bruch " * 40, "word " * 300 + "z" * 3000]


@pytest.mark.parametrize("group", [3, 1000])
def test_repeated_passages(spark, group):
    texts = _texts(7)
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)] + [(5, texts[5], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_id int, spans string").repartition(5)
    found = substrings.without_repeats(docs, 20, 5, group).collect()
    expected = _without([r[1] for r in rows], 20)
    assert sum(n for _, n, _ in expected) > 1000
    assert sorted(map(tuple, found), key=str) == sorted([(r[0], *e) for r, e in zip(rows, expected)], key=str)


def test_repeated_passages_at_production_window(spark):
    texts = _texts(11, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, substrings.without_repeats(docs).collect()))
    assert found == [(i, *e) for i, e in enumerate(_without(texts, 35))]
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_spans_are_joined_and_shuffled_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, " ".join(map(str, range(20, 90))) + " end")], "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substrings.repeated_passages(docs).collect()}
    assert spans == {1: [(20, 90)], 2: [(0, 70)]}
    monkeypatch.setattr(substrings, "SENT", 0)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.without_repeats(docs).collect()) == [(1, 70), (2, 70)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=6), st.integers(2, 9))
def test_anchors_cover_all_windows(texts, window):
    gram = max(1, window // 3)
    for words in texts:
        hashes = substrings.hashed_words(" ".join(words).encode())
        at, far, near, _, _ = substrings.anchors(hashes, window, gram)
        windows = [a - d for a, f, n in zip(at, far, near) for d in range(f, n - 1, -1)]
        assert windows == list(range(max(0, len(words) - window + 1)))
        assert all(0 <= d <= window - gram for d in (*far, *near))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(["ab", "c" * 70, "d", "e" * 200, *["f g"] * 60])
    whole = substrings.hashed_words(text.encode())
    monkeypatch.setattr(substrings, "BYTES", 50)
    monkeypatch.setattr(substrings, "WINDOWS", 16)
    assert (substrings.hashed_words(text.encode()) == whole).all()
    words = substrings.hashed_words(" ".join(f"w{i % 97}" for i in range(500)).encode())
    few = substrings.anchors(words)
    monkeypatch.setattr(substrings, "WINDOWS", 1 << 18)
    assert all((a == b).all() for a, b in zip(few, substrings.anchors(words)))
