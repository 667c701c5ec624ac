"""Crowds of unlike sets that share shingles: what tiles offer must not grow with their square."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join


def _alike(groups: int, size: int, jaccard: float, seed: int = 0) -> list[np.ndarray]:
    """Sets of one size, any two with about that similarity: a common core, and values of their own."""
    core = round(2 * jaccard * size / (1 + jaccard))
    rng = np.random.Generator(np.random.PCG64(seed))
    common = rng.integers(1 << 63, size=core, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(1 << 63, size=size - core, dtype=np.uint64)])) for _ in range(groups)]


@pytest.mark.parametrize(("size", "jaccard"), [(300, 0.5), (2000, 0.3), (2000, 0.5), (300, 0.8), (2000, 0.8)])
def test_bitmaps_decide_inside_a_tile(size, jaccard):
    offered = []
    for n in (100, 200):
        sets = _alike(n, size, jaccard)
        maps = np.empty(n, object)
        maps[:] = [ngram_join._bitmap(v) for v in sets]
        sizes = np.array([len(v) for v in sets])
        left, right = np.triu_indices(n, 1)
        bound = ngram_join._bounded(maps, left, right, sizes)
        truth = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left[:500], right[:500])])
        assert (bound[:500] >= truth).all()
        offered.append(int((bound >= ngram_join._needed(sizes[left], sizes[right], 85)).sum()))
    assert offered[1] <= max(4, 2.5 * offered[0]) and offered[1] < 200


def test_bitmaps_of_all_widths_bound():
    sets = [v for size in (3, 100, 130, 250, 260, 900) for v in _alike(4, size, 0.9, size)]
    maps = np.empty(len(sets), object)
    maps[:] = [ngram_join._bitmap(v) for v in sets]
    left, right = np.triu_indices(len(sets), 1)
    bound = ngram_join._bounded(maps, left, right, np.array([len(v) for v in sets]))
    assert all(b >= len(np.intersect1d(sets[i], sets[j])) for b, i, j in zip(bound, left, right))


def _texts(n: int) -> list[str]:
    """Texts of 2,200 words, any two of them with a similarity of about 0.3."""
    rng = np.random.Generator(np.random.PCG64(5))
    common = " ".join(f"c{i}" for i in rng.integers(10**6, size=1015))
    return [f"{common} " + " ".join(f"w{i}" for i in rng.integers(10**6, size=1185)) for _ in range(n)]


def test_unlike_long_texts_are_not_paired(spark, monkeypatch):
    """With so few counters the order of shingles is as good as chance, as where very many texts load every counter."""
    monkeypatch.setattr(ngram_join, "COUNTERS", 256)
    seen = []
    offered = ngram_join._offered

    def counted(*given):
        out = offered(*given)
        seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_offered", counted)
    for n in (20, 40):
        docs = spark.createDataFrame(list(enumerate(_texts(n))), "doc_id long, text string")
        out = ngram_join.near_duplicates(spark, docs, 4, 85)
        assert out.filter(F.col("doc_id") != F.col("component_id")).count() == 0
    assert seen[0] <= 2 * 20 and seen[1] <= 2 * 40  # of 190 and 780


def test_tiles_split_by_bytes(spark, monkeypatch):
    """Parts of a shingle by the bytes of their bitmaps give the same components."""
    rng = np.random.Generator(np.random.PCG64(9))
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(40):
        words = list(base)
        for at in rng.integers(300, size=int(rng.integers(0, 14))):
            words[at] = f"x{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, ngram_join.near_duplicates(spark, docs, 4, 85).collect()))
    monkeypatch.setattr(ngram_join, "TILE_BYTES", 2000)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 7)
    assert sorted(map(tuple, ngram_join.near_duplicates(spark, docs, 4, 85).collect())) == whole
