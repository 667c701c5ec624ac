"""Quality classification: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Every word has a sparse random index vector; its context vector is the sum of its neighbours' index vectors over all
documents. Words live in a table of ``slots`` by their hash, so the table is bounded whatever the corpus. A document
is the mean of its words' vectors, the mean product of neighbouring words' vectors (which is large where a text
repeats itself), the shares of its word shapes and its length. The network learns from a sample of labelled rows of at
most SAMPLE expected rows, a fifth of which only fits the temperature.

Defined cases: null and empty texts have the features 0 and get the score that the network gives them. Labels that
repeat for a document count once, as the larger; null labels are not used. Without labels of both kinds every score
is the share of label 1, or 0.5 without any. Rows that repeat are scored alike, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stage, text_or_empty
from .runs import SHAPES, runs

WORDS, WIDTH, NONZERO = 8192, 32, 4
#: Expected number of labelled rows that the network learns from, at most.
SAMPLE = 20_000
DECAY = 1e-3
ACCEPT = 0.3
FEATURES = 2 * WIDTH + SHAPES + 1


def index_vectors(slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each word's few non-zero components."""
    random = np.random.Generator(np.random.PCG64(5))
    return random.integers(WIDTH, size=(slots, NONZERO)), random.choice([-1.0, 1.0], size=(slots, NONZERO))


def _word(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


def _contexts(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(slots)
        total = np.zeros(slots * WIDTH)
        seen = np.zeros(slots, np.int64)
        for batch in slices(batches):
            for block in runs(batch.column(0)):
                word = _word(block.hash, slots)
                seen += np.bincount(word, minlength=slots)
                next_to = block.doc[1:] == block.doc[:-1]
                left, right = word[:-1][next_to], word[1:][next_to]
                for one, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(one * WIDTH + place[other, k], weights=sign[other, k], minlength=slots * WIDTH)
        at = np.flatnonzero(seen)
        rows = total.reshape(slots, WIDTH)[at]
        columns = [pa.array(at.astype(np.int32)), pa.array(seen[at]), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(WIDTH))]
        yield pa.RecordBatch.from_arrays(columns, ["word", "seen", *(f"v{i}" for i in range(WIDTH))])

    return run


def word_vectors(docs: DataFrame, slots: int = WORDS) -> np.ndarray:
    """Unit context vectors of all words, summed over all documents; a table of fixed size."""
    kinds = "word int, seen long, " + ", ".join(f"v{i} double" for i in range(WIDTH))
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(_contexts(slots), kinds)
    table = rows.groupBy("word").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH))).toArrow()
    out = np.zeros((slots, WIDTH), np.float32)
    for i in range(WIDTH):
        out[table.column("word").to_numpy(), i] = table.column(f"v{i}").to_numpy()
    place, sign = index_vectors(slots)
    np.add.at(out, (np.arange(slots)[:, None], place), sign.astype(np.float32))  # a word is in its own context
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: pa.StringArray, vectors: np.ndarray) -> np.ndarray:
    """The features of each text, a row each."""
    n = len(texts)
    sums, count = np.zeros((n, FEATURES)), np.zeros(n)
    for block in runs(texts):
        if not len(block.doc):
            continue
        own, at = np.unique(block.doc, return_index=True)
        v = vectors[_word(block.hash, len(vectors))]
        sums[own, :WIDTH] += np.add.reduceat(v, at, axis=0)
        product = np.zeros_like(v)
        np.multiply(v[1:], v[:-1], out=product[1:])
        product[at] = 0
        sums[own, WIDTH : 2 * WIDTH] += np.add.reduceat(product, at, axis=0)
        shapes = np.bincount(block.doc * SHAPES + block.shape, minlength=n * SHAPES).reshape(n, SHAPES)
        sums[:, 2 * WIDTH : 2 * WIDTH + SHAPES] += shapes
        count += np.bincount(block.doc, minlength=n)
    sums /= np.maximum(count, 1)[:, None]
    sums[:, -1] = np.log1p(count) / 10
    return sums


def _features(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pooled(batch.column("text"), vectors).astype(np.float32)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "label", "features"])

    return run


class Network:
    """Two layers, tanh and a logit; the temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256):
        random = np.random.Generator(np.random.PCG64(7))
        last = random.random(len(y)) < 0.2
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-3
        z, t = self._scaled(x[~last]), y[~last].astype(float)
        p = [random.normal(0, FEATURES**-0.5, (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), 0.0]
        m, s, step = [0.0 * w for w in p], [0.0 * w for w in p], 0
        for _ in range(epochs):
            order = random.permutation(len(z))
            for at in range(0, len(z), batch):
                a, b = z[order[at : at + batch]], t[order[at : at + batch]]
                h = np.tanh(a @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b) / len(b)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [a.T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], d.sum()]
                step += 1
                for i, g in enumerate(grads):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                    p[i] = p[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if last.any():
            logits, t = self.logits(x[last]), y[last]
            options = np.geomspace(0.25, 8, 60)
            loss = [np.logaddexp(0, np.where(t > 0, -1, 1) * logits / o).mean() for o in options]
            self.temperature = float(options[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def sampled(labels: DataFrame, kind: str, learn, limit: int) -> DataFrame:
    """(label_id, label), one row an id, of the labelled rows that may be learned from, ``limit`` expected rows at most."""
    one = labels.filter(learn & F.col(kind).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(kind).alias("label"))
    part = min(1.0, limit / max(1, one.count()))
    # The hash as a number from 0 to 1, fine enough for any number of labels.
    return one.filter(F.shiftrightunsigned(F.xxhash64("label_id"), 11).cast("double") / float(1 << 53) < part)


class Scorer(NamedTuple):
    vectors: np.ndarray
    model: Network | float

    def __call__(self, texts: pa.StringArray) -> np.ndarray:
        if not isinstance(self.model, Network):
            return np.full(len(texts), self.model)
        return self.model.probability(pooled(texts, self.vectors).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, slots: int = WORDS) -> Scorer:
    """Word vectors from all documents, and the network from the labelled sample. Ids that the fold rule holds out are not learned from."""
    vectors = word_vectors(docs, slots)
    chosen = F.broadcast(stage(sampled(labels, "quality", fold("doc_id", 5) != 0, SAMPLE)))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = given.join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")
    learned = rows.mapInArrow(_features(vectors), "doc_id long, label int, features array<float>").orderBy("doc_id").toArrow()
    y = learned.column("label").to_numpy()
    x = np.concatenate([c.flatten().to_numpy() for c in learned.column("features").chunks] or [np.zeros(0)]).reshape(-1, FEATURES)
    return Scorer(vectors, Network(x, y) if len(set(y.tolist())) == 2 else float(y.mean()) if len(y) else 0.5)


def score_quality(docs: DataFrame, labels: DataFrame, slots: int = WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scorer = train(docs, labels, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text")))], ["doc_id", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = given.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, slots: int = WORDS) -> DataFrame:
    """The documents, whole rows, that the classifier accepts; nothing is joined or shuffled for it."""
    scorer = train(docs, labels, slots)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scorer(pc.fill_null(batch.column(at), "")) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
