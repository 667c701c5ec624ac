"""Toxicity by a noisy channel: obfuscated words are restored by Viterbi, then the restored text is scored.

A character language model (interpolated trigrams of lower-cased letters, counted over all documents in a table of
fixed size) is the source. The channel writes letters as look-alike digits and symbols, stretches them, and parts them
by spaces or marks. A token becomes a lattice of what each character may stand for; the best path under model and channel
is the restored word. A token in which nothing may stand for anything else has a single path and stays as it is: one
without look-alikes, stretched letters and marks between single letters. One without any letter is a number.

The score rests on words and word beginnings of the restored text: their log odds in labelled documents, lowered by
their standard error and capped, so that only well supported ones count. A logistic curve over the two strongest words of
a document and the number of strong ones gives the probability. Labelled rows come from a sample of at most SAMPLE
expected rows.

Defined cases: null and empty texts have no words and get the curve's base score. Labels that repeat for a document
count once, as the larger; null labels are not used. Without labels of both kinds every score is the share of label 1,
or 0 without any. Rows that repeat are scored alike, each on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stage, text_or_empty
from .quality import fold, sampled

#: Expected number of labelled rows learned from, at most, and the documents a word must be in to count.
SAMPLE = 20_000
SUPPORT = 6
STRONG, STRONGEST = 2.5, 4.0
REJECT = 0.7
REMEMBERED = 200_000
#: Longest token that is remembered, and the characters that are decoded at a time. Neither changes what is restored.
REMEMBERED_LENGTH = 64
BLOCK = 2048

#: Letters of the model: 0 stands for all that is not a letter, 1-26 for a-z, then accented ones, the last for others.
LETTERS = 61
_INDEX = np.full(0x250, LETTERS - 1, np.int64)
_INDEX[[c for c in range(0x250) if not chr(c).isalpha()]] = 0
_INDEX[97:123] = np.arange(1, 27)
_INDEX[0xDF:0x100] = np.where(_INDEX[0xDF:0x100] > 0, np.arange(27, 60), 0)

#: What look-alikes may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Log costs of the channel. To leave out a look-alike is dear between letters, where it nearly always is one itself: leaving it
#: out also saves the model's cost of a letter (2 on average, 6 where it is rare), which would favour ever shorter words.
LOOKALIKE, IGNORED, LEADING, TRAILING, STRETCHED, WORD_GAP = -1.5, -20.0, -16.0, -8.0, -0.5, -3.0
_ALIKE = "".join(map(re.escape, LOOKALIKES))
_SIGN = re.compile(rf"[^\W\d_].*[{_ALIKE}]|[{_ALIKE}].*[^\W\d_]|([^\W\d_])\1\1", re.S)
_GLUE = re.compile(rf"(?:[^\w{_ALIKE}]|_)+")
_PARTED = re.compile(r"^\W*(?:[^\W_][.\-_*~/]+){2,}[^\W_]\W*$")
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(points < 0x250, _INDEX[np.minimum(points, 0x24F)], LETTERS - 1)


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        block: list[str] = []
        held = 0
        for text in [*batch.column(0), None]:
            if text is not None:
                block.append(text.as_py().lower())
                held += len(block[-1])
            if block and (text is None or held > 1 << 20):
                c = letters("  " + "  ".join(block) + "  ")
                seen = (c[2:] > 0) | (c[1:-1] > 0)
                total += np.bincount(((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:])[seen], minlength=LETTERS**3)
                block, held = [], 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """log p(letter | two before) as a dense table, from the trigrams of all documents."""
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(_count_letters, "gram int, n long")
    table = rows.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # LETTERS ** 3 rows at most
    counts = np.zeros(LETTERS**3)
    counts[table.column("gram").to_numpy()] = table.column("n").to_numpy()
    p = np.full(LETTERS, 1 / LETTERS)
    for order in (1, 2, 3):
        c = counts.reshape((-1,) + (LETTERS,) * order).sum(0)
        kinds = np.maximum((c > 0).sum(-1, keepdims=True), 1)
        p = (c + kinds * p) / (c.sum(-1, keepdims=True) + kinds)
    return np.log(p).astype(np.float32).reshape(LETTERS, LETTERS, LETTERS)


@lru_cache(4096)
def _letter(char: str) -> int:
    return int(letters(char)[0])


def _units(token: str) -> list[tuple[str, bool, float]]:
    """Characters, each with whether it stands for a stretched run of one letter, which is a single step however long, and what leaving it out costs."""
    out: list[tuple[str, bool]] = []
    for char, same in groupby(token):
        n = sum(1 for _ in same)
        out += [(char, True)] if n >= 3 and char.isalpha() else [(char, False)] * n
    at = [i for i, (char, _) in enumerate(out) if char.isalpha()] or [0]
    return [(char, stretched, LEADING if i < at[0] else TRAILING if i > at[-1] else IGNORED) for i, (char, stretched) in enumerate(out)]


def _forward(units: list[tuple[str, bool, float]], live: dict, model: np.ndarray) -> tuple[dict, list[dict]]:
    """Scores of the last two letters after the units, and for each unit where its states came from and what they wrote."""
    layers = []
    for char, stretched, left_out in units:
        scores: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        if stretched:
            ways = [(char, STRETCHED), (char + char, STRETCHED)]
        elif char.isalpha():
            ways = [(char, 0.0)]
        elif char in LOOKALIKES:
            ways = [*((x, LOOKALIKE) for x in LOOKALIKES[char]), ("", left_out)]
        else:
            ways = [("", 0.0), (" ", WORD_GAP)]
        for state, score in live.items():
            for written, cost in ways:
                if written == " " and not state[1]:  # nothing written yet, or a space just now
                    continue
                at, total = state, score + cost
                for x in written:
                    i = _letter(x)
                    total += float(model[at[0], at[1], i])
                    at = (at[1], i)
                if scores.get(at, -np.inf) < total:
                    scores[at], came[at] = total, (state, written)
        live = scores
        layers.append(came)
    return live, layers


def restore(token: str, model: np.ndarray) -> str:
    """The best path through the token's lattice; words that the path parts are separated by a space.

    Long tokens are decoded in blocks: the scores at each block's beginning are kept, and the blocks are gone through
    once more from the last to the first, so that the path is that of the whole token and its memory is of one block.
    """
    units = _units(token)
    live: dict[tuple[int, int], float] = {(0, 0): 0.0}
    begins, layers = [], []
    for at in range(0, len(units), BLOCK):
        begins.append(live)
        live, layers = _forward(units[at : at + BLOCK], live, model)
    state = max(live, key=lambda s: live[s] + float(model[s[0], s[1], 0]))
    out: list[str] = []
    for k in reversed(range(len(begins))):
        if k < len(begins) - 1:
            _, layers = _forward(units[k * BLOCK : (k + 1) * BLOCK], begins[k], model)
        for came in reversed(layers):
            state, written = came[state]
            out.append(written)
    return "".join(reversed(out))


class Restorer:
    """Distinct words of a text after restoring, a white-space token at a time behind a bounded memory."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        lowered = token.lower()
        words = _WORD.findall(lowered)
        if not lowered.isalpha() or len(set(lowered)) <= len(lowered) - 2:
            if _PARTED.match(lowered) or " " in lowered:
                words += restore(lowered.strip(".,;:?\"'()"), self.model).split()
            else:
                bare = lowered.strip(".,;:?\"'()").rstrip(".,;:?\"'()!")  # one in front may be a letter
                glued = _GLUE.split(bare)
                for part in [bare, *glued] if len(glued) > 1 else [bare]:  # the whole, and what punctuation glues
                    if _SIGN.search(part):
                        words += restore(part, self.model).split()
        return tuple(words)

    def tokens(self, text: str) -> set[str]:
        parts = text.split()
        out = set(parts)
        single = [i for i, p in enumerate(parts) if len(p) == 1]
        begin = 0
        for k in range(1, len(single) + 1):  # runs of one-character tokens
            if k == len(single) or single[k] != single[k - 1] + 1:
                if k - begin >= 3:
                    out.add(" ".join(parts[single[begin] : single[k - 1] + 1]))
                begin = k
        return out

    def __call__(self, text: str) -> set[str]:
        known, found = self.known, set()
        if len(known) > REMEMBERED:
            known.clear()
        for t in self.tokens(text):
            words = known.get(t)
            if words is None:
                words = self.token(t)
                if len(t) <= REMEMBERED_LENGTH:
                    known[t] = words
            found.update(words)
        return found


def signs(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in (3, 4, 5) if len(word) > n)]


def _sign_counts(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, counts = Restorer(model), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                counts[label].update({s for w in restored(text.as_py()) for s in signs(w)})
        for label in (0, 1):
            names, n = list(counts[label].keys()), list(counts[label].values())
            for at in range(0, len(names), 100_000):
                part = pa.array(n[at : at + 100_000], pa.int64())
                none = pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000]), part if label else none, none if label else part], ["sign", "pos", "neg"])

    return run


def _evidence(model: np.ndarray, weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, known = Restorer(model), {}
        for batch in slices(batches):
            rows = []
            for text in batch.column("text"):
                if len(known) > REMEMBERED:
                    known.clear()
                found = []
                for t in restored.tokens(text.as_py()):
                    e = known.get(t)
                    if e is None:
                        e = max((weights.get(s, 0.0) for w in restored.token(t) for s in signs(w)), default=0.0)
                        if len(t) <= REMEMBERED_LENGTH:
                            known[t] = e
                    if e:
                        found.append(e)
                found.sort(reverse=True)
                found += [0.0, 0.0]
                rows.append((found[0], found[1], float(sum(e >= STRONG for e in found))))
            columns = [pa.array(c, pa.float64()) for c in (zip(*rows) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "first", "second", "strong"])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.3] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    model = letter_model(docs)
    chosen = F.broadcast(stage(sampled(labels, "toxic", fold("doc_id", 3) != 1, SAMPLE)))
    learned = given.join(chosen, F.col("doc_id") == F.col("label_id")).select("text", "label")
    sizes = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return given.select("doc_id", held.alias("held_out"), F.lit(float(toxic > 0)).alias("score"), F.lit(int(toxic > 0)).alias("predicted"))
    counted = learned.mapInArrow(_sign_counts(model), "sign string, pos long, neg long").groupBy("sign").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1)) - F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    kept = counted.filter(F.col("pos") >= SUPPORT).withColumn("odds", F.least(odds, F.lit(STRONGEST))).filter("odds > 0.5").toArrow()
    weights = dict(zip(kept.column("sign").to_pylist(), kept.column("odds").to_pylist()))
    found = stage(given.mapInArrow(_evidence(model, weights), "doc_id long, first double, second double, strong double"))
    names = ["first", "second", "strong"]
    shaped = found.withColumn("strong", F.log1p("strong"))
    rows = shaped.join(chosen, F.col("doc_id") == F.col("label_id")).orderBy("doc_id").select(*names, "label").toArrow()
    w = _curve(np.column_stack([rows.column(n).to_numpy() for n in names]), rows.column("label").to_numpy())
    logit = sum((F.col(n) * float(v) for n, v in zip(names, w[1:])), F.lit(float(w[0])))
    scored = shaped.select("doc_id", held.alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
