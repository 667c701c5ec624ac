"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

A bin is filled greedily, the longest piece that fits first. Then its smallest piece gives way to two unpacked
pieces whose sum fits the gap more tightly, if there are such. Pieces of one length are interchangeable, so the
plan is made on the histogram of lengths (at most ``capacity`` rows, whatever the corpus), as bin patterns with
multiplicities; it is one plan over the whole corpus, not one for each task. Every piece then finds its place by its
rank among the pieces of its length, which is the sum of two counts: within its task and over the tasks before it.

Tokenising goes run by run behind a bounded memory of encoded runs: the tokenizer never joins what its pre-tokenisation
parts, so the ids are those of the whole text. Runs go to the tokenizer's model, past the steps before it, whose work is
done here. Special tokens that stand in a text have their own ids, as the tokenizer gives them.

Defined cases: a null text counts as empty and becomes the end id alone. Documents of any length are cut, none is
dropped. Rows that repeat are packed each on its own. An empty table gives no sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, slices, stage, text_or_empty

CAPACITY = 4096
END_ID = 1
#: Encoded runs a worker remembers; beyond it the memory starts anew. A bound on memory, not on the result.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 48
#: The tokenizer's white space, and its letters and numbers below U+0250.
_WHITE = "\t-\r \x85\xa0"
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_RUNS = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")
_FAR = re.compile("[\u0250-\U0010ffff]")
_SPACE = re.compile("[" + _WHITE + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")

#: Characters that the byte-level alphabet writes otherwise: bytes that are no printable ASCII, in UTF-8, each as one letter.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))}
_SPELT = {c: "".join(map(_LETTER.__getitem__, chr(c).encode())) for c in range(0x250)}

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100, which their lower case is then too."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder(dict):
    """text -> little-endian 32-bit ids, exactly those of the tokenizer for the whole text.

    The lower-cased runs that the tokenizer's pre-tokenisation cuts a text into repeat often; the mapping holds the ids of
    those that are remembered, and only the others are encoded. Below U+0250 nothing composes, so that runs can be cut here
    and spelt for the tokenizer's model; words with other characters are encoded whole by the tokenizer.
    """

    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; small batches cost more over threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens = self.tokenizer.model.tokenize
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.at_special = re.compile(f"({'|'.join(map(re.escape, self.specials)) or '(?!)'})").split

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def cut(text: str) -> list[str]:
        lowered = text.lower()
        if _latin(text) or not (_FAR.search(text) or _FAR.search(lowered)):
            return _RUNS.findall(lowered)
        words = ((w, w.lower()) for w in _SPACE.split(text) if w)
        return [r for w, low in words for r in ([w] if _FAR.search(w) or _FAR.search(low) else _RUNS.findall(low))]

    def encoded(self, run: str) -> bytes:
        if run in self.specials or not run.isascii() and (_FAR.search(run) or _FAR.search(run.lower())):
            ids = self.tokenizer.encode(run, add_special_tokens=False).ids
        else:
            spelt = run if run.isascii() and run.isprintable() else run.translate(_SPELT)
            ids = [t.id for t in self.tokens(spelt)]
        return array("I", ids).tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = self.encoded(run)
        if len(run) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(map(text.__contains__, self.specials)):  # they come at odd places
            runs = [r for i, p in enumerate(self.at_special(text)) for r in ([p] if i % 2 else self.cut(p))]
        else:
            runs = self.cut(text)
        return b"".join(map(self.__getitem__, runs))


def _tokenised(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), WordEncoder.of(path)
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(9)]
            ids, texts, rows = (batch.column(i) for i in range(3))
            for doc, text, row in zip(ids.to_pylist(), texts, rows.to_pylist()):
                data = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    values = (doc, row, piece, at // 4, n, zlib.crc32(own), task, int(ranks[n]))
                    for c, v in zip(cols, values):
                        c.append(v)
                    if with_ids:
                        cols[8].append(own)
                    ranks[n] += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "task", "local_rank"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[8], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns (how many bins, lengths in a bin) that use up ``counts`` by best-two-fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        taken: list[int] = []
        gap = capacity
        while gap > 0:
            there = np.flatnonzero(left[: gap + 1])
            if not len(there):
                break
            length = int(there[-1])
            n = min(int(left[length]), gap // length)
            taken += [length] * n
            left[length] -= n
            gap -= n * length
        if gap and len(taken) > 1:
            two = _two_for_one(left, taken[-1], gap)
            if two:
                left[taken.pop()] += 1
                for length in two:
                    left[length] -= 1
                taken += two
        own, need = np.unique(taken, return_counts=True)
        again = int((left[own] // need).min())
        left[own] -= again * need
        plan.append((again + 1, sorted(taken, reverse=True)))
    return plan


def _two_for_one(left: np.ndarray, smallest: int, gap: int) -> list[int] | None:
    """Two unpacked lengths with the largest sum over ``smallest`` that fits where it stood, or None."""
    room = smallest + gap
    there = np.flatnonzero(left[:room])
    if not len(there):
        return None
    options = np.concatenate([[0], there])  # 0: no partner
    at = np.searchsorted(there, room - there, side="right")
    partner = options[at]
    alone = (partner == there) & (left[there] < 2)
    partner = np.where(alone, options[np.maximum(at - 1, 0)], partner)
    sums = np.where(partner > 0, there + partner, 0)
    best = int(sums.argmax())
    return [int(there[best]), int(partner[best])] if sums[best] > smallest else None


def _placed(plan: list[tuple[int, list[int]]], capacity: int):
    """(length, rank) -> (sequence, offset) as arrays sorted by length and first rank."""
    slots, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            slots.append((length, used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    keys = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            arrays = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece with its sequence and offset; with_ids adds the piece's ids as little-endian 32-bit bytes."""
    schema = PIECES + (", ids binary" if with_ids else "")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = stage(given.mapInArrow(_tokenised(tokenizer_path, capacity, end_id, with_ids), schema))
    by_task = stage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row for each task and length: it grows with the input, so that it is merged and not broadcast.
    ranked = pieces.join(before.hint("merge"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    return ranked.select(*out, "rank").mapInArrow(_placed(plan_bins(counts, capacity), capacity), kinds)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of the whole sequence, from pack(..., with_ids=True)."""
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
