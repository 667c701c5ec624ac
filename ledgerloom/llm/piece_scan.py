"""SentencePiece encoding and decoding as a max-plus scan over pieces.

The model merges pairs of pieces by score. Its encoding of a text is the one segmentation in which every two
neighbours encode, on their own, to just these two; so it is a path of weight 0 in a lattice whose edges weigh 0
between neighbours that stand and minus infinity between others. From a fixed start one piece at most ends a path at
each place, so the path is found from left to right, and back from its end.

A long document is cut into chunks. At a cut the state is the piece that reaches over it. A chunk gives the matrix
from the states at its left cut to those at its right one; the matrices of a document combine in the (max, +) algebra,
32 at a time in as many levels as its length needs; the way back down fixes the state at every cut, and each chunk then
finds its own pieces. What the query tells of a document, the count, checksum and whether decoding gives it back, is
combined from what its chunks tell; their ids are put together only where ids are asked for. No piece reaches over the start of a word, so that inside a chunk words are found one by one,
behind a bounded memory.

Defined cases: null and empty texts have no ids. Characters that the model lacks become their UTF-8 bytes. Decoding
gives the text back unless it holds the model's own space mark (U+2581), which becomes a space. Rows that repeat are
encoded each on its own.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices, stage, text_or_empty

MARK = "▁"
#: Characters of a chunk; documents of at most one chunk are not cut.
CHUNK = 32_768
#: Matrices combined in one step.
TOGETHER = 32
#: Words of a generation, of which two are remembered, and the longest one that is. Bounds on memory, not on the result.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 48
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Where no piece has a letter next to another sign, words end there too, which makes them fewer.
_LETTER, _OTHER = r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]", rf"(?:[^\w{MARK}]|[\d_\xb2\xb3\xb9\xbc-\xbe])"
_RUNS = re.compile(f"{MARK}*{_LETTER}+|{MARK}*{_OTHER}+|{MARK}+")
NO_PATH = -np.inf


class Pieces:
    """The model's pieces and which of them may stand side by side."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.texts = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        own = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.texts[i]: i for i in own}
        self.score = {self.texts[i]: model.get_score(i) for i in own}
        self.longest = max(map(len, self.ids))
        letters = re.compile(_LETTER)
        apart = all(bool(letters.match(a)) == bool(letters.match(b)) for p in self.ids for a, b in zip(p, p[1:]) if MARK not in (a, b))
        self.cut = (_RUNS if apart else _WORDS).findall
        self.written = [bytes((self.byte_of[i],)) if i in self.byte_of else self.texts[i].encode() for i in ids]
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # A piece that its own text does not encode to is never in an encoding.
        self.standing = {p for p in self.ids if self.merged(p) == [p]}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merged(self, text: str) -> list[str]:
        """Merging by score, leftmost first; for short texts."""
        parts, score = list(text), self.score.get
        gains = [score(a + b, NO_PATH) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > NO_PATH:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], NO_PATH)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], NO_PATH)
        return parts

    def side_by_side(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def paths(self, text: str, start: int = 0, first: str | None = None, end: int | None = None) -> list[str | None]:
        """last[i]: the piece that ends the path to place i, from ``start`` where ``first`` ended; None without a path."""
        end = len(text) if end is None else end
        last: list[str | None] = [None] * (end + 1)
        last[start] = first if first is not None else ""
        standing, check = self.standing, self.side_by_side
        for i in range(start + 1, end + 1):
            for n in range(min(self.longest, i - start), 0, -1):
                at = i - n
                before = last[at]
                if before is None:
                    continue
                piece = text[at:i]
                if (n == 1 or piece in standing) and (not before or check(before, piece)):
                    last[i] = piece
                    break
        return last

    def back(self, last: list[str | None], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(out[-1])
        return out[::-1]

    def numbered(self, pieces: list[str]) -> bytes:
        out = array("I")
        for p in pieces:
            i = self.ids.get(p)
            out.extend((i,) if i is not None else [self.bytes[b] for b in p.encode("utf-8", "replace")])
        return out.tobytes()

    def word(self, word: str) -> bytes:
        """A whole word: a short one by merging itself, a long one by its path, which takes time in proportion."""
        return self.numbered(self.merged(word) if len(word) <= LONGEST_REMEMBERED else self.back(self.paths(word), 0, len(word)))

    def encode(self, marked: str) -> bytes:
        """Ids of a text whose spaces are marks, as little-endian 32-bit numbers."""
        words, known = self.cut(marked), self.words
        missing = list(set(words).difference(known))
        if missing:
            if len(known) + len(missing) > REMEMBERED:  # the words of the last generation are taken over as they come up
                self.before, self.words = known, {}
                known = self.words
                missing = list(set(words))
            before = self.before.get
            for w in missing:
                known[w] = before(w) or self.word(w)
        out = b"".join(map(known.__getitem__, words))
        for w in missing:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The marked text of ids."""
        return b"".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that begin before the cut and reach it; the same seen from either side."""
        low, high = max(0, cut - self.longest), min(len(text), cut + self.longest)
        return [(a, b) for a in range(low, cut) for b in range(cut, high + 1) if b - a <= self.longest and (b - a == 1 or text[a:b] in self.standing)]


class Chunk:
    """A chunk's text with margins, and the paths from each state at its left cut."""

    def __init__(self, pieces: Pieces, text: str, left: int, right: int, first: bool, last: bool):
        self.pieces, self.text, self.left, self.right, self.first, self.last = pieces, text, left, right, first, last
        self.entries = [(0, 0)] if first else pieces.states(text, left)
        self.exits = [(right, right)] if last else pieces.states(text, right)
        # Places where a word begins, between which the paths of all states are the same.
        starts = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text) if max(b for _, b in self.entries) <= m.start() <= min(a for a, _ in self.exits)]
        self.begin, self.end = (starts[0], starts[-1]) if starts else (None, None)

    def _head(self, entry: int) -> tuple[list[str | None], int]:
        a, b = self.entries[entry]
        first = self.text[a:b] if not self.first else None
        stop = self.begin if self.begin is not None else self.right
        return self.pieces.paths(self.text, b, first, max(stop, b)), b

    def _reaches(self, last: list[str | None], low: int, exit: tuple[int, int]) -> bool:
        a, b = exit
        if a < low or a >= len(last) or last[a] is None:
            return False
        return a == b or not last[a] or self.pieces.side_by_side(last[a], self.text[a:b])

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.entries), len(self.exits)), NO_PATH)
        tail = self.pieces.paths(self.text, self.end, None, self.right) if self.end is not None else None
        ends = np.array([0.0 if tail is not None and self._reaches(tail, self.end, x) else NO_PATH for x in self.exits])
        for e in range(len(self.entries)):
            last, low = self._head(e)
            if tail is not None:
                if last[self.begin] is not None:
                    out[e] = ends
            else:
                out[e] = [0.0 if self._reaches(last, low, x) or self.entries[e] == x else NO_PATH for x in self.exits]
        return out

    def ids(self, entry: int, exit: int) -> bytes:
        """Ids of the pieces after the entry's, the exit's included."""
        a, b = self.exits[exit]
        own = [self.text[a:b]] if b > a and self.exits[exit] != self.entries[entry] else []
        if self.exits[exit] == self.entries[entry]:
            return b""
        last, low = self._head(entry)
        p = self.pieces
        if self.end is None:
            return p.numbered(p.back(last, low, a) + own)
        tail = p.paths(self.text, self.end, None, self.right)
        head = p.numbered(p.back(last, low, self.begin))
        return head + p.encode(self.text[self.begin : self.end]) + p.numbered(p.back(tail, self.end, a) + own)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of a run of matrices."""
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None, :, :]).max(1)
    return out


def way(matrices: list[np.ndarray], entry: int, exit: int) -> list[int]:
    """States at the right cut of every matrix on the best path from entry to exit."""
    after = [matrices[-1][:, exit]]
    for m in matrices[-2:0:-1]:
        after.append((m + after[-1][None, :]).max(1))
    states, at = [], entry
    for m, rest in zip(matrices[:-1], after[::-1]):
        at = int((m[at] + rest).argmax())
        states.append(at)
    return [*states, exit]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _cut_long(longest: int, chunk: int):
    """Chunks of long documents, with the margins in which a piece may reach over a cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                whole = marked(text.as_py())
                cuts = [*range(0, len(whole), chunk)]
                if len(whole) - cuts[-1] < 2 * longest:
                    cuts.pop()  # the last cut keeps its margin
                for i, at in enumerate(cuts):
                    end = cuts[i + 1] if i + 1 < len(cuts) else len(whole)
                    low, high = max(0, at - 2 * longest), min(len(whole), end + 2 * longest)
                    rows.append((row, i, len(cuts), whole[low:high], at - low, end - low))
            names = ["row", "chunk", "chunks", "text", "left", "right"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _chunk_of(pieces: Pieces, r: dict) -> Chunk:
    return Chunk(pieces, r["text"], r["left"], r["right"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1)


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            found = [_chunk_of(pieces, r).matrix() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.astype(np.float32).tobytes() for m in found], pa.binary())],
                ["row", "at", "states", "matrix"],
            )

    return run


LEVEL = "row long, at long, states int, matrix binary"


def _read(states: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(states, -1)


def _combined(table: pa.Table) -> pa.Table:
    """The product of one block's matrices, under the block's number."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    m = product([_read(r["states"], r["matrix"]) for r in rows])
    return pa.table({"row": pa.array([rows[0]["row"]], pa.int64()), "at": pa.array([rows[0]["block"]], pa.int64()), "states": pa.array([m.shape[0]], pa.int32()), "matrix": pa.array([m.tobytes()], pa.binary())})


def _fixed(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    entry, exit = rows[0]["entry"], rows[0]["exit"]
    states = way([_read(r["states"], r["matrix"]) for r in rows], entry, exit)
    return pa.table({"row": pa.array([r["row"] for r in rows], pa.int64()), "at": pa.array([r["at"] for r in rows], pa.int64()), "entry": pa.array([entry, *states[:-1]], pa.int32()), "exit": pa.array(states, pa.int32())})


def _chunk_facts(path: str, keep: bool):
    """Of each chunk: the bytes of its ids, their checksum, and whether they decode to the text between its two cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            size, crc, same, kept = [], [], [], []
            for r in batch.to_pylist():
                chunk = _chunk_of(pieces, r)
                ids = chunk.ids(r["entry"], r["exit"])
                size.append(len(ids)), crc.append(zlib.crc32(ids)), kept.append(ids)
                same.append(pieces.decode(ids) == chunk.text[chunk.entries[r["entry"]][1] : chunk.exits[r["exit"]][1]])
            columns = [batch.column("row"), batch.column("chunk"), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            names = ["row", "chunk", "size", "crc", "same"]
            if keep:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def joined_crc(first: int, then: int, size: int) -> int:
    """The CRC-32 of two strings of bytes in a row, from theirs and the size of the second (CRCs are linear)."""
    zeros = bytes(size)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ then


def _document(table: pa.Table) -> pa.Table:
    """One document's facts from its chunks'."""
    table = table.sort_by("chunk")
    crc = 0
    for then, size in zip(table.column("crc").to_pylist(), table.column("size").to_pylist()):
        crc = joined_crc(crc, then, size)
    out = {
        "row": pa.array([table.column("row")[0].as_py()], pa.int64()),
        "n_ids": pa.array([pc.sum(table.column("size")).as_py() // 4], pa.int64()),
        "ids_crc32": pa.array([crc], pa.int64()),
        "same": pa.array([pc.all(table.column("same")).as_py()], pa.bool_()),
    }
    if "ids" in table.column_names:
        out["ids"] = pa.array([b"".join(table.column("ids").to_pylist())], pa.binary())
    return pa.table(out)


def _short(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in slices(batches):
            n, crc, same, kept = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                whole = marked(text)
                ids = pieces.encode(whole)
                n.append(len(ids) // 4), crc.append(zlib.crc32(ids))
                same.append(pieces.decode(ids).replace(MARK, " ")[1:] == text)
                kept.append(ids)
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            names = ["row", "doc_id", "n_ids", "ids_crc32", "round_trip"]
            if keep:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _long(rows: DataFrame, path: str, chunk: int, with_ids: bool) -> DataFrame:
    """row, n_ids, ids_crc32, same (and ids) of each long document, by the scan."""
    longest = Pieces.of(path).longest
    with Scratch(rows.sparkSession) as scratch:
        chunks = scratch.stage(rows.select("row", "text").mapInArrow(_cut_long(longest, chunk), "row long, chunk long, chunks long, text string, left int, right int"))
        most = chunks.agg(F.max("chunks")).first()[0] or 0
        # Chunks of one document go to many tasks.
        dealt = chunks.repartition("row", "chunk")
        levels = [scratch.stage(dealt.mapInArrow(_matrices(path), LEVEL))]
        while most > 1:
            up = levels[-1].withColumn("block", F.expr(f"at div {TOGETHER}"))
            levels.append(scratch.stage(up.groupBy("row", "block").applyInArrow(_combined, LEVEL)))
            most = -(-most // TOGETHER)
        states = levels[-1].select("row", "at", F.lit(0).alias("entry"), F.lit(0).alias("exit"))
        for below in levels[-2::-1]:
            inner = below.withColumn("block", F.expr(f"at div {TOGETHER}")).join(states.withColumnRenamed("at", "block"), ["row", "block"])
            states = scratch.stage(inner.groupBy("row", "block").applyInArrow(_fixed, "row long, at long, entry int, exit int"))
        known = chunks.join(states.withColumnRenamed("at", "chunk"), ["row", "chunk"])
        ids = ", ids binary" * with_ids
        parts = scratch.stage(known.mapInArrow(_chunk_facts(path, with_ids), "row long, chunk long, size long, crc long, same boolean" + ids))
        return stage(parts.groupBy("row").applyInArrow(_document, "row long, n_ids long, ids_crc32 long, same boolean" + ids))


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether decoding gives the text back; with_ids adds the ids, little-endian 32-bit."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    short = given.filter(F.char_length("text") < chunk).select("row", "doc_id", "text")
    kinds = "row long, doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids
    out = ["doc_id", "n_ids", "ids_crc32", "round_trip", *(["ids"] if with_ids else [])]
    few = short.mapInArrow(_short(model_path, with_ids), kinds).select(out)
    long = stage(given.filter(F.char_length("text") >= chunk).withColumn("plain", ~F.contains("text", F.lit(MARK))))
    found = _long(long, model_path, chunk, with_ids)
    many = long.select("row", "doc_id", "plain").join(found, "row").withColumn("round_trip", F.col("plain") & F.col("same"))
    return few.unionByName(many.select(out))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model_path)
        for batch in batches:
            texts = [pieces.decode(i.as_py()).replace(MARK, " ")[1:] for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
