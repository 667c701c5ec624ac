"""Passages of many words that stand more than once, in one text or in several, and texts without them.

Suffix trees split by prefixes, for words instead of letters. A suffix begins at a word. Not every word need begin one: of the
8-word grams in a window the one with the least hash (the first of equals) is the window's anchor, equal windows have
equal anchors at equal places, and suffixes at anchors find every window that repeats.

1. Every text gives its anchors: the gram, which is the suffix's prefix, the range of windows that have it as theirs, and a
   digest of the words that these windows cover, its surroundings.
2. Suffixes are counted by prefix. A prefix that stands once begins no repeat. Where all suffixes of a prefix have equal
   surroundings all their windows repeat. Only prefixes with several different surroundings need a subtree.
3. Each of those surroundings is taken once, with whether it stands more than once, however many copies it has. They are dealt
   by prefix into groups of GROUP at most; where a prefix has more, it grows to all the words of a window, and its suffixes
   are counted instead of gathered.
4. A group's subtree is built from the top, a word of depth at a time: suffixes of a node part by their next word, and what is
   alone leaves the tree. Suffixes of a node at depth r that agree as well in the words before them, as many as the window
   still needs, hold a window that repeats. The deepest such node on either side of the anchor gives the maximal repeat.
5. Repeats go back to their texts.

Words are runs of anything but ASCII white space, unchanged. Equality of words, grams and surroundings is that of 64-bit hashes.

Defined cases: null and empty texts have no words. Texts of fewer words than a window have no windows. A window may
overlap its twin. Windows are judged on the whole input, repeated rows included: a row that stands twice loses all its windows.
Rows are told apart by id and text, so ids may be null or stand on several rows. Extra columns are ignored. Words and texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, documents, release, slices, stage, text_or_empty
from .shingles import mixed, word_hashes

WINDOW, GRAM = 35, 8
#: Surroundings of a prefix that are gathered; suffixes of a larger group are counted by the words of whole windows.
GROUP = 1000
#: Bytes of a text that are hashed together, its windows whose anchors are sought together, and suffixes whose subtrees
#: a task builds together.
BYTES, WINDOWS, FOREST = 1 << 20, 1 << 18, 20_000
#: Bytes of spans, about, up to which they are sent to the texts instead of being shuffled with them.
SENT = 64 << 20
_RANDOM = np.random.Generator(np.random.PCG64(13))


def _odd(n: int) -> np.ndarray:
    return _RANDOM.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACES = _odd(4096)
_BACK, _STEP = _odd(2)
_WHITE = b" \t\n\r\x0b\x0c"


def hashed_words(data: bytes) -> np.ndarray:
    """A hash for each word; long texts are cut at white space on the way, so that what is held besides stays small."""
    parts, at = [], 0
    while len(data) - at > BYTES:
        to = max(data.rfind(c, at + 1, at + BYTES) for c in _WHITE)
        if to < 0:  # a word longer than that
            to = min((p for c in _WHITE if (p := data.find(c, at + BYTES)) >= 0), default=len(data))
        parts.append(word_hashes(data[at:to], fold=False))
        at = to
    parts.append(word_hashes(data[at:], fold=False))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """For each run of n values, the place of its least one, the first of equals."""
    at, span = np.arange(len(values)), 1
    while span < n:
        step = min(span, n - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of hashed words: places of anchors, how far before them their first and last windows begin, grams, surroundings."""
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams += words[k : len(grams) + k] * _PLACES[k]
    grams = mixed(grams)
    room = window - gram
    # The anchor of each window.
    of = np.concatenate([at + _least(grams[at : at + WINDOWS + room], room + 1) for at in range(0, len(grams) - room, WINDOWS)])
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    last = np.append(first[1:], len(of)) - 1
    at = of[first]
    far, near = at - first, at - last
    around = np.zeros(len(at), np.uint64)
    for k in range(room + window):
        place = first + k
        inside = place < last + window
        around += np.where(inside, words[np.where(inside, place, 0)], np.uint64(0)) * _PLACES[gram + k]
    return at, far, near, grams[at], mixed(around + far.astype(np.uint64) * _BACK + near.astype(np.uint64) * _STEP)


ANCHORS = "doc_id long, text_id long, at array<int>, far array<int>, near array<int>, prefix array<long>, around array<long>"


def _anchored(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows, columns = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column("text")):
                found = anchors(hashed_words(text.as_py().encode()), window, gram)
                if len(found[0]):
                    rows.append(i)
                    for c, v, kind in zip(columns, found, (np.int32, np.int32, np.int32, np.int64, np.int64)):
                        c.append(v.view(np.int64).astype(kind))
            kept = batch.select(["doc_id", "text_id"]).take(pa.array(rows, pa.int64()))
            kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.int64())] * 2
            lists = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists], ["doc_id", "text_id", "at", "far", "near", "prefix", "around"])

    return run


MEMBERS = "key long, around long, far int, near int, words binary"


def _members(window: int, gram: int):
    """Surroundings taken from their texts: the hashes of their words, or of each window where the prefix has grown to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # of repeated rows
        for batch in slices(batches, 500):
            out: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
                words = hashed_words(text.as_py().encode())
                for w in wanted:
                    if w["around"] in met:
                        continue
                    met.add(w["around"])
                    at, far, near = w["at"], w["far"], w["near"]
                    if not w["many"]:
                        own = np.concatenate([words[at - far : at], words[at + gram : at - near + window]])
                        rows = [(w["prefix"], far, near, own.tobytes())]
                    else:
                        own = np.lib.stride_tricks.sliding_window_view(words[at - far : at - near + window], window)
                        keys = mixed((own * _PLACES[:window]).sum(1, dtype=np.uint64)).view(np.int64).tolist()
                        rows = [(key, far - i, far - i, None) for i, key in enumerate(keys)]
                    for key, a, b, own in rows:
                        for c, v in zip(out, (key, w["around"], a, b, own)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["key", "around", "far", "near", "words"]
            )

    return run


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each value stands more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.append(False, same) | np.append(same, False)
    return out


def repeats(prefix: np.ndarray, far: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of many subtrees, the farthest and the nearest repeated window before each anchor; -1 without any.

    left: words before the anchor, nearest first; right: words behind the gram. Both are filled up; ``far`` and ``near`` say
    which windows a suffix has.
    """
    before = np.zeros((len(prefix), left.shape[1] + 1), np.uint64)
    for d in range(left.shape[1]):
        before[:, d + 1] = mixed(before[:, d] * _BACK + left[:, d] + _STEP)
    farthest, nearest = np.full(len(prefix), -1, np.int64), np.full(len(prefix), -1, np.int64)
    alive, node = np.arange(len(prefix)), prefix.astype(np.uint64)
    for depth in range(gram, window + 1):
        d = window - depth
        reached = near[alive] <= d
        alive, node = alive[reached], node[reached]
        if depth > gram:
            node = mixed(node * _STEP + right[alive, depth - gram - 1] + _BACK)
        inner = _again(node)  # a suffix that is alone at its node is a leaf from here on
        alive, node = alive[inner], node[inner]
        if not len(alive):
            break
        has = far[alive] >= d
        own = alive[has]
        twice = own[_again(mixed(node[has] + mixed(before[own, d] + np.uint64(d))))]
        farthest[twice] = np.maximum(farthest[twice], d)
        nearest[twice] = d
    return farthest, nearest


def _forest(window: int, gram: int):
    """(around, far, near) of surroundings with repeated windows: sorted by key, whole subtrees together."""

    def grown(keys, around, far, near, words) -> pa.RecordBatch:
        room, ahead = window - gram, window - gram
        left, right = np.zeros((len(keys), room), np.uint64), np.zeros((len(keys), ahead), np.uint64)
        for i, (f, n, w) in enumerate(zip(far.tolist(), near.tolist(), words)):
            own = np.frombuffer(w, np.uint64)
            left[i, :f] = own[:f][::-1]
            right[i, : ahead - n] = own[f:]
        farthest, nearest = repeats(keys.view(np.uint64), far, near, left, right, window, gram)
        ok = farthest >= 0
        return pa.RecordBatch.from_arrays([pa.array(around[ok]), pa.array(farthest[ok].astype(np.int32)), pa.array(nearest[ok].astype(np.int32))], ["around", "far", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(rows)
            if whole.num_rows:
                yield grown(*(whole.column(c).to_numpy() for c in ("key", "around", "far", "near")), whole.column("words").to_pylist())

        for batch in slices(batches, FOREST // 2):
            held.append(batch)
            if sum(b.num_rows for b in held) < FOREST:
                continue
            key = batch.column("key").to_numpy()
            at = int(np.searchsorted(key, key[-1]))  # the last subtree may go on
            if at:
                yield from done([*held[:-1], batch.slice(0, at)])
                held = [batch.slice(at)]
        if held:
            yield from done(held)
        release()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text sorted, those that touch or overlap as one."""
    for batch in batches:
        lists = batch.column("spans")
        flat = lists.flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        begin, end = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        order = np.lexsort((begin, doc))
        base = doc[order] << 40
        begin, end = base + begin[order], np.maximum.accumulate(base + end[order])
        new = np.append(True, begin[1:] > end[:-1])
        at = np.flatnonzero(new)
        stop = end[np.append(at[1:], len(end)) - 1]
        structs = pa.StructArray.from_arrays([pa.array((v & ((1 << 40) - 1)).astype(np.int32)) for v in (begin[at], stop)], ["begin", "end"])
        offsets = np.append(0, np.cumsum(np.bincount(doc[order][at], minlength=batch.num_rows))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.ListArray.from_arrays(pa.array(offsets), structs)], batch.schema.names)


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, text_id, spans) of texts with repeated windows, staged.

    spans: sorted array of (begin, end), words that repeated windows cover, end exclusive, apart from each other.
    text_id is ``xxhash64`` of the text. Texts without spans are left out.
    """
    if not 0 < gram <= window <= 512:
        raise ValueError("a gram has at least one word and at most those of a window, a window at most 512")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_id", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as scratch:
        texts = scratch.stage(given.select("doc_id", "text_id", "text").mapInArrow(_anchored(window, gram), ANCHORS))
        spots = texts.select("doc_id", "text_id", F.inline(F.arrays_zip("at", "far", "near", "prefix", "around")))
        counted = spots.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi"))
        shared = scratch.stage(counted.filter("n > 1").select(F.col("prefix").alias("of"), F.expr("lo <> hi").alias("several")))
        met = scratch.stage(spots.join(shared.hint("merge"), F.col("prefix") == F.col("of")).drop("of"))

        # One text for each of the different surroundings of a prefix.
        rep = F.min(F.struct("doc_id", "text_id", "at", "far", "near")).alias("r")
        around = scratch.stage(met.filter("several").groupBy("prefix", "around").agg(F.count(F.lit(1)).alias("n"), rep))
        large = around.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select(F.col("prefix").alias("of"), F.lit(True).alias("many"))
        marked = around.join(broadcast_if_small(scratch.stage(large)), F.col("prefix") == F.col("of"), "left")
        asked = F.struct("r.at", "r.far", "r.near", "prefix", "around", F.coalesce("many", F.lit(False)).alias("many"))
        wanted = marked.groupBy(F.col("r.doc_id").alias("id"), F.col("r.text_id").alias("of_text")).agg(F.collect_list(asked).alias("wanted"))
        read = given.join(wanted.hint("merge"), F.expr("doc_id <=> id AND text_id = of_text"))
        members = scratch.stage(read.select("text", "wanted").mapInArrow(_members(window, gram), MEMBERS))

        trees = members.filter("words IS NOT NULL").repartition("key").sortWithinPartitions("key", "around")
        found = trees.mapInArrow(_forest(window, gram), "around long, far int, near int")
        leaves = members.filter("words IS NULL").select("key", "around", "far")
        twice = leaves.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("of"))
        counted_out = leaves.join(twice, F.col("key") == F.col("of")).select("around", "far", F.col("far").alias("near"))
        copies = around.filter("n > 1").select("around", "r.far", "r.near")
        ends = found.unionByName(counted_out).unionByName(copies).groupBy("around").agg(F.max("far").alias("farthest"), F.min("near").alias("nearest"))
        ends = scratch.stage(ends.withColumnRenamed("around", "of"))

        alike = met.filter("NOT several").select("doc_id", "text_id", "at", F.col("far").alias("farthest"), F.col("near").alias("nearest"))
        apart = met.filter("several").join(ends.hint("merge"), F.col("around") == F.col("of")).select("doc_id", "text_id", "at", "farthest", "nearest")
        span = F.struct((F.col("at") - F.col("farthest")).alias("begin"), (F.col("at") - F.col("nearest") + window).alias("end"))
        spans = alike.unionByName(apart).groupBy("doc_id", "text_id").agg(F.collect_set(span).alias("spans"))
        return stage(spans.mapInArrow(_joined, "doc_id long, text_id long, spans array<struct<begin:int,end:int>>"))


def _kept(words: list[bytes], spans: list[dict]) -> tuple[list[bytes], int]:
    """The words outside of all spans, and how many are inside."""
    out, at = [], 0
    for s in spans:
        out += words[at : s["begin"]]
        at = s["end"]
    out += words[at:]
    return out, len(words) - len(out)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, removed, texts = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            words = text.as_py().encode().split()
            kept, gone = _kept(words, spans or [])
            n.append(len(words)), removed.append(gone), texts.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words outside of all repeated windows joined by one space, of every row."""
    spans = repeated_passages(docs, window, gram, group).select(F.col("doc_id").alias("id"), F.col("text_id").alias("of"), "spans")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows, items = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    joined = given.join(F.broadcast(spans) if 64 * rows + 32 * items <= SENT else spans.hint("merge"), F.expr("doc_id <=> id AND xxhash64(text) = of"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_told, "doc_id long, n_words long, n_removed long, kept string")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stays when words of repeated 35-word windows go."""
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS s(i) WHERE len(w) >= {WINDOW}),
twice AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i FROM starts SEMI JOIN twice USING (k)),
words AS (SELECT r, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS s(j)),
marked AS (SELECT words.r, j, word, coalesce(max(i) OVER (PARTITION BY words.r ORDER BY j ROWS UNBOUNDED PRECEDING) > j - {WINDOW}, false) AS gone FROM words LEFT JOIN hit ON hit.r = words.r AND hit.i = words.j),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
