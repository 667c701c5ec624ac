"""Exact Jaccard join on word shingles, and the components of its links.

1. Every document becomes a set of hashed shingles; equal sets are one class from here on.
2. A class is sent to one tile for each shingle of its prefix: in any fixed order of the shingles, two sets that are
   similar enough share one of their first ``size - ceil(t * size) + 1``. The order puts shingles first that few
   documents have, by counts over all documents in a table of fixed size.
3. A tile is the classes of one such shingle and one band of sizes. Each class is offered the class that stands for
   most of its tiles; verified, these links join most copies. Where many classes of a tile are still in several
   components, this goes on a few turns with other, more central classes. Then all pairs between components are
   offered whose sizes and places in the order allow the overlap.
4. Inside its tile a pair is held against narrow bitmaps: differing bits bound the overlap from above. A tile offers what
   these leave open while that is PAIRS times its rows at most. Where it is more, as among large sets that fill narrow
   bitmaps, the rows meet once more with bitmaps as wide as their sets need, and only what these leave open is offered. Offered
   pairs are held against the wide bitmaps as well, and what is left is decided by the exact intersection of the sorted sets.

Shingles that very many documents have are dealt over several tiles, as many as the shingle's own open rows ask for, and
these tiles are paired, so that no group of copies meets in one task. Links that step 3 leaves out are between members of
one component only.

Equality of shingles and sets is that of 64-bit hashes (sets: and of their sizes).

Defined cases: null and empty texts, and those of white space only, have no shingles and are a component of their
own. Fewer words than ``n`` are one shingle. Rows that repeat are one class; a component's id is its smallest
doc_id, null only if all are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import Scratch, broadcast_if_small, documents, release, slices, stage, text_or_empty
from .components import connected_components
from .shingles import mixed, shingle_set

#: Counters of shingle frequency, documents by which one exceeds the usual to be dealt by a salt, and rows of a tile.
COUNTERS = 1 << 18
SALTED_FROM = 4000
TILE_ROWS = 4000
#: Classes from which a tile is a crowd, and partners of a class in each turn.
CROWD, PLANS = 16, 8
#: Pairs for each row of a tile that narrow bitmaps may leave open before wide ones are asked.
PAIRS = 2
#: Bits of the narrowest bitmap, bits for each value of a wider one, and bytes of bitmaps in a tile, about.
SKETCH, BITS, TILE_BYTES = 1024, 8, 32 << 20
#: Pairs of a tile that a task looks at together, by places, and 64-bit numbers of their bitmaps.
BLOCK, BITS_BLOCK = 1 << 19, 1 << 20


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of a sorted partition in parts that never divide rows with the same values of the first ``by`` columns."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_array(batch.column(n)) for n in names]
        alike = np.ones(batch.num_rows, bool)
        for c in columns[:by]:
            alike &= c == c[-1]
        at = batch.num_rows - int(np.argmin(alike[::-1])) if not alike.all() else 0
        goes_on = bool(held) and all(h[-1] == c[0] for h, c in zip(held[-1][:by], columns[:by]))
        if at or not goes_on:
            done = [*held, [c[:at] for c in columns]]
            held = []
            if sum(len(d[0]) for d in done):
                yield [np.concatenate(c) for c in zip(*done)]
        held.append([c[at:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _array(column: pa.Array) -> np.ndarray:
    """Numbers as they are; bitmaps, which differ in width, as arrays of bytes."""
    if pa.types.is_binary(column.type):
        out = np.empty(len(column), object)
        out[:] = [np.frombuffer(b, np.uint8) for b in column.to_pylist()]
        return out
    return column.to_numpy(zero_copy_only=False)


def _sketches(column: pa.Array) -> np.ndarray:
    """Bitmaps of SKETCH bits as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, SKETCH // 64)


def _batches(columns: dict[str, np.ndarray | pa.Array], at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    whole = pa.table(columns)
    yield from whole.to_batches(max_chunksize=at_once)


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with 100 * overlap >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def _count_shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            for text in batch.column(0):
                at = (shingle_set(text.as_py().encode(), n) & np.uint64(COUNTERS - 1)).astype(np.int64)
                counts += np.bincount(at, minlength=COUNTERS) if len(at) > COUNTERS // 8 else 0
                if len(at) <= COUNTERS // 8:
                    np.add.at(counts, at, 1)
        at = np.flatnonzero(counts)
        yield from _batches({"counter": at.astype(np.int32), "n": counts[at]})

    return run


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Documents for each counter of shingles, over all documents; the table has a fixed size."""
    counted = docs.select(text_or_empty().alias("text")).mapInArrow(_count_shingles(n), "counter int, n long")
    rows = counted.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out


def _bitmap(values: np.ndarray) -> np.ndarray:
    """One bit for each value's hash in BITS bits a value, a power of two and SKETCH at least."""
    width = max(SKETCH, 1 << (BITS * len(values) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(mixed(values) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _halved(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """A narrower bitmap of the same values: the hash's low bits choose the bit, so that halves fold onto each other."""
    while 8 * len(bitmap) > bits:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


def _salts(counts: np.ndarray) -> np.ndarray:
    """Tasks over which a counter's shingles are dealt while rare ones go: by what it has beyond the usual counter and its noise."""
    usual = float(np.median(counts))
    beyond = np.maximum(counts - usual - 8 * math.sqrt(usual + 1), 0)
    return np.minimum(1 + beyond // SALTED_FROM, 1 << 20).astype(np.int32)


def _class_of(values: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True) if len(values) else None


def _classes(n: int, percent: int, counts: np.ndarray):
    mean = counts.mean()
    rank = np.clip((counts - mean) / (4 * math.sqrt(mean) + 8), 0, 255).astype(np.int64)
    salts = _salts(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in slices(batches):
            sizes, classes, keys, dealt, sketches, bitmaps = [], [], [], [], [], []
            for text in batch.column("text"):
                values = shingle_set(text.as_py().encode(), n)
                size = len(values)
                own = _class_of(values)
                sizes.append(size)
                classes.append(own)
                if not size or (own, size) in met:
                    keys.append(None), dealt.append(None), sketches.append(None), bitmaps.append(None)
                    continue
                met.add((own, size))
                counter = (values & np.uint64(COUNTERS - 1)).astype(np.int64)
                first = np.argsort(rank[counter], kind="stable")[: size + (-percent * size) // 100 + 1]
                keys.append(values[first].view(np.int64)), dealt.append(salts[counter[first]])
                bitmap = _bitmap(values)
                sketches.append(_halved(bitmap, SKETCH).tobytes())
                bitmaps.append(bitmap.tobytes() if 8 * len(bitmap) > SKETCH else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(dealt, pa.list_(pa.int32())), pa.array(sketches, pa.binary()), pa.array(bitmaps, pa.binary())],
                ["doc_id", "size", "cls", "keys", "salts", "sketch", "bitmap"],
            )

    return run


SHARED = "key long, a long, sa int, pa int"


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by key and class, of keys that several classes have, each class once; of salted keys all rows."""
    for key, salts, cls, size, pos in _runs(batches, ["key", "salts", "cls", "size", "pos"], 1):
        new_key = np.append(True, key[1:] != key[:-1])
        own = new_key | np.append(True, (cls[1:] != cls[:-1]) | (size[1:] != size[:-1]))
        run_of = np.cumsum(new_key) - 1
        shared = own & ((np.bincount(run_of, own)[run_of] > 1) | (salts > 1))
        if shared.any():
            yield from _batches({"key": key[shared], "a": cls[shared], "sa": size[shared], "pa": pos[shared]})
    release()


def _partners(rows: DataFrame, percent: int, plan: Column) -> DataFrame:
    """Partners of another component, one for each class and plan at most.

    Each shingle belongs to one plan, which says in which band of sizes a row counts, and which row of a tile (a shingle
    and a band) stands for it; of the rows that stand for a class's tiles the one that it meets in most tiles is its partner. So a group of copies offers
    as many pairs as it has members, whatever its size.
    """
    placed = rows.select("key", "a", "sa", "pa", "comp", plan.alias("p")).select("key", "a", "sa", "pa", "comp", "p.*")
    one = F.struct("prio", F.col("a").alias("h"), F.col("sa").alias("sh"), F.col("pa").alias("ph"), F.col("comp").alias("ch"))
    first = placed.groupBy("key", "plan", "band").agg(F.min(one).alias("f"), F.count(F.lit(1)).alias("n"))
    met = placed.join(first.filter("n > 1").select("key", "plan", "band", "f.h", "f.sh", "f.ph", "f.ch"), ["key", "plan", "band"])
    need = F.ceil((F.col("sa") + F.col("sh")) * percent / (100 + percent))
    fit = met.filter((F.col("comp") != F.col("ch")) & (F.col("pa") <= F.col("sa") - need) & (F.col("ph") <= F.col("sh") - need))
    votes = fit.groupBy("plan", "a", "sa", "h", "sh").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("plan", "a", "sa").agg(F.max(F.struct("n", "h", "sh")).alias("v")).select("a", "sa", F.col("v.h").alias("b"), F.col("v.sh").alias("sb"))
    return best.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("sa")).otherwise(F.col("sb")).alias("sa"), F.when(F.col("a") < F.col("b"), F.col("sb")).otherwise(F.col("sa")).alias("sb"),
    ).dropDuplicates(["a", "b"])


def _plan(number: Column, band: Column, prio: Column) -> Column:
    return F.struct(number.alias("plan"), F.floor(band + number % 2 * 0.5).alias("band"), prio.alias("prio"))


def _merged(scratch: Scratch, rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with each component taken into the smallest one that its links lead to, twice over."""
    of = rows.select("a", "comp").distinct()
    ends = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").filter("ca <> cb")
    into = scratch.stage(ends.select(F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("t")).groupBy("c").agg(F.min("t").alias("t")))
    far = into.join(into.toDF("t", "u"), "t", "left").select("c", F.coalesce("u", "t").alias("t"))
    return rows.join(far, rows["comp"] == far["c"], "left").withColumn("comp", F.coalesce("t", "comp")).drop("c", "t")


def _crowded(rows: DataFrame) -> DataFrame:
    """The rows of shingles that many classes of several components have."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
    return rows.join(keys.filter(f"lo <> hi AND n >= {CROWD}").select("key"), "key", "left_semi")


def _bound(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """The overlap at most, by bitmaps of one width, a row a pair: a differing bit is a value that the other set lacks."""
    return np.minimum(sx - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), sy - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))


def _placed(percent: int, key, tile, size, salt, pos, comp) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a tile's rows, sorted by size, between components whose sizes and places allow the overlap, and what they need."""
    size, pos = size.astype(np.int64), pos.astype(np.int64)
    run_of = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))) - 1
    scale = int(size.max()) + 1
    last = np.searchsorted(run_of * scale + size, run_of * scale + np.minimum(size * 100 // percent, scale - 1), side="right")
    here = np.arange(len(key))
    many = last - here - 1
    ends = np.cumsum(many)
    crossed = tile > 0
    at = 0
    while at < len(key):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        left = np.repeat(here[at:to], many[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(ends[at:to] - many[at:to] - done, many[at:to])
        need = _needed(size[left], size[right], percent)
        ok = (comp[left] != comp[right]) & (pos[left] <= size[left] - need) & (pos[right] <= size[right] - need)
        ok &= ~(crossed[left] & (salt[left] == salt[right]))
        if ok.any():
            yield left[ok], right[ok], need[ok]
        at = to


OPEN = "key long, tile long, sa int, salt long, a long, pa int, comp long, b long, sb int"


def _open_rows(percent: int):
    """Pairs (a, b) that sizes, places and narrow bitmaps leave open; of tiles that have too many, the rows without a b."""
    names = ["key", "tile", "sa", "salt", "a", "pa", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *part, sketch in _runs(batches, [*names, "sketch"], 2):
            key, tile, size, salt, cls, pos, comp = part
            size, maps, step = size.astype(np.int64), np.stack(sketch).view(np.uint64), BITS_BLOCK * 64 // SKETCH
            run_of = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))) - 1
            room = PAIRS * np.bincount(run_of)
            found, met, pairs = np.zeros(len(room), np.int64), np.zeros(len(key), bool), [np.zeros((2, 0), np.int64)]
            for left, right, need in _placed(percent, key, tile, size, salt, pos, comp):
                for at in range(0, len(left), step):
                    x, y = left[at : at + step], right[at : at + step]
                    near = _bound(maps[x], maps[y], size[x], size[y]) >= need[at : at + step]
                    x, y = x[near], y[near]
                    met[x] = met[y] = True
                    found += np.bincount(run_of[x], minlength=len(room))
                    few = found[run_of[x]] <= room[run_of[x]]
                    pairs.append(np.stack([x[few], y[few]]))
            few = found <= room
            x, y = np.concatenate(pairs, 1)
            x, y = x[few[run_of[x]]], y[few[run_of[x]]]
            if len(x):
                swap = cls[x] > cls[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                none = {n: np.zeros(len(x), c.dtype) for n, c in zip(names, part)}
                yield from _batches(none | {"sa": part[2][x], "a": cls[x], "b": cls[y], "sb": part[2][y]})
            many = met & ~few[run_of]
            if many.any():
                none = pa.nulls(int(many.sum()), pa.int64()), pa.nulls(int(many.sum()), pa.int32())
                yield from _batches({n: c[many] for n, c in zip(names, part)} | {"b": none[0], "sb": none[1]})
        release()

    return run


def _bounded(maps: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The overlap at most of each pair, by bitmaps as wide as the narrower of the two."""
    width = np.array([len(m) for m in maps])
    pair = np.minimum(width[left], width[right])
    out = np.empty(len(left), np.int64)
    for w in np.unique(pair):
        own = np.flatnonzero(pair == w)
        used, place = np.unique(np.concatenate([left[own], right[own]]), return_inverse=True)
        table = np.stack([_halved(maps[i], 8 * int(w)) for i in used]).view(np.uint64)
        step = max(1, BITS_BLOCK * 8 // int(w))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            x, y = place[at : at + len(some)], place[len(own) + at : len(own) + at + len(some)]
            out[some] = _bound(table[x], table[y], size[left[some]], size[right[some]])
    return out


def _tile_pairs(percent: int):
    """Pairs of one tile, sorted by size, whose sizes, places and bitmaps allow the overlap."""

    def tiles(key, tile, size, salt, cls, pos, comp, maps) -> Iterator[pa.RecordBatch]:
        size = size.astype(np.int64)
        for left, right, need in _placed(percent, key, tile, size, salt, pos, comp):
            near = _bounded(maps, left, right, size) >= need
            x, y = left[near], right[near]
            if len(x):
                swap = cls[x] > cls[y]
                a, b = np.where(swap, y, x), np.where(swap, x, y)
                both = np.unique(np.stack([cls[a], cls[b], size[a], size[b]]), axis=1)
                yield from _batches({"a": both[0], "b": both[1], "sa": both[2].astype(np.int32), "sb": both[3].astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ["key", "tile", "sa", "salt", "a", "pa", "comp", "bitmap"], 2):
            yield from tiles(*part)
        release()

    return run


def _may_overlap(percent: int):
    """Pairs whose bitmaps leave room for the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (batch.column(c).to_numpy().astype(np.int64) for c in ("sa", "sb"))
            ok = _bound(_sketches(batch.column("ka")), _sketches(batch.column("kb")), sa, sb) >= _needed(sa, sb, percent)
            for i in np.flatnonzero(ok):
                x, y = (batch.column(c)[int(i)].as_py() for c in ("ma", "mb"))
                if x is not None and y is not None:
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    bits = 8 * min(len(x), len(y))
                    ok[i] = _bound(_halved(x, bits), _halved(y, bits), sa[i], sb[i]) >= _needed(sa[i], sb[i], percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, ok = [], []
            for text, size, own in zip(batch.column("text"), batch.column("size").to_pylist(), batch.column("cls").to_pylist()):
                v = shingle_set(text.as_py().encode(), n)
                same = len(v) == size and _class_of(v) == own
                ok.append(same)
                values.append(v.tobytes() if same else b"")
            out = pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(values, pa.binary())], ["cls", "values"])
            yield out.filter(pa.array(ok))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("va"), batch.column("vb")):
                p, q = sorted((np.frombuffer(v.as_py(), np.uint64) for v in (x, y)), key=len)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(scratch: Scratch, pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b, sa, sb) that are links: first by bitmaps, then by the sets of the documents that are left."""
    maps = classes.select("cls", "sketch", "bitmap")
    held = pairs.join(maps.toDF("b", "kb", "mb"), "b").join(maps.toDF("a", "ka", "ma"), "a").select("a", "b", "sa", "sb", "ka", "kb", "ma", "mb")
    near = scratch.stage(held.mapInArrow(_may_overlap(percent), "a long, b long"))
    wanted = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    wanted = scratch.stage(wanted.join(classes.select("cls", "size", F.col("doc_id").alias("wanted_id")), "cls"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(broadcast_if_small(wanted), F.expr("doc_id <=> wanted_id"))
    sets = scratch.stage(texts.select("cls", "size", "text").mapInArrow(_sets(n), "cls long, values binary").dropDuplicates(["cls"]))
    both = near.join(sets.toDF("b", "vb").hint("merge"), "b").join(sets.toDF("a", "va").hint("merge"), "a").select("a", "b", "va", "vb")
    return scratch.stage(both.mapInArrow(_linked(percent), "a long, b long"))


def _offered(scratch: Scratch, labelled: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sa, sb) between components, out of tiles of TILE_ROWS rows and TILE_BYTES of one shingle, or two such parts of it."""
    keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("sa").alias("values"))
    parts = F.greatest(F.expr(f"(n - 1) div {TILE_ROWS}"), F.expr(f"values * {BITS * 3 // 2} div {8 * TILE_BYTES}")) + 1
    several = keys.filter("lo <> hi").select("key", parts.alias("salts"))
    rows = labelled.join(several, "key").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    # The tile of a salt with itself is below 0 and needs no other salt; s * salts + t > 0 names the pair s < t.
    pair = lambda t: F.least(t, "salt") * F.col("salts") + F.greatest(t, "salt")
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda t: F.when(t == F.col("salt"), -1 - t).otherwise(pair(t)))
    dealt = rows.select("key", F.explode(tiles).alias("tile"), "sa", "salt", "a", "pa", "comp")
    tiled = lambda d: d.repartition("key", "tile").sortWithinPartitions("key", "tile", "sa", "a")
    drawn = dealt.join(classes.select(F.col("cls").alias("a"), "sketch"), "a")
    near = scratch.stage(tiled(drawn).mapInArrow(_open_rows(percent), OPEN))
    few, many = near.filter("b IS NOT NULL").select("a", "b", "sa", "sb"), near.filter("b IS NULL").drop("b", "sb")
    maps = classes.select(F.col("cls").alias("a"), F.coalesce("bitmap", "sketch").alias("bitmap"))
    offered = tiled(many.join(maps, "a")).mapInArrow(_tile_pairs(percent), "a long, b long, sa int, sb int")
    return few.unionByName(offered).dropDuplicates(["a", "b"])


def link_components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, cls) of every document, and (node, component) of every class that has links."""
    with Scratch(docs.sparkSession) as scratch:
        counts = frequencies(docs, n)
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        kinds = "doc_id long, size int, cls long, keys array<long>, salts array<int>, sketch binary, bitmap binary"
        every = scratch.stage(given.mapInArrow(_classes(n, percent, counts), kinds))
        members = stage(every.select("doc_id", "size", "cls"))
        classes = scratch.stage(every.filter("sketch IS NOT NULL").select("doc_id", "size", "cls", "sketch", "bitmap").dropDuplicates(["cls"]))
        rows = every.filter("keys IS NOT NULL").select("cls", "size", F.posexplode(F.arrays_zip("keys", "salts")).alias("pos", "k"))
        rows = rows.select("cls", "size", "pos", F.col("k.keys").alias("key"), F.col("k.salts").alias("salts"))
        dealt = rows.repartition("key", F.pmod(F.xxhash64("cls"), F.col("salts"))).sortWithinPartitions("key", "cls", "size")
        shared = scratch.stage(dealt.mapInArrow(_shared_rows, SHARED))
        band = F.log(F.col("sa").cast("double")) / math.log(100 / percent)
        alone = shared.withColumn("comp", F.col("a"))
        half = F.pmod(F.xxhash64("key"), F.lit(2))
        plan = _plan(half, band, F.when(half == 0, F.col("a").cast("double")).otherwise(F.xxhash64("a").cast("double")))
        links = _verified(scratch, _partners(alone, percent, plan), classes, docs, n, percent)
        labelled = scratch.stage(_merged(scratch, alone, links))

        # Crowds of near copies whose members are not all alike: those in most tiles stand for the crowd's middle.
        crowd, turns = scratch.stage(_crowded(labelled)), []
        left, before = crowd.count(), math.inf
        while 0 < left <= 0.9 * before:
            turn = len(turns)
            central = crowd.join(crowd.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "a")
            number = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(PLANS))
            noise = 0.8 + 0.4 * F.pmod(F.xxhash64("a", number, F.lit(turn)), F.lit(1000)) / 1000
            found = _verified(scratch, _partners(central, percent, _plan(number, band, -F.col("degree") * noise)), classes, docs, n, percent)
            if found.isEmpty():
                break
            links = links.unionByName(found)
            merged = scratch.stage(_merged(scratch, crowd, found))
            turns.append(merged.select("a", F.struct(F.lit(turn).alias("turn"), "comp").alias("new")).distinct())
            crowd = scratch.stage(_crowded(merged))
            left, before = crowd.count(), left
        if turns:
            last = reduce(DataFrame.unionByName, turns).groupBy("a").agg(F.max("new").alias("new"))
            labelled = scratch.stage(labelled.join(last, "a", "left").withColumn("comp", F.coalesce("new.comp", "comp")).drop("new"))
        rest = _verified(scratch, _offered(scratch, labelled, classes, percent), classes, docs, n, percent)
        return members, connected_components(links.unionByName(rest))


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, size, cls and comp, the component's class, of every document."""
    return stage(members.join(labels, members["cls"] == labels["node"], "left").select("doc_id", "size", "cls", F.coalesce("component", "cls").alias("comp")))


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of every document."""
    named = _named(*link_components(docs, n, percent))
    least = named.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.join(least, "comp", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))


def _classed(n: int, at: int):
    """Whole rows with the class of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [_class_of(shingle_set((t or "").encode(), n)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "__cls"])

    return run


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, whole rows, with one of each component: that with the smallest doc_id.

    A null doc_id stays. If an id stands on several rows, each of them is judged by its own text; of the smallest id's
    rows in one component that of the smallest class stays, once.
    """
    found = _named(*link_components(docs, n, percent)).filter("doc_id IS NOT NULL AND comp IS NOT NULL")
    first = stage(found.groupBy("comp").agg(F.min(F.struct("doc_id", "cls")).alias("f")).select("f.doc_id", "f.cls", "comp"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    several = stage(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("__several")))
    gone = found.join(first.select(F.col("doc_id").alias("id"), F.col("comp").alias("of")), (F.col("comp") == F.col("of")) & (F.col("doc_id") != F.col("id")))
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    if several.isEmpty():
        return docs.join(broadcast_if_small(stage(gone)), docs["doc_id"] == F.col("__gone"), "left_anti")
    gone = gone.join(several, F.col("__gone") == F.col("__several"), "left_anti").unionByName(several.toDF("__gone"))
    single = docs.join(broadcast_if_small(stage(gone)), docs["doc_id"] == F.col("__gone"), "left_anti")
    repeated = docs.join(broadcast_if_small(several), docs["doc_id"] == F.col("__several"), "left_semi")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("__cls", LongType())])
    classed = repeated.mapInArrow(_classed(n, at), schema)
    blank = classed.filter("__cls IS NULL").drop("__cls")
    stays = first.select(F.col("doc_id").alias("__id"), F.col("cls").alias("__own"))
    own = classed.join(stays, (F.col("doc_id") == F.col("__id")) & (F.col("__cls") == F.col("__own"))).drop("__id", "__own")
    once = own.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__cls").orderBy("text"))).filter("__n = 1")
    return single.unionByName(blank).unionByName(once.select(*docs.columns))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir), n=4, percent=85)
