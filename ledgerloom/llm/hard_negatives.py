"""Hard negatives of anchors: rows of another label that score nearly as high as the anchor's own kind.

Rows are dealt into blocks of some thousands by a hash, and every anchor is sent to every block; a task holds one block and
sees the anchors pass. For each anchor the whole block is scored by integer inner products and sorted by score and id. In a
first pass a block gives its first rows of the anchor's label, of which the first over all blocks are the anchor's
positives. In a second pass each positive's upper limit is found in the sorted scores by binary search, and the next rows of
another label down to its lower limit are read, as many as asked for. The first of all blocks' are the result: no row that
belongs to it can be missing, because a block only leaves out what as many of its own rows precede.

So no anchor's scores over all rows meet in one task, and what blocks offer for an anchor is a few rows each, cut to the
same few before they are shuffled.

Scores are exact: products go through floating point matrices only while no sum can leave 53 bits.

Defined cases: rows with a null id or label, a null vector, or null or non-finite components take no part (see ``vectors``).
Rows that repeat a whole row (id, label, vector) count once. Different rows with one id are rows of their own, each an
anchor if its id says so; a row with the anchor's id is none of its others. Anchors without positives, or without rows
inside the limits, give no rows. Ties in score go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, stage
from .vectors import integer_vectors, matrix

#: Rows of a block, anchors that are scored together, and tasks over which blocks are dealt at most.
BLOCK, TOGETHER, TASKS = 4096, 64, 20_000


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, a row an anchor, exact in 64 bits."""
    most = max(int(np.abs(anchors).max(initial=0)), 1) * max(int(np.abs(rows).max(initial=0)), 1) * max(rows.shape[1], 1)
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def _first(order: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    return order[wanted[order]][:n]


def _positives(n: int):
    def work(block, anchors) -> Iterator[tuple]:
        for ids, owns, labels, x, _ in anchors:
            for a, score in enumerate(_scores(x, block["x"])):
                same = np.flatnonzero((block["label"] == labels[a]) & (block["id"] != ids[a]))
                best = same[np.lexsort((block["own"][same], block["id"][same], -score[same]))[:n]]
                yield from ((ids[a], owns[a], block["id"][i], block["own"][i], score[i]) for i in best)

    return work, "anchor_id long, own long, id long, id_own long, score long"


def _negatives(k: int, low: int, high: int):
    def work(block, anchors) -> Iterator[tuple]:
        for ids, owns, labels, x, positives in anchors:
            for a, score in enumerate(_scores(x, block["x"])):
                order = np.lexsort((block["own"], block["id"], -score))
                others = order[block["label"][order] != labels[a]]
                falling = -score[others]
                for rank, (positive, reached) in enumerate(positives[a], 1):
                    upper, lower = high * reached // 100, -(-low * reached // 100)
                    begin, end = np.searchsorted(falling, -upper, "left"), np.searchsorted(falling, -lower, "right")
                    for i in others[begin : min(begin + k, end)]:
                        yield ids[a], owns[a], rank, positive, reached, block["id"][i], block["own"][i], score[i]

    return work, "anchor_id long, own long, positive_rank int, positive_id long, positive_score long, id long, id_own long, score long"


def _cells(width: int, task):
    """Runs ``task`` on each block and the anchors that pass it: rows sorted by block, and in it the block's own before anchors."""
    work, kinds = task
    names = [c.split()[0] for c in kinds.split(", ")]

    def told(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = list(rows)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int32() if n.endswith("rank") else pa.int64()) for n, c in zip(names, zip(*held))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            r, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            edges = np.flatnonzero((r[1:] != r[:-1]) | (kind[1:] != kind[:-1])) + 1
            for at, to in zip([0, *edges], [*edges, batch.num_rows]):
                if at == to:
                    continue
                if r[at] != now:
                    now, parts, block = r[at], [], None
                part = batch.slice(at, to - at)
                if kind[at] == 0:
                    parts.append({"x": matrix(part.column("x"), width)} | {c: part.column(c).to_numpy() for c in ("id", "own", "label")})
                    continue
                if block is None and parts:
                    block, parts = {c: np.concatenate([p[c] for p in parts]) for c in ("id", "own", "label", "x")}, []
                if block is not None:
                    for i in range(0, part.num_rows, TOGETHER):
                        few = part.slice(i, TOGETHER)
                        positives = [[(p["id"], p["score"]) for p in row or []] for row in few.column("positives").to_pylist()]
                        yield from told(work(block, [(*(few.column(c).to_numpy() for c in ("id", "own", "label")), matrix(few.column("x"), width), positives)]))

    return run, kinds


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, width: int, task) -> DataFrame:
    """What ``task`` gives for each block of rows and every anchor."""
    own = rows.select("block", F.lit(0).alias("kind"), "id", "own", "label", "x", F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "id", "own", "label", "x", "positives")
    dealt = own.unionByName(sent).repartition(min(blocks, TASKS), "block").sortWithinPartitions("block", "kind", "id", "own")
    return dealt.mapInArrow(*_cells(width, task))


def mined(rows: DataFrame, width: int, anchor: Column, k: int = 10, positives: int = 5, low: int = 30, high: int = 90) -> DataFrame:
    """rows: (id, label, x) of whole numbers; ``anchor`` tells its anchors.

    For each anchor and each of its first ``positives`` rows of the same label, the first ``k`` rows of another label whose
    score is from ``low`` to ``high`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    with Scratch(rows.sparkSession) as scratch:
        told = rows.filter("id IS NOT NULL AND label IS NOT NULL").select("id", F.col("label").cast("long").alias("label"), "x").distinct()
        told = scratch.stage(told.withColumn("own", F.xxhash64("label", "x")))
        blocks = max(1, -(-told.count() // BLOCK))
        dealt = scratch.stage(told.withColumn("block", F.pmod(F.xxhash64("id", "own"), F.lit(blocks))))
        asked = dealt.filter(anchor).select("id", "own", "label", "x")
        none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
        near = _met(dealt, asked.withColumn("positives", none), blocks, width, _positives(positives))
        order = Window.partitionBy("anchor_id", "own").orderBy(F.col("score").desc(), "id", "id_own")
        best = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
        listed = best.groupBy("anchor_id", "own").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("p"))
        listed = scratch.stage(listed.select(F.col("anchor_id").alias("id"), "own", F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives")))
        found = _met(dealt, asked.join(listed, ["id", "own"]), blocks, width, _negatives(k, low, high))
        order = Window.partitionBy("anchor_id", "own", "positive_rank").orderBy(F.col("score").desc(), "id", "id_own")
        first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return stage(first.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; labels of ids divisible by 7 move on by one."""
    rows, width = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), width, F.col("id") % 100 == 0)


OP12_SQL = """
WITH t AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = (SELECT max(len(embedding)) FROM embeddings)
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, t.vec_id, a.label = t.label AS same, list_sum([z[1] * z[2] FOR z IN list_zip(a.v, t.v)])::BIGINT AS score
           FROM t a JOIN t ON a.vec_id <> t.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
"""
