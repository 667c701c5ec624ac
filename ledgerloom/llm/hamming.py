"""Exact k nearest binary codes by multi-index hashing with growing radii.

A code is cut into segments, and every segment value is a key of the index. A query first probes the values that
equal its segments, then those one bit away, and so on. Once radius r is done in the first ``a`` of m segments and r - 1
in the others, every code within ``m * r + a - 1`` bits has been met, so a query is finished when its k-th verified
distance is at most that; only unfinished queries go on. The answer is exact. While few values are probed, all
segments of a radius go in one step; larger rings go segment by segment, so that a query stops inside a ring.

A probed value brings the query's k-th distance so far along, and codes beyond it are dropped where they are met. A code
is taken only at the first segment and radius that lead to it, which its differing bits tell, so that nothing that was
met before is compared again.

Rows with one code are one entry of the index, which holds the k smallest ids that have it: no query can need more,
and a code that a third of all rows share stays one row.

Codes of up to 64 bits are a long, wider ones a struct of longs; no segment reaches over two of them. As a segment has about
log2(n) bits, all its values are about n, so that even where the k-th distance is large, as in wide codes of vectors
without neighbours, a query probes no more than n values a segment.

Defined cases: the vectors' width is the largest in the table. A null vector, or one with a null or missing
component, has no code and is neither found nor asked for. Ties in distance go to the smaller id. A query finds its own row too, at distance 0. With fewer than k coded
rows every query returns all of them. Rows that repeat a whole row (same id and code) count once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, stage

#: Bits of a code where no width is given, one for each component of a vector; and bits of one of its words.
BITS = WORD = 64
#: Values probed in one step, over all queries, up to which a radius is not parted into its segments.
PROBES = 2_000_000
K = 10
QUERY_STEP = 20
SALTS = 64


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where component i is above 0: a long, beyond 64 bits a struct of them; null unless all components are there."""

    def word(at: int) -> Column:
        weight = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(min(WORD, bits - at))))
        part = vector if bits <= WORD else F.slice(vector, at + 1, WORD)
        return F.aggregate(F.zip_with(part, weight, lambda x, w: F.when(x > 0, w).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    whole = (F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull())
    words = [word(at) for at in range(0, bits, WORD)]
    code = words[0] if bits <= WORD else F.struct(*(w.alias(f"w{i}") for i, w in enumerate(words)))
    return F.when(F.coalesce(whole, F.lit(False)), code)


def _words(code: Column, bits: int) -> list[Column]:
    return [code] if bits <= WORD else [code[f"w{i}"] for i in range(-(-bits // WORD))]


def _distance(a: Column, b: Column, bits: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_words(a, bits), _words(b, bits))])


def _widths(n: int, bits: int = BITS) -> list[int]:
    """Bits of each segment: about log2(n), at which a bucket holds about one of n codes. Each word is parted by itself."""
    if bits > WORD:
        return [w for at in range(0, bits, WORD) for w in _widths(n, min(WORD, bits - at))]
    segments = min(bits, max(2, min(bits // 4, round(bits / math.log2(max(n, 16))))))
    return [bits // segments + (i < bits % segments) for i in range(segments)]


def _segments(code: Column, widths: list[int]) -> list[Column]:
    """The segments of a code, lowest bits first."""
    words, starts = _words(code, sum(widths)), [sum(widths[:i]) for i in range(len(widths))]
    return [F.shiftrightunsigned(words[at // WORD], at % WORD).bitwiseAND(F.lit((1 << w) - 1)) for at, w in zip(starts, widths)]


def _keys(code: Column, widths: list[int]) -> Column:
    return F.array(*_segments(code, widths))


def _ring(asked: DataFrame, widths: list[int], radius: int, segments: list[int]) -> DataFrame:
    """q, kth, s, v: every value that differs in exactly ``radius`` bits from a segment s of the code q, each once."""
    keys = F.filter(F.transform(_keys(F.col("q"), widths), lambda v, s: F.struct(s.alias("s"), v.alias("v"))), lambda x: x["s"].isin(segments))
    out = asked.select("q", "kth", F.inline(keys)).withColumn("last", F.lit(-1))
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("s") + 1)
    for _ in range(radius):  # flip one more bit, above the last one flipped
        above = out.filter(F.col("last") < width - 1).select("*", F.explode(F.sequence(F.col("last") + 1, width - 1)).alias("bit"))
        out = above.select("q", "kth", "s", F.col("v").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("v"), F.col("bit").alias("last"))
    return out.drop("last")


def _first_met(widths: list[int], radius: int) -> Column:
    """Whether no smaller radius, and no segment before s at this one, leads from q to the code."""
    bits = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_segments(F.col("q"), widths), _segments(F.col("code"), widths))]
    return reduce(lambda a, b: a & b, [(n > radius) | ((n == radius) & (F.col("s") <= t)) for t, n in enumerate(bits)])


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """code -> its k smallest ids, in two steps so that a very common code is not sorted in one task."""
    salted = Window.partitionBy("code", (F.abs(F.xxhash64("id")) % SALTS)).orderBy("id")
    some = rows.dropDuplicates(["id", "code"]).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k)
    last = Window.partitionBy("code").orderBy("id")
    few = some.withColumn("n", F.row_number().over(last)).filter(F.col("n") <= k)
    return few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _steps(widths: list[int], radius: int, asked: int) -> list[list[int]]:
    """The segments of each step of a radius."""
    every = list(range(len(widths)))
    return [every] if asked * sum(math.comb(w, radius) for w in widths) <= PROBES else [[s] for s in every]


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """rows and queries: (id, code). Returns query_id, rank, id, distance: the k nearest rows of every query."""
    rows, queries = rows.filter("code IS NOT NULL"), queries.filter("code IS NOT NULL")
    with Scratch(rows.sparkSession) as scratch:
        entries = scratch.stage(_entries(rows, k))
        widths = _widths(entries.count(), bits)
        index = scratch.stage(entries.select("code", F.size("ids").alias("n"), F.posexplode(_keys(F.col("code"), widths)).alias("s", "v")))
        # Each query has a row of its own, without a code, among what it has found.
        found = scratch.stage(queries.select(F.col("code").alias("q"), F.lit(None).cast(rows.schema["code"].dataType).alias("code"), F.lit(0).alias("n"), F.lit(0).alias("d"), F.lit(bits).alias("kth")).distinct())
        asked, done = found.count(), []
        nearer, all_of = Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy("q")
        for radius in range(max(widths) + 1):
            for segments in _steps(widths, radius, asked):
                if not asked:
                    break
                probes = _ring(found.filter("code IS NULL"), widths, radius, segments)
                # Ring sizes are not in Spark's estimates, so that it must not choose to broadcast the probes.
                met = probes.join(index.hint("merge"), ["s", "v"]).withColumn("d", _distance(F.col("q"), F.col("code"), bits))
                new = met.filter((F.col("d") <= F.col("kth")) & _first_met(widths, radius)).select("q", "code", "n", "d", "kth")
                # Codes whose nearer codes already hold k ids are beyond the answer; equal distances stay until ids decide.
                kept = found.unionByName(new).withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).filter(F.col("before") < k).drop("before")
                whole = F.sum("n").over(all_of) >= k
                last = F.when(whole, F.max("d").over(all_of)).otherwise(F.lit(bits))
                kept = kept.withColumns({"kth": last, "done": whole & (last <= len(widths) * radius + segments[-1])})
                kept = scratch.stage(kept)
                done.append(kept.filter("done").drop("done"))
                found = kept.filter("NOT done").drop("done")
                asked = found.filter("code IS NULL").count()
        # Where fewer than k rows have codes, every code has been met by now.
        near = reduce(DataFrame.unionByName, [*done, found]).filter("code IS NOT NULL")
        best = near.join(entries, "code").select("q", "d", F.explode("ids").alias("id"))
        order = Window.partitionBy("q").orderBy("d", "id")
        answers = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        asked_for = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
        return stage(asked_for.join(answers, "q").select("query_id", "rank", "id", F.col("d").alias("distance")))


def coded(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, code) of every row of a table of vectors, and the codes' bits."""
    bits = table.agg(F.max(F.size(vector_col))).first()[0] or 0
    bits = bits if bits > 0 else BITS
    return stage(table.select(F.col(id_col).alias("id"), sign_code(F.col(vector_col), bits).alias("code"))), bits


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows, by the Hamming distance of sign codes, of every vector whose id is divisible by 20."""
    rows, bits = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = nearest_codes(rows, rows.filter(F.col("id") % QUERY_STEP == 0), bits=bits)
    return out.select(F.col("query_id").alias("vec_id"), "rank", F.col("id").alias("neighbor_id"), "distance")


OP10_SQL = f"""
WITH t AS (SELECT DISTINCT vec_id, [x > 0 FOR x IN embedding] AS code FROM embeddings
           WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings) AND NOT list_contains([x IS NULL FOR x IN embedding], true)),
pairs AS (SELECT q.vec_id, t.vec_id AS neighbor_id,
                 list_sum([CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END FOR z IN list_zip(q.code, t.code)])::INT AS distance
          FROM t q CROSS JOIN t WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INT AS rank FROM pairs)
SELECT vec_id, rank, neighbor_id, distance FROM ranked WHERE rank <= {K}
"""
