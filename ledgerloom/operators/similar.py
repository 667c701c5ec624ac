"""Names that are alike by edit distance, joined by the grams that they share.

A name becomes the set of its q-letter grams, each with how often it has occurred before. Two names whose similarity
``1 - distance / longer length`` is ``least`` share at least so many grams as their length says, so they share one of the first
few in any fixed order; grams that few names have come first. Only names that meet in such a gram, and whose lengths fit,
are held against the bound on all their grams, and only what is left has its edit distance taken.

Defined cases: null and empty names are like nothing. Names that repeat count once. Grams are of code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gram_length(least: float) -> int:
    """Letters of a gram: as many, up to three, as still leave names a third of their grams in common."""
    return max([q for q in (1, 2, 3) if 1 - q * (1 - least) >= 1 / 3 - 1e-9], default=1)


def grams(name: Column, q: int) -> Column:
    """The q-letter grams of a name as a set: each with its occurrence."""
    every = F.when(F.char_length(name) >= q, F.transform(F.sequence(F.lit(1), F.char_length(name) - q + 1), lambda i: F.substring(name, i, F.lit(q))))
    return F.transform(F.coalesce(every, F.array().cast("array<string>")), lambda g, i: F.concat(g, F.lit("\x00"), F.size(F.filter(F.slice(every, 1, i), lambda h: h == g)).cast("string")))


def _shared(longer: Column, q: int, least: float) -> Column:
    """Grams that two names have in common at least, by the longer one's length."""
    return F.ceil(longer * (1 - q * (1 - least)) - q + 1 - 1e-9)


def similar_names(asked: DataFrame, known: DataFrame, least: float, q: int | None = None) -> DataFrame:
    """asked: (asked). known: (stem). Returns asked, stem, like of all pairs whose similarity is ``least`` or more."""
    q = q or gram_length(least)
    if not 0 < least <= 1 or 1 - q * (1 - least) <= 0:
        raise ValueError("names so unlike share no grams of that length")
    shortest = math.ceil(q / (1 - q * (1 - least)))  # shorter names than this may be alike without a common gram
    sides = [d.select(F.col(c).alias("name")).filter("name <> ''").distinct().withColumn("side", F.lit(s)) for d, c, s in ((asked, "asked", 0), (known, "stem", 1))]
    names = sides[0].unionByName(sides[1]).withColumn("n", F.char_length("name")).withColumn("grams", grams(F.col("name"), q))
    each = names.select("side", "name", "n", "grams", F.explode_outer("grams").alias("gram"))
    rare = each.filter("side = 1").groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(rare, "gram", "left").withColumn("place", F.row_number().over(Window.partitionBy("side", "name").orderBy(F.coalesce("often", F.lit(0)), "gram")))
    first = ranked.filter(F.col("place") <= F.size("grams") - F.greatest(_shared(F.col("n"), q, least), F.lit(1)) + 1)
    # Where the bound says nothing, the first letter class of a short name is all of them: they meet by length.
    brief = names.filter(F.col("n") < shortest).select("side", "name", "n", "grams", F.explode(F.sequence(F.ceil(F.col("n") * least), F.floor(F.col("n") / least))).alias("other"))
    a, k = (first.filter(F.col("side") == s) for s in (0, 1))
    met = a.select(F.col("name").alias("asked"), F.col("n").alias("na"), F.col("grams").alias("ga"), "gram").join(k.select(F.col("name").alias("stem"), F.col("n").alias("nk"), F.col("grams").alias("gk"), "gram"), "gram").drop("gram")
    if q > 1:
        few = brief.filter("side = 0").select(F.col("name").alias("asked"), F.col("n").alias("na"), F.col("grams").alias("ga"), "other")
        rest = names.filter("side = 1").select(F.col("name").alias("stem"), F.col("n").alias("nk"), F.col("grams").alias("gk"))
        met = met.unionByName(few.join(rest, F.col("other") == F.col("nk")).drop("other"))
    longer, shorter = F.greatest("na", "nk"), F.least("na", "nk")
    fits = met.filter(shorter >= longer * least - 1e-9).filter(F.size(F.array_intersect("ga", "gk")) >= _shared(longer, q, least)).select("asked", "stem").distinct()
    like = 1 - F.levenshtein("asked", "stem") / F.greatest(F.char_length("asked"), F.char_length("stem"))
    return fits.withColumn("like", like).filter(F.col("like") >= least)
