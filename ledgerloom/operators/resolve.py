"""Identity: which record a market row, a favourite, a rating or a selector means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import casefolded, word_set
from .dedup import keep
from .similar import similar_names

#: Rows of typed names up to which they are broadcast.
MAX_ASKED = 1000


def resolve(rows: DataFrame, manifest: DataFrame, key: str = "row_id") -> DataFrame:
    """key, stem, tier of each row: exact on both names, else the only entry with the product and a name in the other.

    Two or more loose candidates resolve to nothing. Of equal manifest entries the last stands. The loose tier joins on
    the product and compares names only there.
    """
    named = lambda d, *more: d.withColumns({"__i": casefolded(F.trim("insurer")), "__p": casefolded(F.trim("product"))}).select("__i", "__p", *more)
    known = named(manifest, "stem", "ordinal")
    exact_keys = keep(known, ["__i", "__p"], F.col("ordinal").desc()).select("__i", "__p", F.col("stem").alias("exact_stem"), F.lit(True).alias("__exact"))
    asked = named(rows, key).join(exact_keys, ["__i", "__p"], "left")
    loose = known.select(F.col("__p"), F.col("__i").alias("__other"), "stem").distinct()
    inside = F.contains("__i", F.col("__other")) | F.contains("__other", F.col("__i"))
    names = asked.filter("__exact IS NULL").select("__i", "__p").distinct()  # names meet names, however many rows have them
    met = names.join(loose, "__p").filter(inside)
    only = met.groupBy("__i", "__p").agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("loose_stem")).filter("n = 1")
    joined = asked.join(only.select("__i", "__p", "loose_stem"), ["__i", "__p"], "left").withColumn("loose_stem", F.expr("CASE WHEN __exact IS NULL THEN loose_stem END"))
    tier = F.when(F.col("__exact"), "exact").when(F.col("loose_stem").isNotNull(), "loose").otherwise("none")
    return joined.select(key, F.coalesce("exact_stem", "loose_stem").alias("stem"), tier.alias("tier"))


def match_favourites(favourites: DataFrame, market: DataFrame) -> DataFrame:
    """Each favourite with the row of its product: that of the wanted band, else the cheapest priced, else the first."""
    rows = market.select(F.trim("insurer").alias("insurer"), F.trim("product").alias("product"), F.col("band").alias("found_band"), "price", "position")
    joined = favourites.join(rows, ["insurer", "product"], "left")
    wanted = F.when(F.col("found_band") == F.col("band"), 0).otherwise(1)
    return keep(joined, ["insurer", "product", "band"], wanted, F.col("price").asc_nulls_last(), F.col("position").asc_nulls_last())


def only_equivalent(rows: DataFrame, key: str = "stem", analysed: DataFrame | None = None) -> DataFrame:
    """key, equivalent: the one other insurer's row of ``analysed`` (else of rows) with the same product; several or none give no row."""
    keyed = lambda d: d.select(F.col(key).alias("__a"), casefolded(F.col("product")).alias("__p"), casefolded(F.col("insurer")).alias("__i"))
    a, b = keyed(rows), keyed(rows if analysed is None else analysed)
    # Rows of each insurer, then the insurers of each product: one other row means two insurers at most, so that a
    # product's first and last say it all and no row meets another.
    by_insurer = b.groupBy("__p", "__i").agg(F.count(F.lit(1)).alias("n"), F.min("__a").alias("k"))
    one = F.struct("__i", "n", "k")
    ends = by_insurer.groupBy("__p").agg(F.count(F.lit(1)).alias("insurers"), F.min(one).alias("lo"), F.max(one).alias("hi")).filter("insurers <= 2")
    met = a.join(ends, "__p")
    other = F.when(F.col("lo.__i") != F.col("__i"), F.col("lo")).when(F.col("hi.__i") != F.col("__i"), F.col("hi"))
    alone = (F.col("insurers") == 1) | F.col("__i").isin(F.col("lo.__i"), F.col("hi.__i"))
    return met.withColumn("o", F.when(alone, other)).filter("o.n = 1").select(F.col("__a").alias(key), F.col("o.k").alias("equivalent"))


def ratings_for(records: DataFrame, ratings: DataFrame, aliases: DataFrame) -> DataFrame:
    """stem, source, badge, scope, via of each record's ratings.

    ratings: scope (tariff or insurer), subject, source, badge. A tariff's own ratings first; through an alias only if
    it has none. Insurer ratings by whole words of insurer and stem, never by parts of words.
    """
    own = records.join(ratings.filter("scope = 'tariff'"), F.col("stem") == F.col("subject")).select("stem", "source", "badge", "scope", F.lit(None).cast("string").alias("via"))
    through = records.join(own.select("stem").distinct(), "stem", "left_anti").join(aliases, "stem")
    aliased = through.join(ratings.filter("scope = 'tariff'"), F.col("alias_of") == F.col("subject")).select("stem", "source", "badge", "scope", F.col("alias_of").alias("via"))
    words = records.select("stem", F.explode(word_set(F.col("insurer"), F.col("stem"))).alias("word"))
    by_name = words.join(ratings.filter("scope = 'insurer'"), F.col("word") == casefolded(F.col("subject"))).select("stem", "source", "badge", "scope", F.lit(None).cast("string").alias("via"))
    return own.unionByName(aliased).unionByName(by_name)


def collapse_products(rows: DataFrame) -> DataFrame:
    """The row in front of each product, names folded."""
    keyed = rows.withColumns({"__i": casefolded(F.col("insurer")), "__p": casefolded(F.col("product"))})
    return keep(keyed, ["__i", "__p"], F.col("position").asc_nulls_last()).drop("__i", "__p")


def select_pairs(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row in front of each wanted (insurer, product) pair, and the pairs that no row has."""
    fold = lambda d: d.withColumns({"__i": casefolded(F.trim("insurer")), "__p": casefolded(F.trim("product"))})
    have, want = fold(rows), fold(pairs).select("__i", "__p").distinct()
    found = keep(have.join(want, ["__i", "__p"], "left_semi"), ["__i", "__p"], F.col("position").asc_nulls_last()).drop("__i", "__p")
    missing = fold(pairs).join(have.select("__i", "__p").distinct(), ["__i", "__p"], "left_anti").drop("__i", "__p")
    return found, missing


def against_reference(rows: DataFrame, stem: Column, band: Column, neutral: float = 0.005) -> DataFrame:
    """Rows with the difference to a reference row's price, null without either; approximate where the bands differ.

    The reference row is that of the wanted band, else the cheapest, else the first of the stem: one row.
    """
    of_stem = rows.filter(F.col("stem") == stem).withColumn("__k", F.lit(1))
    wanted = F.when(F.col("band") == band, 0).otherwise(1)
    ref = keep(of_stem, ["__k"], wanted, F.col("price").asc_nulls_last(), F.col("position").asc_nulls_last()).select(F.col("price").alias("ref_price"), F.col("band").alias("ref_band"))
    joined = rows.join(F.broadcast(ref), F.lit(True), "left")
    delta = F.col("price") - F.col("ref_price")
    return joined.withColumns({"delta": F.when(F.abs(delta) < neutral, 0.0).otherwise(delta), "approximate": F.col("band") != F.col("ref_band")}).drop("ref_price", "ref_band")


def loose_filter(rows: DataFrame, needle: str) -> DataFrame:
    """Rows whose insurer or product holds the text, in any case; an empty text keeps all."""
    n = F.lit(needle.lower())
    return rows.filter(F.contains(F.lower("insurer"), n) | F.contains(F.lower("product"), n))


def sort_market(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """A total order by one of six columns.

    Missing places and ratings come last both ways; missing grades and prices count as 9999 and so come first downwards.
    """
    way = (lambda c: c.asc_nulls_last()) if ascending else (lambda c: c.desc_nulls_last())
    key = {"note": F.coalesce("note", F.lit(9999.0)), "price": F.coalesce("price", F.lit(9999.0)), "insurer": F.lower("insurer")}.get(column, F.col(column))
    return rows.orderBy(way(key), F.col("position").asc_nulls_last())


def lookup(rows: DataFrame, records: DataFrame) -> DataFrame:
    """row_id, stem: by the row's own stem, else by both names."""
    by_stem = rows.join(records.select(F.col("stem").alias("s1")), F.col("stem") == F.col("s1"), "left")
    names = keep(records, ["insurer", "product"], F.col("stem")).select("insurer", "product", F.col("stem").alias("s2"))
    return by_stem.join(names, ["insurer", "product"], "left").select("row_id", F.coalesce("s1", "s2").alias("stem"))


def suggestions(asked: DataFrame, known: DataFrame, limit: int = 5, loose: int = 3, least: float = 0.4) -> DataFrame:
    """asked, stem, place: known stems of the same insurer, else the most similar ones by edit distance.

    What is asked is what a user typed; while it is few rows the known stems of its insurers are read once and not shuffled.
    Similar ones meet by the grams that they share, whatever is asked.
    """
    few = asked.limit(MAX_ASKED + 1).count() <= MAX_ASKED
    prefix = lambda c: F.element_at(F.split(c, "__"), 1)
    a = asked.select("asked", prefix(F.col("asked")).alias("__i"))
    k = known.select("stem", prefix(F.col("stem")).alias("__i"))
    near = k.join(F.broadcast(a) if few else a, "__i").select("asked", "stem", F.row_number().over(Window.partitionBy("asked").orderBy("stem")).alias("place")).filter(F.col("place") <= limit)
    rest = a.join(near.select("asked").distinct(), "asked", "left_anti")
    met = similar_names(rest, known, least)
    far = met.select("asked", "stem", F.row_number().over(Window.partitionBy("asked").orderBy(F.col("like").desc(), "stem")).alias("place")).filter(F.col("place") <= loose)
    return near.unionByName(far).withColumn("place", F.col("place").cast("long"))
