"""Free text into an ordered taxonomy of synonyms, and matrices of what records cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import item_key

Taxonomy = list[tuple[str, list[str]]]


def classify(text: Column, taxonomy: Taxonomy) -> Column:
    """The first category of the list with a synonym inside the folded text; null without one."""
    folded = item_key(text)
    hits = [F.when(F.exists(F.array(*map(F.lit, synonyms)), lambda s: F.contains(folded, s)), F.lit(key)) for key, synonyms in taxonomy]
    return F.when(folded != "", F.coalesce(*hits))


def taxonomy_frame(spark, taxonomy: Taxonomy, kind: str) -> DataFrame:
    """kind, cat_ord, key, syn_ord, synonym."""
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("cat_ord"), F.lit(k).alias("key"), F.lit(j).cast("long").alias("syn_ord"), F.lit(s).alias("synonym")) for i, (k, ss) in enumerate(taxonomy) for j, s in enumerate(ss)))
    return spark.range(1).select(F.explode(rows).alias("x")).select(F.lit(kind).alias("kind"), "x.*")


def mapping_ratio(items: DataFrame, key: str = "category") -> DataFrame:
    """One row: matched, total, ratio."""
    return items.agg(F.count(key).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("ratio", F.try_divide(F.col("matched"), F.col("total")))


def category_counts(items: DataFrame, by: str = "stem", key: str = "category") -> DataFrame:
    """by, n_categories (distinct matched), n_unmatched."""
    return items.groupBy(by).agg(F.countDistinct(key).alias("n_categories"), F.count_if(F.col(key).isNull()).alias("n_unmatched"))


def first_items(items: DataFrame, by: str = "stem", key: str = "category", item: str = "item", ordinal: str = "ordinal") -> DataFrame:
    """The first item of each category of each record, word for word."""
    return items.filter(F.col(key).isNotNull()).groupBy(by, key).agg(F.min_by(item, ordinal).alias(item))


#: Words that mark a benefit as partial.
PARTIAL = ("nur ", "eingeschr", "außer", "ausser", "begrenzt", "teilweise")


def cell(item: Column, partial: tuple[str, ...] = PARTIAL) -> Column:
    low = F.lower(item)
    return F.when(item.isNull(), "–").when(F.exists(F.array(*map(F.lit, partial)), lambda w: F.contains(low, w)), "~").otherwise("✓")


def matrix(cells: DataFrame, row: str, column: str, value: str, columns: list[str], missing: str = "–") -> DataFrame:
    """A pivot with named columns, so that no pass is needed to find them."""
    wide = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide.fillna(missing, columns)


def unmatched_bucket(items: DataFrame, by: str = "stem", key: str = "category", item: str = "item", ordinal: str = "ordinal") -> DataFrame:
    """by, items in order of those that no category takes."""
    grouped = items.filter(F.col(key).isNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(ordinal, item))).alias("x"))
    return grouped.select(by, F.transform("x", lambda x: x[item]).alias("items"))


def attribute_rows(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """key, attribute, value: columns to rows, all values as text."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes))
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.attribute", "p.value")


def ordered_columns(rows: DataFrame, reference: str, key: str = "stem") -> DataFrame:
    """Records in the order of a comparison: the reference first."""
    return rows.orderBy(F.col(key) != reference, key)
