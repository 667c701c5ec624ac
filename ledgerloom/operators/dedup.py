"""One row of each key: the first, the last, the cheapest, the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands in for a missing price or place where such rows come last.
LAST = 1e9


def keep(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def keep_first(df: DataFrame, keys: list[str], ordinal: str = "position") -> DataFrame:
    return keep(df, keys, F.col(ordinal).asc_nulls_last())


def keep_last(df: DataFrame, keys: list[str], ordinal: str = "position") -> DataFrame:
    return keep(df, keys, F.col(ordinal).desc_nulls_last())


def keep_cheapest(df: DataFrame, keys: list[str], price: str = "price", ordinal: str = "position") -> DataFrame:
    """A missing price comes last, a price of 0 is a price; the first of equals stays."""
    return keep(df, keys, F.coalesce(F.col(price), F.lit(LAST)), F.col(ordinal).asc_nulls_last())


def representatives(df: DataFrame, key: str = "stem", price: str = "price", ordinal: str = "position") -> DataFrame:
    """Priced rows first, of those the cheapest, of those the one in front."""
    return keep(df, [key], F.col(price).asc_nulls_last(), F.coalesce(F.col(ordinal), F.lit(LAST)))


def duplicate_contents(df: DataFrame, text: str, place: str) -> DataFrame:
    """content_sha256, n, place: a row for each place of the texts that stand in several; blank texts are left out."""
    trimmed = F.trim(F.col(text), F.lit(" \t\n\r\x0b\f"))
    hashed = df.filter(trimmed != "").select(F.sha2(trimmed, 256).alias("content_sha256"), F.col(place).alias("place"))
    several = hashed.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hashed.join(several, "content_sha256").select("content_sha256", "n", "place")


def with_suffix(df: DataFrame, base: str, *order: Column, out: str = "unique_key") -> DataFrame:
    """Keys made unique: the first of equals stays as it is, the next ones get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))
