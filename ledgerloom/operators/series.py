"""Prices over time: like for like series, change logs, market figures by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedup import keep


def pinned_series(df: DataFrame, stem: str = "stem", date: str = "date", band: str = "band", price: str = "price") -> DataFrame:
    """stem, date, band, price: each stem in the one band that it has on most dates.

    Of bands on equally many dates the one with the lowest price, then the smallest name. A date on which the stem
    stands without that band has a null price; a stem without any price has only such.
    """
    priced = df.filter(F.col(price).isNotNull()).groupBy(stem, date, band).agg(F.min(price).alias("price"))
    sizes = priced.groupBy(stem, band).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"))
    pinned = keep(sizes, [stem], F.col("n").desc(), F.col("low"), F.col(band)).select(stem, band)
    own = priced.join(pinned, [stem, band])
    dates = df.select(stem, date).distinct()
    return dates.join(pinned, stem, "left").join(own.select(stem, date, "price"), [stem, date], "left").select(stem, date, band, "price")


def price_changes(series: DataFrame, stem: str = "stem", date: str = "date", price: str = "price", tolerance: float = 0.005) -> DataFrame:
    """stem, date, old_price, new_price, delta of neighbouring priced points that differ by more than the tolerance."""
    before = F.lag(price).over(Window.partitionBy(stem).orderBy(date))
    steps = series.filter(F.col(price).isNotNull()).select(stem, date, before.alias("old_price"), F.col(price).alias("new_price"))
    return steps.withColumn("delta", F.col("new_price") - F.col("old_price")).filter(F.abs("delta") > tolerance)


def change_summary(series: DataFrame, stem: str = "stem") -> DataFrame:
    """stem, n_changes, last_change."""
    return price_changes(series, stem).groupBy(stem).agg(F.count(F.lit(1)).alias("n_changes"), F.max("date").alias("last_change"))


def market_figures(df: DataFrame, date: str = "date", price: str = "price") -> DataFrame:
    """date, n, n_priced, lowest, median (interpolated), highest."""
    return df.groupBy(date).agg(
        F.count(F.lit(1)).alias("n"), F.count(price).alias("n_priced"), F.min(price).alias("lowest"), F.median(price).alias("median_price"), F.max(price).alias("highest")
    )


def quartiles(df: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """by, q1, q2, q3 by nearest rank: the sorted prices at n/4, n/2 and 3n/4, counted from 0; zeros without prices.

    The prices are counted first, so that each distinct price is one row however often it stands.
    """
    counted = df.filter(F.col(price).isNotNull()).groupBy(*by, F.col(price).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*by)
    to = F.sum("c").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.select(*by, "p", (to - F.col("c")).alias("first"), to.alias("to"), F.sum("c").over(own).alias("n"))
    at = lambda e: F.max(F.when((F.expr(e) >= F.col("first")) & (F.expr(e) < F.col("to")), F.col("p")))
    found = placed.groupBy(*by).agg(at("n div 4").alias("q1"), at("n div 2").alias("q2"), at("3 * n div 4").alias("q3"))
    return df.select(*by).distinct().join(found, by, "left").fillna(0.0, ["q1", "q2", "q3"])


def pulse(figures: DataFrame, date: str = "date") -> DataFrame:
    """Market figures with the change of median and size against the date before."""
    w = Window.orderBy(date)  # one row for each date
    return figures.select(
        date, "n", "median_price",
        (F.col("median_price") - F.lag("median_price").over(w)).alias("median_delta"),
        (F.col("n") - F.lag("n").over(w)).alias("n_delta"),
    )


def as_array(series: DataFrame, stem: str = "stem", date: str = "date", price: str = "price") -> DataFrame:
    """stem and its prices in order of date, gaps as null."""
    points = F.sort_array(F.collect_list(F.struct(date, price)))
    return series.groupBy(stem).agg(points.alias("p")).select(stem, F.transform("p", lambda x: x[price]).alias("prices"))
