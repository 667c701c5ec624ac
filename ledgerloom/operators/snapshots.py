"""Dated market snapshots: the latest, differences between two, change tests, ratings carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import keep_cheapest, keep_first, keep_last

POLICIES = {"cheapest": keep_cheapest, "first": lambda d, k, *_: keep_first(d, k), "last": lambda d, k, *_: keep_last(d, k)}


def latest(df: DataFrame, date: str = "date", before: Column | None = None) -> DataFrame:
    """The rows of the newest date, or of the newest before a given one."""
    pool = df if before is None else df.filter(F.col(date) < before)
    newest = pool.agg(F.max(date).alias("__newest"))
    return pool.join(F.broadcast(newest), F.col(date) == F.col("__newest")).drop("__newest")  # one row


def difference(old: DataFrame, new: DataFrame, key: str, price: str, tolerance: float = 0.0, policy: str = "cheapest") -> DataFrame:
    """key, old_price, new_price, delta, change (changed, added, removed, equal) of two snapshots.

    A change needs two prices that differ by ``tolerance`` at least, or at all where it is 0.
    """
    one = POLICIES[policy]
    a = one(old, [key], price).select(key, F.col(price).alias("old_price"), F.lit(True).alias("__old"))
    b = one(new, [key], price).select(key, F.col(price).alias("new_price"), F.lit(True).alias("__new"))
    delta = F.col("new_price") - F.col("old_price")
    moved = F.abs(delta) >= tolerance if tolerance else delta != 0
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.coalesce(moved, F.lit(False)), "changed").otherwise("equal")
    return a.join(b, key, "full_outer").select(key, "old_price", "new_price", delta.alias("delta"), kind.alias("change"))


def row_history(old: DataFrame, new: DataFrame, key: str, price: str, position: str) -> DataFrame:
    """Every new row against the first old row of its key, then the old rows whose key is gone."""
    first = keep_first(old, [key], position).select(key, F.col(price).alias("old_price"), F.col(position).alias("old_position"), F.lit(True).alias("__old"))
    now = new.select(key, F.col(price).alias("new_price"), F.col(position).alias("new_position"))
    met = now.join(first, key, "left").select(
        key, "new_position", "old_position", "new_price", "old_price",
        (F.col("new_price") - F.col("old_price")).alias("delta"),
        (F.col("old_position") - F.col("new_position")).alias("moved"),
        F.when(F.col("__old").isNull(), "new").otherwise("kept").alias("state"),
    )
    none = lambda c: F.lit(None).cast(c)
    gone = old.join(new.select(key), key, "left_anti").select(
        key, none("long").alias("new_position"), F.col(position).alias("old_position"), none("double").alias("new_price"),
        F.col(price).alias("old_price"), none("double").alias("delta"), none("long").alias("moved"), F.lit("removed").alias("state"),
    )
    return met.unionByName(gone)


def history_filter(rows: DataFrame, mode: str) -> DataFrame:
    """all, changed (price or place moved, new or gone), cheaper, pricier."""
    changed = (F.coalesce(F.col("delta"), F.lit(0.0)) != 0) | (F.coalesce(F.col("moved"), F.lit(0)) != 0) | F.col("state").isin("new", "removed")
    return rows if mode == "all" else rows.filter({"changed": changed, "cheaper": F.col("delta") < 0, "pricier": F.col("delta") > 0}[mode])


def same_rows(a: DataFrame, b: DataFrame, ignoring: tuple[str, ...] = ("position",)) -> DataFrame:
    """One row: whether two snapshots hold the same rows as multisets, some columns aside."""
    x, y = a.drop(*ignoring), b.drop(*ignoring)
    y = y.select(*x.columns)
    only = x.exceptAll(y).select(F.lit(1).alias("n")).limit(1).unionByName(y.exceptAll(x).select(F.lit(1).alias("n")).limit(1))
    return only.agg((F.count(F.lit(1)) == 0).alias("unchanged"))


def carried(new: DataFrame, old: DataFrame, key: str, columns: list[str], stamp: str, old_date: str) -> DataFrame:
    """Missing columns filled from the previous snapshot, with the date they come from; a stamp that is there stays."""
    before = keep_first(old, [key]).select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.coalesce(F.col(stamp), F.col(old_date).cast("string")).alias("__stamp"))
    filled = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}
    taken = F.col(columns[0]).isNull() & F.col(f"__{columns[0]}").isNotNull()
    joined = new.join(before, key, "left").withColumn("__taken", taken)
    return joined.withColumns({**filled, stamp: F.when(F.col("__taken"), F.col("__stamp")).otherwise(F.col(stamp))}).select(*new.columns)


def comparison_counts(old: DataFrame, new: DataFrame, key: str, price: str) -> DataFrame:
    """One row: common, repriced, added, removed keys, the last of equal keys standing for them."""
    d = difference(old, new, key, price, policy="last")
    count = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return d.agg(count("equal", "changed").alias("common"), count("changed").alias("repriced"), count("added").alias("added"), count("removed").alias("removed"))
