"""Versioned records: append on change, state at a date, structural differences, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedup import keep

LISTS = ("leistungen", "ausschluesse", "besonderheiten")


def content_hash(stand: Column, modules: Column, coverage: Column, premium: Column, *lists: Column) -> Column:
    """sha256 over the comparable fields; the order of top-level lists and of keys does not count."""
    parts = F.struct(stand.alias("a"), F.array_sort(F.map_entries(modules)).alias("b"), coverage.alias("c"), premium.alias("d"), *(F.sort_array(x).alias(f"l{i}") for i, x in enumerate(lists)))
    return F.sha2(F.to_json(parts), 256)


def changed_versions(states: DataFrame, key: str = "stem", date: str = "date", digest: str = "content_sha256") -> DataFrame:
    """The states whose digest differs from the one before, with the date of the version that they supersede.

    Of several states on one date the last written (``ordinal``, where there is one) stands.
    """
    if "ordinal" in states.columns:
        states = keep(states, [key, date], F.col("ordinal").desc())
    w = Window.partitionBy(key).orderBy(date)
    marked = states.withColumn("__before", F.lag(digest).over(w)).filter(F.col("__before").isNull() | (F.col("__before") != F.col(digest)))
    return marked.withColumn("supersedes", F.lag(date).over(w)).drop("__before")


def append_changed(history: DataFrame, batch: DataFrame, key: str = "stem", date: str = "date", digest: str = "content_sha256") -> DataFrame:
    """The rows of a batch (one state a key) to be appended: those that differ from their newest earlier version.

    A state dated before the newest version is held against its own predecessor. A state of the same day and content
    appends nothing; one of the same day and another content replaces, which ``replaced`` says.
    """
    asked = batch.select(key, F.col(date).alias("__at")).distinct()
    before = state_as_of(history.select(key, date, digest), asked, key, date, "__at")
    newest = before.select(key, F.col("__at").alias(date), F.col(date).alias("__newest"), F.col(digest).alias("__digest"))
    met = batch.join(newest, [key, date], "left")
    fresh = met.filter(F.col("__digest").isNull() | (F.col("__digest") != F.col(digest)))
    same_day = F.coalesce(F.col("__newest") == F.col(date), F.lit(False))
    return fresh.select(*batch.columns, F.when(~same_day, F.col("__newest")).alias("supersedes"), same_day.alias("replaced"))


def without_history(records: DataFrame, history: DataFrame, key: str = "stem") -> DataFrame:
    """Records that have no version yet."""
    return records.join(history.select(key).distinct(), key, "left_anti")


def state_as_of(versions: DataFrame, asked: DataFrame, key: str = "stem", date: str = "date", at: str = "as_of") -> DataFrame:
    """For each asked (key, as_of) the newest version of that date or before; none is a row of nulls.

    Versions and questions stand in one order of time, in which each question takes the last version before it.
    """
    columns = [c for c in versions.columns if c != key]
    everything = F.struct(*columns)
    told = versions.select(key, F.col(date).alias("__t"), F.lit(0).alias("__asks"), everything.alias("__v"))
    asks = asked.select(key, F.col(at).alias("__t"), F.lit(1).alias("__asks")).distinct()
    line = Window.partitionBy(key).orderBy("__t", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = told.unionByName(asks, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(line))
    return last.filter("__asks = 1").select(key, F.col("__t").alias(at), *(F.col(f"__v.{c}").alias(c) for c in columns))


def structural_difference(pairs: DataFrame, coverage: list[str], lists: tuple[str, ...] = LISTS, key: str = "stem") -> DataFrame:
    """key, section, name, old, new: everything in which two states of a record differ, a row each.

    pairs: key, old and new, structs of content_sha256, modules map<string, struct<included, level>>, coverage struct and
    lists. Equal digests end the comparison. Modules are held by included and level over the keys of both sides, a missing
    one as neither; coverage field by field; list items, as sets, are ``added`` or ``removed``.
    """
    differs = pairs.filter(~F.coalesce(F.col("old.content_sha256") == F.col("new.content_sha256"), F.lit(False)))
    none = F.create_map().cast("map<string,struct<included:boolean,level:string>>")
    old, new = F.coalesce("old.modules", none), F.coalesce("new.modules", none)
    said = lambda m, k: F.struct(F.try_element_at(m, k)["included"].alias("included"), F.try_element_at(m, k)["level"].alias("level"))
    row = lambda section, name, a, b: F.struct(F.lit(section).alias("section"), name.alias("name"), a.alias("old"), b.alias("new"))
    keys = F.filter(F.array_union(F.map_keys(old), F.map_keys(new)), lambda k: ~said(old, k).eqNullSafe(said(new, k)))
    parts = [F.transform(keys, lambda k: row("modules", k, F.to_json(said(old, k)), F.to_json(said(new, k))))]
    text = lambda side, c: F.col(f"{side}.coverage.{c}").cast("string")
    parts += [F.when(~text("old", c).eqNullSafe(text("new", c)), F.array(row("coverage", F.lit(c), text("old", c), text("new", c)))) for c in coverage]
    nothing = F.lit(None).cast("string")
    came = lambda c, items: F.transform(items, lambda x: row(c, F.lit("added"), nothing, x))
    went = lambda c, items: F.transform(items, lambda x: row(c, F.lit("removed"), x, nothing))
    for c in lists:
        added, removed = list_difference(F.col(f"old.{c}"), F.col(f"new.{c}"))
        parts += [came(c, added), went(c, removed)]
    found = F.flatten(F.array_compact(F.array(*parts)))
    return differs.select(key, F.explode(found).alias("d")).select(key, "d.*")


def list_difference(old: Column, new: Column) -> tuple[Column, Column]:
    """Sorted items that came and that went."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    return F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))


def map_difference(old: Column, new: Column) -> Column:
    """Sorted keys whose values differ; a missing key is the same as a null value."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    return F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))


def version_pairs(versions: DataFrame, key: str = "stem", date: str = "date") -> DataFrame:
    """Each version with the one before it as ``old``."""
    everything = F.struct(*[c for c in versions.columns if c != key])
    return versions.withColumn("old", F.lag(everything).over(Window.partitionBy(key).orderBy(date))).filter("old IS NOT NULL")


def list_changelog(versions: DataFrame, items: str, key: str = "stem", date: str = "date") -> DataFrame:
    """key, date, added, removed of neighbouring versions whose items differ as sets."""
    pairs = version_pairs(versions, key, date)
    added, removed = list_difference(F.col(f"old.{items}"), F.col(items))
    return pairs.select(key, date, added.alias("added"), removed.alias("removed")).filter((F.size("added") > 0) | (F.size("removed") > 0))


def changes_and_dates(changes: DataFrame, versions: DataFrame, key: str = "stem", date: str = "date") -> DataFrame:
    """key, first_seen, last_analysis, n_changes, last_change."""
    seen = versions.groupBy(key).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_analysis"))
    counted = changes.groupBy(key).agg(F.count(F.lit(1)).alias("n_changes"), F.max(date).alias("last_change"))
    return seen.join(counted, key, "left").fillna(0, ["n_changes"])


def with_price_changes(features: DataFrame, prices: DataFrame, points: DataFrame, key: str = "stem") -> DataFrame:
    """Feature and price changes of each key: counts and the later date.

    features: n_changes, last_change. prices: the same of the price. points: n_points. Keys with prices alone stay only
    with a change or two priced points.
    """
    f = features.select(key, F.col("n_changes").alias("f_n"), F.col("last_change").alias("f_date"), F.lit(True).alias("__f"))
    p = prices.select(key, F.col("n_changes").alias("p_n"), F.col("last_change").alias("p_date"))
    joined = f.join(p, key, "full_outer").join(points, key, "left")
    stays = F.col("__f").isNotNull() | (F.coalesce("p_n", F.lit(0)) >= 1) | (F.coalesce("n_points", F.lit(0)) >= 2)
    return joined.filter(stays).select(key, F.coalesce("f_n", F.lit(0)).alias("feature_changes"), F.coalesce("p_n", F.lit(0)).alias("price_changes"), F.greatest("f_date", "p_date").alias("last_change"))


def recency(date: Column, today: Column, recent: int = 30, stale: int = 60) -> Column:
    age = F.datediff(today, date)
    return F.when(age.isNull(), "never").when(age <= recent, "recent").when(age > stale, "stale").otherwise("current")
