"""Merging records: offers laid over, runs united, never-regressing reconciliation, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField

from ..functions.scores import included_count
from ..functions.text import item_key
from .dedup import keep
from .trimming import _bound

MISMATCH = 0.5


def monthly(month: Column, year: Column) -> Column:
    """The monthly premium; a twelfth of the annual one, rounded to cents, where only that is given."""
    return F.coalesce(month, F.round(year / 12, 2))


def overlay(records: DataFrame, offers: DataFrame) -> DataFrame:
    """Records with their offers laid over; rows with a violation are left as they are and say so.

    records: stem, modules map<string, struct<included, level>>, premium_month, premium_year, deductible.
    offers: stem, premium_month, premium_year, has_premium, levels map<string, string>, deductible.
    violations lists what the offer is refused for, notes what is worth a look. A superseded deductible stays in
    ``original_deductible``.
    """
    o = offers.select("stem", *(F.col(c).alias(f"o_{c}") for c in ("premium_month", "premium_year", "has_premium", "levels", "deductible")))
    joined = o.join(records.withColumn("__there", F.lit(True)), "stem", "left")
    levels = F.coalesce("o_levels", F.create_map().cast("map<string,string>"))
    keys = F.array_sort(F.map_keys(levels))
    module = lambda k: F.try_element_at("modules", k)
    each = lambda test, name: F.transform(F.filter(keys, test), lambda k: F.concat(F.lit(f"{name} "), k))
    when = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    there = F.coalesce("__there", F.lit(False))
    empty_offer = F.col("o_premium_month").isNull() & F.col("o_premium_year").isNull()
    has = F.coalesce("o_has_premium", F.lit(False))
    violations = F.concat(
        when(~there, "no record"),
        when(has & empty_offer, "empty premium"),
        when(there & has & ~empty_offer & F.coalesce("premium_month", "premium_year").isNotNull(), "premium already set"),
        when(there & F.col("modules").isNull() & (F.size(keys) > 0), "modules malformed"),
        F.when(there & F.col("modules").isNotNull(), F.concat(
            each(lambda k: ~F.map_contains_key("modules", k), "module unknown"),
            each(lambda k: F.map_contains_key("modules", k) & module(k).isNull(), "module malformed"),
            each(lambda k: module(k).isNotNull() & ~F.coalesce(module(k)["included"], F.lit(False)), "module not included"),
            each(lambda k: F.coalesce(module(k)["included"], F.lit(False)) & module(k)["level"].isNotNull(), "level already set"),
        )).otherwise(F.array().cast("array<string>")),
    )
    superseded = F.col("o_deductible").isNotNull() & F.col("deductible").isNotNull() & (F.col("o_deductible") != F.col("deductible"))
    notes = F.concat(
        when(has & (F.abs(F.col("o_premium_month") * 12 - F.col("o_premium_year")) > MISMATCH), "premium mismatch"),
        when(superseded, "deductible superseded"),
    )
    marked = joined.withColumns({"violations": violations, "notes": notes})
    good = F.size("violations") == 0
    laid = F.transform_values("modules", lambda k, m: F.when(good & F.map_contains_key(levels, k), m.withField("level", F.try_element_at(levels, k))).otherwise(m))
    premium = good & has
    fields = F.concat(when(premium, "premium"), F.transform(keys, lambda k: F.concat(F.lit("modules."), k, F.lit(".level"))), when(F.col("o_deductible").isNotNull(), "coverage.deductible"))
    return marked.select(
        "stem",
        laid.alias("modules"),
        F.when(premium, monthly(F.col("o_premium_month"), F.col("o_premium_year"))).otherwise(F.col("premium_month")).alias("premium_month"),
        F.when(premium, F.col("o_premium_year")).otherwise(F.col("premium_year")).alias("premium_year"),
        F.when(good, F.coalesce("o_deductible", "deductible")).otherwise(F.col("deductible")).alias("deductible"),
        F.when(good & superseded, F.col("deductible")).alias("original_deductible"),
        F.when(good, F.array_sort(fields)).alias("overlay_fields"),
        "violations",
        "notes",
    )


def all_or_nothing(merged: DataFrame) -> DataFrame:
    """The merged rows, or an error that names one violation as soon as a row has any: write only what this returns."""
    refused = F.raise_error(F.concat(F.col("stem"), F.lit(": "), F.array_join("violations", ", ")))
    return merged.filter(F.when(F.size("violations") > 0, refused.cast("boolean")).otherwise(F.lit(True)))


def united_items(items: DataFrame, by: str = "stem", item: str = "item", run: str = "run", ordinal: str = "ordinal") -> DataFrame:
    """by, items: the first spelling of each item in order of run and place; what folds to nothing is left out."""
    keyed = items.withColumn("__key", item_key(F.col(item))).filter("__key <> ''")
    first = keyed.groupBy(by, "__key").agg(F.min(F.struct(run, ordinal, item)).alias("x"))
    ordered = first.groupBy(by).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return ordered.select(by, F.transform("xs", lambda x: x[item]).alias("items"))


def united_lists(first: Column, second: Column) -> Column:
    """Two lists of one row united in order, the first spelling of each item; keys are made once and sorted, so that long lists stay cheap."""
    both = F.filter(F.concat(F.coalesce(first, F.array()), F.coalesce(second, F.array())), lambda x: x.isNotNull())
    keyed = F.sort_array(F.transform(both, lambda x, i: F.struct(item_key(x).alias("k"), i.alias("i"), x.alias("x"))))
    new = lambda ps: lambda p, n: (p["k"] != "") & (p["k"] != F.coalesce(F.get(ps, n - 1)["k"], F.lit("")))
    firsts = _bound(keyed, lambda ps: F.transform(F.filter(ps, new(ps)), lambda p: F.struct(p["i"], p["x"])))
    return F.transform(F.sort_array(firsts), lambda p: p["x"])


def merge_runs(runs: DataFrame, by: str = "stem", run: str = "run", size: str = "size", items: str = "items") -> DataFrame:
    """One row a stem: the longest run, the first of equals, with the items of all runs united after its own."""
    base = keep(runs, [by], F.col(size).desc(), F.col(run))
    order = runs.join(base.select(by, F.col(run).alias("__base")), by).withColumn("__run", F.when(F.col(run) == F.col("__base"), F.lit(-1)).otherwise(F.col(run)))
    exploded = order.select(by, F.col("__run").alias("run"), F.posexplode(items).alias("ordinal", "item"))
    merged = united_items(exploded, by).withColumnRenamed("items", "__items")
    return base.join(merged, by, "left").withColumn(items, F.coalesce("__items", items)).drop("__items")


def filled_count(df: DataFrame, column: str) -> Column:
    """How many fields of a struct, or keys of a map, hold anything: null, empty text, lists and maps do not count."""
    kind = df.schema[column].dataType
    if isinstance(kind, MapType):
        return F.coalesce(F.size(F.map_filter(column, lambda k, v: v.isNotNull() & (v.cast("string") != ""))), F.lit(0))

    def there(f: StructField) -> Column:
        c = F.col(f"{column}.{f.name}")
        has = F.size(c) > 0 if isinstance(f.dataType, ArrayType | MapType) else c != "" if isinstance(f.dataType, StringType) else c.isNotNull()
        return F.coalesce(has, F.lit(False)).cast("int")

    return sum((there(f) for f in kind.fields), F.lit(0))


def reconcile(prior: DataFrame, fresh: DataFrame, lists: list[str], by: str = "stem", scalars: tuple[str, ...] = ("insurer", "tariff", "stand")) -> DataFrame:
    """Fresh records that never fall behind prior ones, whole rows.

    The modules (a map) with more included, the coverage (a struct or map) with more fields, lists united with fresh
    first, the scalars fresh where set; every other column is fresh, and the premium goes. ``changed`` names what the
    prior record gave, ``reconciled`` says whether it gave anything.
    """
    counted = lambda d: d.withColumns({"__n_modules": F.coalesce(included_count(F.col("modules")), F.lit(0)), "__n_coverage": filled_count(d, "coverage")})
    p = counted(prior).select(by, *(F.col(c).alias(f"p_{c}") for c in ("modules", "coverage", "__n_modules", "__n_coverage", *lists, *scalars)))
    j = counted(fresh).join(p, by, "left")
    j = j.withColumns({f"__{c}": united_lists(F.col(c), F.col(f"p_{c}")) for c in lists})
    out, notes = {}, []
    for c in ("modules", "coverage"):
        more = F.coalesce(F.col(f"p___n_{c}") > F.col(f"__n_{c}"), F.lit(False))
        out[c] = F.when(more, F.col(f"p_{c}")).otherwise(F.col(c))
        notes.append(F.when(more, F.concat(F.lit(f"{c} "), F.col(f"__n_{c}").cast("string"), F.lit("->"), F.col(f"p___n_{c}").cast("string"))))
    for c in lists:
        size = F.coalesce(F.size(c), F.lit(0))
        out[c] = F.col(f"__{c}")
        notes.append(F.when(F.size(out[c]) != size, F.concat(F.lit(f"{c} "), size.cast("string"), F.lit("->"), F.size(out[c]).cast("string"))))
    for c in scalars:
        missing = (F.coalesce(c, F.lit("")) == "") & (F.coalesce(f"p_{c}", F.lit("")) != "")
        out[c] = F.when(missing, F.col(f"p_{c}")).otherwise(F.col(c))
        notes.append(F.when(missing, F.lit(f"{c}<-prior")))
    changed = F.array_compact(F.array(*notes))
    if "beitrag" in fresh.columns:
        out["beitrag"] = F.lit(None).cast(fresh.schema["beitrag"].dataType)
    return j.select(*(out.get(c, F.col(c)).alias(c) for c in fresh.columns), changed.alias("changed"), (F.size(changed) > 0).alias("reconciled"))


def upsert(prior: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and the prior ones whose keys they lack; ``action`` says added, updated or kept."""
    known = prior.select(*keys).distinct().withColumn("__known", F.lit(True))
    new = fresh.join(known, keys, "left").withColumn("action", F.when(F.col("__known"), "updated").otherwise("added")).drop("__known")
    kept = prior.join(fresh.select(*keys).distinct(), keys, "left_anti").withColumn("action", F.lit("kept"))
    return new.unionByName(kept)


def insert_missing(prior: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Prior rows, and the fresh ones whose keys they lack."""
    return prior.unionByName(fresh.join(prior.select(*keys).distinct(), keys, "left_anti").select(*prior.columns))


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def toggle(members: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Members without those asked for, and those asked for that were not members."""
    return delete(members, asked, keys).unionByName(asked.join(members.select(*keys).distinct(), keys, "left_anti").select(*members.columns))


def cache_classes(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """stem, outcome, source of each job: cached (same inputs, as many repeats), shared (a twin's inputs) or extract.

    jobs: stem, input_hash, repeat. cache: stem, input_hash, repeat, curated. A curated record is never run again; a
    twin is the first stem that has the inputs, curated ones aside.
    """
    own = cache.select("stem", F.col("input_hash").alias("c_hash"), F.col("repeat").alias("c_repeat"), F.col("curated").alias("c_curated"))
    twins = cache.filter(~F.coalesce("curated", F.lit(False))).groupBy(F.col("input_hash").alias("t_hash")).agg(F.min("stem").alias("twin"))
    j = jobs.join(own, "stem", "left").join(twins, F.col("input_hash") == F.col("t_hash"), "left")
    cached = F.coalesce("c_curated", F.lit(False)) | F.coalesce((F.col("c_hash") == F.col("input_hash")) & (F.col("c_repeat") >= F.col("repeat")), F.lit(False))
    shared = F.coalesce(F.col("twin") != F.col("stem"), F.lit(False))
    outcome = F.when(cached, "cached").when(shared, "shared").otherwise("extract")
    return j.select("stem", outcome.alias("outcome"), F.when(outcome == "shared", F.col("twin")).alias("source"))


def leaf_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path where two long forms (keys, path, value) differ; a missing path is not a null value."""
    x = a.select(*keys, "path", F.col("value").alias("old"), F.lit(True).alias("__a"))
    y = b.select(*keys, "path", F.col("value").alias("new"), F.lit(True).alias("__b"))
    joined = x.join(y, [*keys, "path"], "full_outer")
    return joined.filter(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "path", "old", "new")


def uncovered(differences: DataFrame, allowed: Column) -> DataFrame:
    """The differences at paths that no allowed path is or begins."""
    inside = F.exists(allowed, lambda p: (F.col("path") == p) | F.startswith("path", F.concat(p, F.lit("."))))
    return differences.filter(~F.coalesce(inside, F.lit(False)))
