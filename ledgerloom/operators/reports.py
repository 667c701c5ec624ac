"""What a run did: tallies, one entry for the log, lines that tell a difference, sets to compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a line names the lists of a record.
LIST_NAMES = {"leistungen": "Leistungen", "ausschluesse": "Ausschlüsse", "besonderheiten": "Besonderheiten"}


def tally(results: DataFrame, outcome: str, outcomes: list[str]) -> DataFrame:
    """One row with a count for each outcome, 0 where there is none, and ``total``."""
    return results.agg(*(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes), F.count(F.lit(1)).alias("total"))


def run_entry(counted: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each of the named relations has. Relations are counted apart; only counts are brought together."""
    counts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, d in counted.items()]
    return reduce(DataFrame.unionByName, counts).agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counted))


def difference_lines(differences: DataFrame, key: str = "stem", most: int = 4) -> DataFrame:
    """key, line: one line for all differences of a record (key, section, name, old, new).

    Modules are counted, coverage fields named (the first few by name), items of lists counted as come and gone.
    """
    section = lambda s: F.col("section") == s
    counted = differences.groupBy(key).agg(
        F.count_if(section("modules")).alias("modules"), F.sort_array(F.collect_set(F.when(section("coverage"), F.col("name")))).alias("coverage"),
        *(F.count_if(section(s) & (F.col("name") == way)).alias(f"{s}_{way}") for s in LIST_NAMES for way in ("added", "removed")),
    )
    both = lambda s: F.concat(F.lit(f"{LIST_NAMES[s]} +"), F.col(f"{s}_added").cast("string"), F.lit("/−"), F.col(f"{s}_removed").cast("string"))
    said = [
        F.when(F.col("modules") > 0, F.concat(F.col("modules").cast("string"), F.lit(" Modul(e)"))),
        F.when(F.size("coverage") > 0, F.concat(F.lit("Coverage: "), F.array_join(F.slice("coverage", 1, most), ", "))),
        *(F.when(F.col(f"{s}_added") + F.col(f"{s}_removed") > 0, both(s)) for s in LIST_NAMES),
    ]
    return counted.select(key, F.coalesce(F.nullif(F.concat_ws("; ", *said), F.lit("")), F.lit("Detailänderung")).alias("line"))


def tracked_keys(*relations: DataFrame, key: str = "stem") -> DataFrame:
    """Keys that any of the relations holds, once each; names that begin with an underscore are no keys."""
    keys = reduce(DataFrame.unionByName, [r.select(key) for r in relations])
    return keys.filter(~F.startswith(key, F.lit("_"))).distinct()


def namespaces(registry: DataFrame, records: DataFrame, disabled: bool = False) -> DataFrame:
    """name, label, status, n: the namespaces of the registry that can be chosen, with how many records each has."""
    counted = records.groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("namespace", "name")
    open_ = registry if disabled else registry.filter("coalesce(status, '') <> 'disabled'")
    named = open_.select("name", F.coalesce("label", "name").alias("label"), F.coalesce("status", F.lit("")).alias("status"))
    return named.join(counted, "name", "left").fillna(0, ["n"])


def compare_pool(analysed: DataFrame, chosen: DataFrame, reference: str) -> DataFrame:
    """stem, is_reference, included: every analysed tariff, and whether it is compared now. A list is sorted by both first columns."""
    marked = analysed.select("stem").distinct().join(chosen.select("stem").distinct().withColumn("included", F.lit(True)), "stem", "left")
    return marked.select("stem", (F.col("stem") == reference).alias("is_reference"), F.coalesce("included", F.lit(False)).alias("included"))


def compare_set(chosen: DataFrame, before: DataFrame, analysed: DataFrame) -> DataFrame:
    """The new set: what was chosen, and of the old set what could not be shown, as it is not analysed yet."""
    waiting = before.select("stem").join(analysed.select("stem").distinct(), "stem", "left_anti")
    return chosen.select("stem").unionByName(waiting).distinct()


def run_name(name: Column) -> Column:
    """A struct of tariff, variant, filter, model and run from a saved run's name; null where it has too few parts.

    Parts stand between ``~``; the last three are variant, filter and model, which may end in ``__r`` and the run's number.
    """
    parts = F.split(name, "~")
    last = lambda n: F.element_at(parts, -n)
    tariff = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), " / ")
    run = F.coalesce(F.regexp_extract(last(1), "__r([0-9]+)$", 1).try_cast("int"), F.lit(0))
    read = F.struct(tariff.alias("tariff"), last(3).alias("variant"), last(2).alias("filter"), F.regexp_replace(last(1), "__r[0-9]+$", "").alias("model"), run.alias("run"))
    return F.when(F.size(parts) >= 5, read)


def labelled_keys(keys: DataFrame, labels: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """Keys with their labels; a key without one is its own."""
    return keys.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, key))
