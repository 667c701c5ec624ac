"""Benchmarks of models: runs to digests, scorecards, disagreement, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import scorecard


def aggregate(runs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each cell: runs, ok, schema_ok, faithful, least and most modules, most unsupported, mean cost and time.

    runs: keys, ok, schema_ok, faithful (booleans), modules, unsupported, cost, wall. Figures other than counts are of
    successful runs.
    """
    good = lambda c: F.when(F.col("ok"), F.col(c))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("ok").alias("ok"),
        F.count_if(F.col("ok") & F.col("schema_ok")).alias("schema_ok"),
        F.count_if(F.col("ok") & F.col("faithful")).alias("faithful"),
        F.min(good("modules")).alias("modules_min"),
        F.max(good("modules")).alias("modules_max"),
        F.max(good("unsupported")).alias("unsupported_max"),
        F.avg(good("cost")).alias("cost"),
        F.avg(good("wall")).alias("wall"),
    )


def scored(cells: DataFrame) -> DataFrame:
    """Cells with their score; the most modules of any cell is the measure, 1 at least."""
    most = F.broadcast(cells.agg(F.greatest(F.max("modules_max"), F.lit(1)).alias("__most")))  # one row
    score = scorecard(F.col("runs"), F.col("ok"), F.col("schema_ok"), F.col("faithful"), F.col("unsupported_max"), F.col("modules_max"), F.col("__most"))
    return cells.join(most, F.lit(True)).withColumn("score", score).drop("__most")


def disagreement(found: DataFrame, subject: str = "tariff", model: str = "model", item: str = "module") -> DataFrame:
    """subject, item, n_models of items that some of a subject's models found and others did not; two models at least."""
    models = found.groupBy(subject).agg(F.countDistinct(model).alias("n_all"))
    seen = found.filter(F.col(item).isNotNull()).groupBy(subject, item).agg(F.countDistinct(model).alias("n_models"))
    return seen.join(models, subject).filter("n_all >= 2 AND n_models < n_all").select(subject, item, "n_models", "n_all")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D+", "")


def grounded(value: Column, source: Column) -> Column:
    """Whether every number of two digits or more is in the source's digits; without such, whether the text is."""
    return grounded_in(value, digits(source), F.lower(source))


def grounded_in(value: Column, source_digits: Column, source_low: Column) -> Column:
    """The same against a source whose digits and lower case are at hand. Spaces inside a number belong to it."""
    numbers = F.filter(F.transform(F.regexp_extract_all(value, F.lit(r"(\d[\d.,\s]*\d|\d)"), F.lit(1)), digits), lambda n: F.length(n) >= 2)
    bare = F.trim(F.lower(value), F.lit(" \t\n\r\x0b\f"))
    return F.when(F.size(numbers) > 0, F.forall(numbers, lambda n: F.contains(source_digits, n))).otherwise(F.contains(source_low, bare))


def cost_totals(calls: DataFrame, cost: str = "cost") -> DataFrame:
    """One row: total of priced calls, and how many had a price or none."""
    return calls.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("total"), F.count(cost).alias("priced"), F.count_if(F.col(cost).isNull()).alias("unpriced"))
