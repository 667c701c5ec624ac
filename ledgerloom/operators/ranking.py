"""Ranking by quality alone: total scores, pre-selection with announced ties, warnings, personal needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from .dedup import keep, representatives

DIMENSIONS = list(scores.WEIGHTS)


def rank(records: DataFrame, market: DataFrame, weights: dict[str, float] = scores.WEIGHTS) -> DataFrame:
    """stem, the five dimensions, total, price and value; ``best_first`` orders them.

    records: stem, n_modules, leistung_cov, module_breadth, coverage_gen. market: rows with stem, note, bewertung, price,
    position. The price never enters the total; a record without a market row keeps null grade, rating and price.
    """
    best = representatives(market).select("stem", "note", "bewertung", "price")
    joined = records.join(best, "stem", "left")
    dims = {
        "note": scores.grade_score(F.col("note")),
        "leistung_cov": F.col("leistung_cov"),
        "module_breadth": F.col("module_breadth"),
        "coverage_gen": F.col("coverage_gen"),
        "bewertung": scores.rating_score(F.col("bewertung")),
    }
    scored = joined.select("stem", "price", *(c.alias(f"dim_{k}") for k, c in dims.items()), scores.total(dims, weights).alias("total"))
    return scored.withColumn("value", scores.value_for_money(F.col("total"), F.col("price")))


def best_first(ranked: DataFrame) -> DataFrame:
    """By total, then price, missing ones last, then stem."""
    return ranked.orderBy(F.col("total").desc(), F.col("price").asc_nulls_last(), "stem")


def relative_value(ranked: DataFrame) -> DataFrame:
    """The ranking with value as a share of the best value."""
    most = F.broadcast(ranked.agg(F.max("value").alias("__most")))  # one row
    return ranked.join(most, F.lit(True)).withColumn("relative_value", F.col("value") / F.col("__most")).drop("__most")


def contributions(ranked: DataFrame, weights: dict[str, float] = scores.WEIGHTS) -> DataFrame:
    """stem, dimension, raw, weight, contribution: the total taken apart."""
    parts = F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(f"dim_{k}").alias("raw"), F.lit(w).alias("weight")) for k, w in weights.items()))
    return ranked.select("stem", F.explode(parts).alias("p")).select("stem", "p.*", (F.col("p.raw") * F.col("p.weight")).alias("contribution"))


def prescore(market: DataFrame) -> DataFrame:
    """insurer, product, pre_score, position of the best scored row of each product; the first of equals."""
    scored = market.withColumn("pre_score", scores.pre_score(F.col("note"), F.col("bewertung")))
    return keep(scored, ["insurer", "product"], F.col("pre_score").desc(), F.col("position").asc_nulls_last())


def top_with_ties(scored: DataFrame, k: int, score: str = "pre_score", *order: str) -> DataFrame:
    """Rows with their place and a mark: selected (first k), tied (beyond, with the score at the cut) or dropped.

    k <= 0 or beyond the number of rows selects all. The order should be total: rows that are equal in all of it stand or
    fall together. Every row is held against the k-th one, and places are given to the selected ones only.
    """
    if k <= 0:
        return scored.withColumns({"place": F.lit(None).cast("long"), "mark": F.lit("selected")})
    at = F.struct((-F.col(score)).alias("__s"), *(x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"__n{i}"), F.col(c).alias(f"__c{i}"))))
    first = scored.select(at.alias("__at"), F.col(score).alias("__score")).orderBy("__at").limit(k)
    cut = F.broadcast(first.agg(F.max("__at").alias("__last"), F.min("__score").alias("__cut")))  # one row
    met = scored.withColumn("__at", at).join(cut, F.lit(True), "left")
    mark = F.when(F.col("__at") <= F.col("__last"), "selected").when(F.abs(F.col(score) - F.col("__cut")) < scores.TIE, "tied").otherwise("dropped")
    marked = met.withColumn("mark", mark)
    selected = marked.filter("mark = 'selected'").withColumn("place", F.row_number().over(Window.orderBy("__at")).cast("long"))
    rest = marked.filter("mark <> 'selected'").withColumn("place", F.lit(None).cast("long"))
    return selected.unionByName(rest).select(*scored.columns, "place", "mark")


def low_confidence(records: DataFrame, count: str = "n_categories") -> DataFrame:
    """Records with a mark where the count is under max(3, 0.4 * median); none with fewer than two records."""
    whole = F.broadcast(records.agg(F.greatest(F.lit(3.0), F.lit(0.4) * F.median(count)).alias("__floor"), F.count(F.lit(1)).alias("__n")))  # one row
    marked = records.join(whole, F.lit(True)).withColumn("low_confidence", (F.col("__n") >= 2) & (F.col(count) < F.col("__floor")))
    return marked.drop("__floor", "__n")


def shared_documents(records: DataFrame, key: str = "stem", digest: str = "input_hash") -> DataFrame:
    """key, digest, n: the records that rest on the same documents as others, a row each; a missing digest shares nothing."""
    each = records.filter(F.col(digest).isNotNull()).select(key, digest).distinct()
    several = each.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return each.join(several, digest).select(key, digest, "n")
