"""Scores without prices: quality dimensions in [0, 1], their weighted sum, and the model scorecard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five dimensions' weights in the order in which they are summed.
WEIGHTS = {"note": 0.35, "leistung_cov": 0.22, "module_breadth": 0.20, "coverage_gen": 0.18, "bewertung": 0.05}
LEVELS = {"basis": 0, "komfort": 1, "premium": 2}
TIE = 1e-9


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def grade_score(note: Column) -> Column:
    """1.0 is best, 2.5 and worse nothing; a missing grade counts as nothing."""
    return F.coalesce(clamped((F.lit(2.5) - note) / F.lit(1.5)), F.lit(0.0))


def rating_score(stars: Column) -> Column:
    """4.5 stars are best, 3.5 nothing; a missing rating is neutral."""
    return F.coalesce(clamped(stars - F.lit(3.5)), F.lit(0.5))


def pre_score(note: Column, stars: Column) -> Column:
    return F.lit(0.7) * grade_score(note) + F.lit(0.3) * rating_score(stars)


def generosity(sum_insured: Column, wait_months: Column, scope: Column) -> Column:
    """Mean of three coarse scores; what is unknown is neutral."""
    has = lambda c, *words: F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    a = F.when(has(sum_insured, "unbegrenzt", "unlimit"), 1.0).otherwise(0.5)
    b = F.when(wait_months.isNull(), 0.5).when(wait_months <= 0, 1.0).when(wait_months <= 3, 0.5).otherwise(0.0)
    c = F.when(blank(scope), 0.5).when(has(scope, "weltweit", "world"), 1.0).when(has(scope, "europa", "europe"), 0.6).otherwise(0.3)
    return (a + b + c) / F.lit(3.0)


def included_count(modules: Column) -> Column:
    return F.size(F.filter(F.map_values(modules), lambda m: F.coalesce(m["included"], F.lit(False)))).cast("long")


def breadth(modules: Column, keys: list[str], needs: dict[str, float] | None = None) -> Column:
    """Share of the keys' modules that are included, each weighted by need; negative needs count as none."""
    on = lambda k: F.coalesce(F.try_element_at(modules, F.lit(k))["included"], F.lit(False))
    if needs is None:
        return sum((F.when(on(k), 1).otherwise(0) for k in keys), F.lit(0)) / F.lit(float(len(keys)))
    weight = {k: max(0.0, needs.get(k, 1.0)) for k in keys}
    total = sum(weight.values())
    if total <= 0:
        return F.lit(0.0)
    return sum((F.when(on(k), weight[k]).otherwise(0.0) for k in keys), F.lit(0.0)) / F.lit(total)


def level_rank(level: Column) -> Column:
    low = F.lower(F.trim(level))
    return F.coalesce(*(F.when(low == k, F.lit(v)) for k, v in LEVELS.items()))


def tier(modules: Column, keys: list[str]) -> Column:
    def rank(k: str) -> Column:
        m = F.try_element_at(modules, F.lit(k))
        return F.when(F.coalesce(m["included"], F.lit(False)), F.coalesce(level_rank(m["level"]), F.lit(0))).otherwise(0)

    return sum((rank(k) for k in keys), F.lit(0)) / F.lit(2.0 * len(keys))


def total(dims: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum, in the weights' order."""
    parts = [dims[k] * F.lit(w) for k, w in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def value_for_money(score: Column, price: Column) -> Column:
    return F.when(price > 0, score / price)


def scorecard(runs: Column, ok: Column, schema_ok: Column, faithful: Column, unsupported: Column, modules: Column, most_modules: Column) -> Column:
    """50 for faithful runs, 20 for valid ones, 15 less 5 for each unsupported claim, 15 for modules; nothing without a good run."""
    valid = schema_ok / runs
    fair = F.greatest(F.lit(0), F.lit(15) - F.lit(5) * unsupported)
    points = F.lit(50.0) * (faithful / runs) + F.lit(20.0) * valid + fair + F.lit(15.0) * (modules / most_modules) * valid
    return F.when(ok == 0, 0.0).otherwise(points)


def needs_are_neutral(needs: dict[str, float], keys: list[str], near: float = 1e-9) -> bool:
    """Whether every module is wanted alike, so that personal and plain breadth agree; negative needs count as none."""
    wanted = [max(0.0, needs.get(k, 1.0)) for k in keys]
    return max(wanted) - min(wanted) < near
