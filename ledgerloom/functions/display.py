"""Cells as text: money, differences, bars, sparklines, badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import level_rank

GLYPHS = "▁▂▃▄▅▆▇█"


def euros(v: Column) -> Column:
    """Two decimals; null a dash."""
    return F.coalesce(F.format_string("%.2f", v), F.lit("–"))


def price_delta(price: Column, base: Column) -> Column:
    """Difference, percentage and direction; null if a side is missing, 0 percent over a base of 0."""
    d = price - base
    return F.when(
        d.isNotNull(),
        F.struct(d.alias("delta"), F.when(base == 0, 0.0).otherwise(d / F.when(base != 0, base) * 100).alias("pct"), F.when(d < 0, "cheaper").when(d > 0, "pricier").otherwise("same").alias("direction")),
    )


def sparkline(values: Column) -> Column:
    """A glyph for each value between the array's own least and largest; null a dot, a flat line the middle."""
    low, high = F.array_min(values), F.array_max(values)

    def glyph(v: Column) -> Column:
        at = F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * 7).cast("int") + 1
        return F.when(v.isNull(), "·").when(high == low, GLYPHS[4]).otherwise(F.substring(F.lit(GLYPHS), at, F.lit(1)))

    return F.array_join(F.transform(values, glyph), "")


def level_direction(old: Column, new: Column) -> Column:
    """1 up, -1 down, 0 same; null where a level is unknown."""
    return F.signum(level_rank(new) - level_rank(old)).cast("long")


def module_cell(included: Column, level: Column) -> Column:
    low = F.lower(F.coalesce(level, F.lit("")))
    return (
        F.when(~F.coalesce(included, F.lit(False)), "–").when(low == "basis", "B").when(low == "komfort", "K").when(low == "premium", "P").otherwise("✓")
    )


def status(analysed: Column, pdf: Column, urls: Column) -> Column:
    return F.when(analysed, "analysed").when(pdf, "pdf").when(urls, "urls").otherwise("listed")


def price_band(price: Column, q1: Column, q3: Column) -> Column:
    return F.when(price.isNull(), "none").when(price <= q1, "cheap").when(price >= q3, "expensive").otherwise("middle")


def grade_band(note: Column) -> Column:
    return F.when(note.isNull(), "neutral").when(note <= 1.3, "good").when(note <= 2.0, "fair").otherwise("weak")


def lerp_hex(a: str, b: str, t: Column) -> Column:
    """The colour between two; halves round to even."""
    parts = [(int(a[i : i + 2], 16), int(b[i : i + 2], 16)) for i in (1, 3, 5)]
    return F.format_string("#%02x%02x%02x", *(F.bround(F.lit(float(x)) + F.lit(float(y - x)) * t).cast("int") for x, y in parts))


def bar(fraction: Column, width: int) -> Column:
    n = F.bround(F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def padded(s: Column, width: int) -> Column:
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(F.rpad(s, width, " "))


def initials(stem: Column) -> Column:
    """The insurer of a stem: short ones in capitals, others with a first capital."""
    part = F.element_at(F.split(stem, "__"), 1)
    return F.when(F.length(part) <= 4, F.upper(part)).otherwise(F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 2**31 - 1)))


def score_band(total: Column, failed: Column) -> Column:
    return F.when(failed, "dnf").when(total >= 90, "high").when(total >= 60, "middle").otherwise("low")
