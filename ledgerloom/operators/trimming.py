"""Long texts cut down to what stands near an anchor.

All within a document's own array of lines, so that no line leaves its row: no shuffle, and no window over a text.
Which lines hit an anchor is a string of marks, a character a line, so that widening the hits and finding the runs
between them are single passes over a short string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import dehyphenated, sharp_s_folded

GAP = "[…]"
CONTEXT, FLOOR, BUDGET = 4, 0.15, 290_000


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def lines(text: Column) -> Column:
    """Lines of a text; all of the line ends count and the last one leaves no empty line."""
    ends = "[\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029) + "](?:(?<=\r)\n)?"
    cut = F.split(F.regexp_replace(text, ends, "\n"), "\n")
    return _bound(cut, lambda ls: F.when((F.size(ls) > 1) & (F.element_at(ls, -1) == ""), F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls))


def _hit(line: Column, anchors: str) -> Column:
    return F.rlike(sharp_s_folded(line), F.lit(f"(?i){anchors}"))


def _marks(parts: Column, anchors: str) -> Column:
    """1 for a part with a hit, else 0."""
    return F.array_join(F.transform(parts, lambda x: F.when(_hit(x, anchors), "1").otherwise("0")), "")


def _wider(marks: Column, context: int) -> Column:
    """Marks with as many more on either side of each 1."""
    for _ in range(context):
        marks = F.regexp_replace(marks, "0(?=1)|(?<=1)0", "1")
    return marks


def _kept(parts: Column, marks: Column) -> Column:
    """The marked parts, and one gap for each run of others."""
    shown = F.split(F.regexp_replace(marks, "(?<=0)0", "-"), "(?!^)(?=.)")
    out = F.zip_with(parts, shown, lambda x, m: F.when(m == "1", x).when(m == "0", F.lit(GAP)))
    return F.array_join(F.filter(out, lambda x: x.isNotNull()), "\n")


def window_trim(text_lines: Column, anchors: str, context: int = CONTEXT) -> Column:
    """Lines within ``context`` of a hit; each run of others is one gap mark, a leading one too."""
    return _bound(text_lines, lambda ls: _kept(ls, _wider(_marks(ls, anchors), context)))


def section_trim(text: Column, anchors: str) -> Column:
    """Sections from header to header that hold a hit; a run of dropped ones is one gap mark."""
    return _sections(lines(text), anchors)


def _sections(text_lines: Column, anchors: str) -> Column:
    blocks = F.split(F.array_join(text_lines, "\n"), r"\n(?=[^\S\n]*§[^\S\n]*\d)")
    return _bound(blocks, lambda bs: _kept(bs, _marks(bs, anchors)))


def _prepared(text: Column, anchors: str, then: Callable[[Column], Column]) -> Column:
    """then() of the de-hyphenated text, its lines, their marks and its trimmed sections, each computed once."""
    halfway = lambda w: F.struct(w.alias("whole"), lines(w).alias("ls"))
    marked = lambda s: F.struct(s["whole"].alias("whole"), s["ls"].alias("ls"), _sections(s["ls"], anchors).alias("sections"), _marks(s["ls"], anchors).alias("marks"))
    return _bound(dehyphenated(text), lambda w: _bound(halfway(w), lambda s: _bound(marked(s), then)))


def _choice(s: Column, context: int, floor: float, anchors: str) -> Column:
    least = F.length(s["whole"]) * F.lit(floor)
    both = F.struct(_kept(s["ls"], _wider(s["marks"], context)).alias("a"), s["sections"].alias("b"))

    def pick(c: Column) -> Column:
        a, b = c["a"], c["b"]
        shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
        fits = lambda x: F.length(x) >= least
        return F.when(fits(a) & fits(b), shorter).when(fits(a), a).when(fits(b), b).when(_hit(s["whole"], anchors), shorter).otherwise(s["whole"])

    return _bound(both, pick)


def trim(text: Column, anchors: str, context: int = CONTEXT, floor: float = FLOOR) -> Column:
    """The shorter of both ways that keeps at least ``floor`` of the text; the shortest if neither does but an anchor is there, else the text."""
    return _prepared(text, anchors, lambda s: _choice(s, context, floor, anchors))


def trim_to_budget(text: Column, anchors: str, budget: int = BUDGET, context: int = CONTEXT, floor: float = FLOOR) -> Column:
    """The widest context from ``context`` down to 1 whose result fits; the narrowest if none does."""

    def widest(s: Column) -> Column:
        tries = F.array(*(_choice(s, c, floor, anchors) for c in range(context, 0, -1)))
        return _bound(tries, lambda t: F.coalesce(F.get(F.filter(t, lambda x: F.length(x) <= budget), 0), F.element_at(t, -1)))

    return _prepared(text, anchors, widest)


def sizes(original: Column, trimmed: Column) -> Column:
    """Characters before and after, percentage kept, and about how many tokens that is."""
    return _bound(
        F.struct(F.length(original).cast("long").alias("a"), F.length(trimmed).cast("long").alias("b")),
        lambda n: F.struct(n["a"].alias("chars"), n["b"].alias("kept"), (n["b"] * F.lit(100.0) / F.greatest(n["a"], F.lit(1))).alias("kept_pct"), (n["b"] / 4).cast("long").alias("tokens")),
    )
