"""Giant texts trimmed in pieces: blocks of lines that many tasks share.

A text is cut once, at line ends, and its blocks are dealt to tasks by (key, block). What a block has to know of its
neighbours goes through a slim relation, a row a block without any text: hits near the edges, so that contexts reach
across; how many sections began before; and whether the section that runs over an edge has a hit anywhere. The two ways of
trimming are measured for the text as a whole, and the chosen one's pieces, joined, are what ``trimming.trim`` gives.

Defined cases: a null text or key has no block and no result; an empty text has one block, of one empty line. Keys stand
once (rows of one key would be taken for one text); other columns are not kept. Anchors do not reach across line ends.
The slim rows of one text meet in one task: a text has at most 2^31 bytes, so these are at most 2^31 / ``size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dehyphenated
from ..session import dealt, work_folder
from .trimming import BUDGET, CONTEXT, FLOOR, GAP, _bound, _marks, _wider, lines

BLOCK_LINES = 4096
_CUT = "(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029) + "])|(?<=\r)(?!\n)"
_HEADER = r"[^\S\n]*§[^\S\n]*\d"


def line_blocks(docs: DataFrame, key: str, text: str, size: int = BLOCK_LINES) -> DataFrame:
    """key, block (from 0), raw: the de-hyphenated texts in blocks of ``size`` lines with their line ends."""

    def cut(parts: Column) -> Column:
        n = F.size(parts) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i * size + 1, size), ""))

    whole = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    return whole.select(F.col(key).alias("key"), F.posexplode(_bound(F.split(dehyphenated(F.col(text)), _CUT), cut)).alias("block", "raw"))


def _right(s: Column, n: int) -> Column:
    return F.substring(s, -n, n) if n else F.lit("")


def _edges(blocks: DataFrame, context: int) -> DataFrame:
    """key, block, before and after (marks of the neighbours' nearest lines), lead and tail (hits of the sections running over its edges)."""
    order = Window.partitionBy("key").orderBy("block")
    first, last = F.element_at("hits", 1) == "1", F.element_at("hits", -1) == "1"
    slim = blocks.select(
        "key", "block", _right(F.col("marks"), context + 1).alias("ending"), F.substring("marks", 1, context).alias("begin"), F.col("heads"),
        (first & ~F.col("opens")).alias("lead_hit"), last.alias("tail_hit"),
    )
    slim = slim.select(
        "key", "block", "heads", "lead_hit", "tail_hit", F.lag("ending", 1, "").over(order).alias("before"), F.lead("begin", 1, "").over(order).alias("after"),
        (F.sum("heads").over(order) - F.col("heads")).alias("section"),
    )
    over = F.array(F.struct("section", F.col("lead_hit").alias("hit")), F.struct((F.col("section") + F.col("heads")).alias("section"), F.col("tail_hit").alias("hit")))
    held = slim.select("key", F.explode(over).alias("s")).groupBy("key", F.col("s.section").alias("section")).agg(F.max("s.hit").alias("hit"))
    tails = held.select("key", F.col("section").alias("tail_section"), F.col("hit").alias("tail"))
    out = slim.join(held.withColumnRenamed("hit", "lead"), ["key", "section"]).withColumn("tail_section", F.col("section") + F.col("heads"))
    return out.join(tails, ["key", "tail_section"]).select("key", "block", "before", "after", "lead", "tail")


def _shown(parts: Column, marks: Column, was: Column) -> Column:
    """The marked parts, one gap for each run of others; a run that began before (``was`` is 0) has its gap there. Null: nothing of it shows."""
    signs = F.split(F.substr(F.regexp_replace(F.concat(was, marks), "(?<=0)0", "-"), F.length(was) + 1), "(?!^)(?=.)")
    out = F.zip_with(parts, signs, lambda x, m: F.when(m == "1", x).when(m == "0", F.lit(GAP)))
    return _bound(F.filter(out, lambda x: x.isNotNull()), lambda o: F.when(F.size(o) > 0, F.array_join(o, "\n")))


def _flag(hit: Column) -> Column:
    return F.when(hit, "1").otherwise("0")


def _window_piece(context: int) -> Column:
    marks, inner = F.col("marks"), F.col("block") > 0
    left, near = _right(F.col("before"), context), F.substring("marks", 1, context)
    wide = _wider(F.concat(left, marks, F.substring("after", 1, context)), context)
    was = F.when(inner, _flag(F.contains(F.concat(_right(F.col("before"), context + 1), near), F.lit("1")))).otherwise("")
    return _shown(F.col("ls"), F.substr(wide, F.length(left) + 1, F.length(marks)), was)


def _section_piece() -> Column:
    n = F.size("parts")
    flags = F.transform(F.col("hits"), lambda h, i: F.when((i == 0) & ~F.col("opens"), _flag(F.col("lead"))).when(i == n - 1, _flag(F.col("tail"))).otherwise(h))
    return _shown(F.col("parts"), F.array_join(flags, ""), F.when(F.col("block") > 0, _flag(F.col("lead"))).otherwise(""))


def trim_pieces(docs: DataFrame, key: str, text: str, anchors: str, context: int = CONTEXT, floor: float = FLOOR, budget: int | None = None, size: int = BLOCK_LINES) -> DataFrame:
    """key, block, text: pieces that, joined in the order of their blocks, are the trimmed texts.

    As ``trimming.trim``; with a ``budget``, as ``trimming.trim_to_budget``. The blocks are written once to the shared folder
    (``session.work_folder``), from which the measuring and the writing pass read them. Text is
    shuffled by (key, block) alone, so that a giant one is never in one task.
    """
    if size <= context:
        raise ValueError("blocks must hold more lines than the context")
    at = work_folder(docs.sparkSession)
    cut = dealt(line_blocks(docs, key, text, size), "key", "block").withColumn("ls", lines(F.col("raw")))
    cut = cut.withColumn("marks", _marks(F.col("ls"), anchors)).withColumn("parts", F.split(F.array_join("ls", "\n"), rf"\n(?={_HEADER})"))
    cut = cut.withColumn("opens", (F.col("block") > 0) & F.rlike(F.element_at("ls", 1), F.lit(f"^{_HEADER}")))
    cut = cut.withColumn("hits", F.split(_marks(F.col("parts"), anchors), "(?!^)(?=.)")).withColumn("heads", F.size("parts") - 1 + F.col("opens").cast("int"))
    cut.drop("ls", "parts").write.parquet(at)
    spark = docs.sparkSession
    blocks = spark.read.parquet(at)
    edges = _edges(blocks, context)

    def told(slim: DataFrame) -> DataFrame:
        out = dealt(blocks, "key", "block").join(slim, ["key", "block"]).withColumn("ls", lines(F.col("raw")))
        return out.withColumn("parts", F.split(F.array_join("ls", "\n"), rf"\n(?={_HEADER})"))

    widths = list(range(context, 0, -1)) if budget is not None else [context]
    glued = lambda piece: _bound(piece, lambda p: F.when(F.col("block") > 0, F.concat(F.lit("\n"), p)).otherwise(p))
    ways = [*(glued(_window_piece(c)) for c in widths), glued(_section_piece()), F.col("raw")]
    length = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long")
    sizes = told(edges).select("key", "marks", *(w.alias(f"w{i}") for i, w in enumerate(ways))).groupBy("key").agg(
        F.max(F.contains("marks", F.lit("1"))).alias("found"), F.array(*(length(f"w{i}") for i in range(len(ways)))).alias("n")
    )
    chosen = sizes.select("key", _way(len(widths), floor, budget).alias("way"))
    picked = told(edges.join(chosen, "key")).withColumn("text", _nth(ways)).filter(F.col("text").isNotNull())
    return picked.select(F.col("key").alias(key), "block", "text")


def _nth(ways: list[Column]) -> Column:
    out = F.when(F.col("way") == 0, ways[0])
    for i, w in enumerate(ways[1:], 1):
        out = out.when(F.col("way") == i, w)
    return out


def _way(widths: int, floor: float, budget: int | None) -> Column:
    """Which way a text takes: a context's number, then the sections, then the text as it is."""
    n = lambda i: F.get("n", F.lit(i))
    section, whole = widths, widths + 1
    fits = lambda i: n(i) >= n(whole) * F.lit(floor)

    def best(i: int) -> Column:
        shorter = F.when(n(i) <= n(section), i).otherwise(section)
        return F.when(fits(i) & fits(section), shorter).when(fits(i), i).when(fits(section), section).when(F.col("found"), shorter).otherwise(whole)

    if budget is None:
        return best(0)
    return F.coalesce(*(F.when(F.get("n", best(i)) <= budget, best(i)) for i in range(widths)), best(widths - 1))


def put_together(pieces: DataFrame, key: str) -> DataFrame:
    """key, text: one trimmed text of each, for those whose trimmed text goes into one value, as a model's input does."""
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
