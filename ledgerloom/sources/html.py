"""Rows out of HTML pages by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import entities_decoded


def field(block: Column, pattern: str) -> Column:
    """The first group of a pattern, entities decoded and spaces squeezed; null where it does not match."""
    found = F.regexp_extract(block, f"(?s){pattern}", 1)
    return F.when(F.rlike(block, F.lit(f"(?s){pattern}")), F.trim(F.regexp_replace(entities_decoded(found), r"\s+", " ")))


def labelled(block: Column, label: str, close: str = "</span>") -> Column:
    """The text after a label, at most 3000 characters on."""
    return field(block, rf"{label}.{{0,3000}}?>([^<]*){close}")


def pairs(block: Column, pattern: str) -> Column:
    """All (first group, second group) of a pattern as a map; null without any."""
    keys, values = (F.regexp_extract_all(block, F.lit(f"(?s){pattern}"), F.lit(i)) for i in (1, 2))
    return F.when(F.size(keys) > 0, F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: F.element_at(values, F.array_position(keys, k).cast("int")))))


def blocks(pages: DataFrame, key: str, html: str, start: str) -> DataFrame:
    """key, block_no, block: pages cut before every match of ``start``; what stands before the first is left out."""
    parts = F.split(html, f"(?={start})")
    exploded = pages.select(key, F.posexplode(parts).alias("block_no", "block"))
    return exploded.filter(F.rlike("block", F.lit(f"^(?:{start})")))


def rows(found: DataFrame, key: str, fields: dict[str, str], needed: list[str]) -> DataFrame:
    """The blocks' fields; blocks without a needed one are dropped, and position counts those that stay."""
    read = found.select(key, "block_no", *(field(F.col("block"), p).alias(n) for n, p in fields.items()))
    kept = read.filter(" AND ".join(f"{n} IS NOT NULL AND {n} <> ''" for n in needed))
    place = F.row_number().over(Window.partitionBy(key).orderBy("block_no"))
    return kept.withColumn("position", place.cast("long")).drop("block_no")


def innermost(nodes: DataFrame) -> DataFrame:
    """Of qualifying nodes (page, node, parent) those without a qualifying child."""
    parents = nodes.select("page", F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    return nodes.join(parents, ["page", "node"], "left_anti")


def first_nonempty(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The rows of the first extractor; of the second for pages that the first finds nothing on."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def undercount(found: DataFrame, pages: DataFrame, key: str, html: str, signal: str) -> DataFrame:
    """key, n_rows, n_signals of pages with fewer rows than an independent mark on them says."""
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    marks = pages.select(key, F.regexp_count(html, F.lit(signal)).cast("long").alias("n_signals"))
    return marks.join(n, key, "left").fillna(0, ["n_rows"]).filter("n_rows < n_signals").select(key, "n_rows", "n_signals")


def bundles(links: DataFrame, key: str, url: str) -> DataFrame:
    """key, bundle, urls: an id for each set of links, whatever their order."""
    grouped = links.groupBy(key).agg(F.sort_array(F.collect_set(url)).alias("urls"))
    return grouped.select(key, F.concat(F.lit("panel:"), F.substring(F.sha2(F.array_join("urls", "\n"), 256), 1, 16)).alias("bundle"), "urls")


def revealed(states: DataFrame, key: str, order: str, links: str) -> DataFrame:
    """The links that each step shows and the step before did not."""
    before = F.lag(links).over(Window.partitionBy(key).orderBy(order))
    return states.select(key, order, F.array_except(links, F.coalesce(before, F.array().cast("array<string>"))).alias("new_links"))
