"""Writers: dated snapshots, whole replacements, append-only logs, text and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snapshots import latest, same_rows


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A whole relation replaced by the commit protocol. The path must not be one that ``df`` reads."""
    df.write.mode("overwrite").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def snapshot_if_changed(new: DataFrame, stored: DataFrame, date: str, path: str, force: bool = False) -> bool:
    """A snapshot (without its date) stored under its date, unless it holds the rows of the one before it.

    The one before is the newest of an earlier date, so that a late snapshot is held against its own predecessor. The
    same date is written over.
    """
    before = latest(stored, "date", F.to_date(F.lit(date))).drop("date")
    if not force and not stored.filter(F.col("date") < F.to_date(F.lit(date))).isEmpty() and same_rows(before, new.select(*before.columns)).first()["unchanged"]:
        return False
    dated = new.withColumn("date", F.to_date(F.lit(date)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return True


def json_by_key(df: DataFrame, key: str, path: str) -> None:
    """A JSON document for each key, in a folder of its own (``key=value``), which the readers of documents take a key from."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    df.select(key, body.alias("value")).repartition(key).write.mode("append").partitionBy(key).text(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def markdown(df: DataFrame, title: str | None = None) -> DataFrame:
    """value: a table as Markdown lines, a row each in the order of the rows; bars in cells are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("–")), F.lit("|"), F.lit("\\|"))
    head = [f"# {title}"] if title else []
    head += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value"))
    lines = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, head))).alias("value"))
    return lines.unionByName(body)


def html_page(text) -> object:
    """Text escaped into a page."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit("<!doctype html><meta charset=utf-8><pre>"), text, F.lit("</pre>"))
