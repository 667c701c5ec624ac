"""Readers of the stored relations. Every schema is declared; broken files are left out where the data model says so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import money, squeezed
from ..operators.dedup import keep
from ..schemas import BENCHMARK, DELIMITED, MANIFEST, RATINGS, RECORD, SNAPSHOT, TAXONOMY

#: A date or a key in the name of a file, or of its folder as a writer partitions by it.
DATED = r"(?:^|[/=])(\d{4}-\d{2}-\d{2})(?:\.json|/[^/]+)$"
NAMED = r"(?:stem=([^/]+)/[^/]+|([^/]+)\.json)$"


def json_documents(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """A row for each JSON file, with ``file``. Files that do not parse are left out, or fail where strict."""
    if strict:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        return df.withColumn("file", F.col("_metadata.file_path"))
    reader = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    return reader.json(path).withColumn("file", F.col("_metadata.file_path")).filter("_broken IS NULL").drop("_broken")


def records(spark: SparkSession, pure: str | list[str], enriched: str | list[str] | None = None) -> DataFrame:
    """Tariff records with ``stem`` of the file name or folder; an enriched one stands for its pure twin. Names with _ are skipped."""
    found = json_documents(spark, pure, RECORD).withColumn("enriched", F.lit(False))
    if enriched:
        found = found.unionByName(json_documents(spark, enriched, RECORD).withColumn("enriched", F.lit(True)))
    file = F.try_url_decode("file")
    named = found.withColumn("stem", F.concat(F.regexp_extract(file, NAMED, 1), F.regexp_extract(file, NAMED, 2))).filter(~F.startswith("stem", F.lit("_")))
    return keep(named, ["stem"], F.col("enriched").desc()).drop("file")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A row for each market row of each dated snapshot; files whose name is not a date are left out."""
    found = json_documents(spark, path, SNAPSHOT).withColumn("date", F.try_to_date(F.regexp_extract("file", DATED, 1))).filter("date IS NOT NULL")
    return found.select("date", "profile", "source", F.posexplode("tariffs").alias("ordinal", "t")).select("date", "profile", "source", "ordinal", "t.*")


def delimited_rows(spark: SparkSession, path: str) -> DataFrame:
    """Market rows from six fields parted by pipes, # before comments; another number of fields fails."""
    raw = spark.read.schema(DELIMITED).option("sep", "|").option("comment", "#").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return shaped_rows(raw)


def shaped_rows(raw: DataFrame) -> DataFrame:
    """Prices of text as numbers and the key of insurer, product and band."""
    key = F.concat_ws("|", squeezed(F.col("insurer")), squeezed(F.col("product")), squeezed(F.col("selbstbeteiligung")))
    return raw.withColumn("monatlich_eur", money(F.col("monatlich_eur"))).withColumn("key", key)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of a URL manifest, with its place; a broken file fails."""
    found = json_documents(spark, path, MANIFEST, strict=True)
    return found.select(F.posexplode("tariffs").alias("ordinal", "t")).select("ordinal", "t.*")


def document_index(entries: DataFrame) -> DataFrame:
    """stem, doctype, kind, file_name, url of every document of a manifest."""
    return entries.select("stem", F.explode("docs").alias("d")).select("stem", "d.doctype", "d.kind", F.col("d.file").alias("file_name"), "d.url")


def benchmark_rows(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, BENCHMARK).select(F.explode("rows").alias("r")).select("r.*")


def ratings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scope, subject, source, badge, stand, url) of all ratings, and (stem, alias_of)."""
    found = json_documents(spark, path, RATINGS)

    def flat(column: str, scope: str) -> DataFrame:
        each = found.select(F.explode(column).alias("subject", "rs")).select(F.lit(scope).alias("rating_scope"), "subject", F.explode("rs").alias("r"))
        return each.select(F.col("rating_scope").alias("scope"), "subject", "r.source", "r.badge", "r.stand", "r.url")

    aliases = found.select(F.explode("tariff_aliases").alias("stem", "alias_of"))
    return flat("tariffs", "tariff").unionByName(flat("insurers", "insurer")), aliases


def json_config(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """One row of settings: what the file gives in the right type, else the default; unknown keys are ignored."""
    given = json_documents(spark, path, schema).drop("file").limit(1)
    filled = spark.range(1).join(given, F.lit(True), "left").drop("id")
    return filled.select(*(F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """kind, cat_ord, key, label_de, syn_ord, synonym of a taxonomy file {kind: [{key, label_de, synonyms}]}."""
    cats = json_documents(spark, path, TAXONOMY).select(F.explode("taxonomy").alias("kind", "cs")).select("kind", F.posexplode("cs").alias("cat_ord", "c"))
    return cats.select("kind", "cat_ord", "c.key", "c.label_de", F.posexplode("c.synonyms").alias("syn_ord", "synonym"))


def module_keys(spark: SparkSession, path: str) -> DataFrame:
    """ord, key of the modules that a JSON schema document declares, in its order."""
    text = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys(F.get_json_object("value", "$.properties.modules.properties"))
    return text.select(F.posexplode(keys).alias("ord", "key"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def payloads(docs: DataFrame, head: str, by: str = "stem") -> DataFrame:
    """by, payload: a head and each document (doctype, text) under its label, in order of doctype."""
    ordered = docs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("doctype", "text"))).alias("d"))
    parts = F.transform("d", lambda x: F.concat(F.lit("\n\n=== "), x["doctype"], F.lit(" ===\n"), x["text"]))
    return ordered.select(by, F.concat(F.lit(head), F.array_join(parts, "")).alias("payload"))


def binary_documents(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """path, modificationTime, length, content, is_pdf of files; those that ``known`` (path, seen) has as new are left out."""
    found = spark.read.format("binaryFile").load(path)
    if known is not None:
        newer = (found["path"] == known["path"]) & (known["seen"] >= found["modificationTime"])
        found = found.join(known, newer, "left_anti")
    return found.withColumn("is_pdf", F.substring("content", 1, 5) == F.lit(b"%PDF-"))
