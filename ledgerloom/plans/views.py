"""The test tables seen as the relations of the data model, in Spark and in SQL."""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import generosity
from ..functions.text import stem
from ..operators.taxonomy import classify

OLD, NEW = "2001-09-01", "2001-10-01"
REFERENCE, REFERENCE_BAND = "brand-13__promo", "AF"
TAXONOMY = [("fastener", ["bolt", "rod"]), ("motion", ["gear", "ring"]), ("colour", ["red", "blue"]), ("size", ["large", "small"]), ("flat", ["plate", "anvil"])]
MODULES = [f"m{i}" for i in range(8)]
BLOCK = 2**20
NEEDS = {"m0": 3.0, "m1": 2.0, "m2": 0.0, "m3": -1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market(spark: SparkSession, sf_dir: str, month: str | None = None, places: bool = True) -> DataFrame:
    """Market rows by month: insurer, product, band, key, stem, cents, price, note, bewertung, position.

    One month's rows are asked for by its dates, which the scan can skip by. Without `places`, position is left out with its shuffle.
    """
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if month:
        lines = lines.filter(F.col("l_shipdate").between(F.to_timestamp_ntz(F.lit(f"{month} 00:00:00")), F.to_timestamp_ntz(F.lit(f"{_last_day(month)} 23:59:59.999999"))))
    joined = lines.join(parts.select("p_partkey", "p_brand", "p_type"), lines["l_partkey"] == parts["p_partkey"])
    rows = joined.select(
        F.trunc("l_shipdate", "month").alias("date"), F.col("p_brand").alias("insurer"), F.col("p_type").alias("product"),
        F.concat("l_returnflag", "l_linestatus").alias("band"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("cents"),
        (F.lit(1.0) + F.lit(15.0) * F.col("l_discount")).alias("note"), (F.lit(3.5) + F.lit(10.0) * F.col("l_tax")).alias("bewertung"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )
    named = (numbered(rows) if places else rows).withColumns({"key": F.concat_ws("|", "insurer", "product", "band"), "stem": stem(F.col("insurer"), F.col("product")), "price": F.col("cents") / F.lit(100.0)})
    return named.select("date", *["position"] * places, "insurer", "product", "band", "key", "stem", "cents", "price", "note", "bewertung")


def numbered(rows: DataFrame, width: int = BLOCK) -> DataFrame:
    """Adds position, the row's place in its month, from 1, by order, line and what else tells rows apart.

    Rows are ranked inside their month's blocks of `width` order keys; how many rows stand in earlier blocks comes from the
    blocks' counts, so that no task sorts a whole month. Rows without an order or a date stand first, in blocks of their own.
    """
    dealt = rows.withColumn("__block", F.floor(F.col("l_orderkey") / F.lit(width)))
    inside = Window.partitionBy("date", "__block").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    earlier = Window.partitionBy("__date").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("date").alias("__date"), F.col("__block").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__date", "__at", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(inside))
    placed = ranked.join(before, F.col("date").eqNullSafe(F.col("__date")) & F.col("__block").eqNullSafe(F.col("__at")))
    return placed.withColumn("position", (F.col("__before") + F.col("__rank")).cast("long")).drop("__block", "__rank", "__date", "__at", "__before")


def _last_day(month: str) -> str:
    year, number, _ = map(int, month.split("-"))
    return f"{month[:8]}{calendar.monthrange(year, number)[1]:02d}"


def snapshot(spark: SparkSession, sf_dir: str, month: str = NEW) -> DataFrame:
    return market(spark, sf_dir, month)


SNAP = """snap AS (
  SELECT *, insurer || '|' || product || '|' || band AS key, lower(replace(insurer, '#', '-')) || '__' || lower(product) AS stem, cents / 100.0::DOUBLE AS price
  FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_brand AS insurer, p_type AS product, l_returnflag || l_linestatus AS band,
               CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) AS cents, 1.0::DOUBLE + 15.0::DOUBLE * l_discount AS note, 3.5::DOUBLE + 10.0::DOUBLE * l_tax AS bewertung,
               row_number() OVER (PARTITION BY date_trunc('month', l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS position
        FROM lineitem JOIN part ON p_partkey = l_partkey))"""
NOW, BEFORE = f"now AS (SELECT * FROM snap WHERE date = DATE '{NEW}')", f"before AS (SELECT * FROM snap WHERE date = DATE '{OLD}')"
CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({{0}}), '{s}')" for s in ss) + f" THEN '{k}'" for k, ss in TAXONOMY) + " END"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, ordinal, item, category: the parts' names as benefits of their tariff."""
    parts = table(spark, sf_dir, "part")
    return parts.select(stem(F.col("p_brand"), F.col("p_type")).alias("stem"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("item"), classify(F.col("p_name"), TAXONOMY).alias("category"))


ITEMS = f"items AS (SELECT lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem, p_partkey AS ordinal, p_name AS item, {CATEGORY.format('p_name')} AS category FROM part)"


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, module, level of the modules that a tariff includes."""
    parts = table(spark, sf_dir, "part").filter("p_size <= 25")
    rank = F.max("p_size") % 3
    level = F.when(rank == 0, "Basis").when(rank == 1, "Komfort").otherwise("Premium")
    key = F.concat(F.lit("m"), (F.col("p_size") % 8).cast("string"))
    return parts.groupBy(stem(F.col("p_brand"), F.col("p_type")).alias("stem"), key.alias("module")).agg(level.alias("level"))


MODULE_ROWS = """mods AS (SELECT lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem, 'm' || (p_size % 8) AS module,
  CASE max(p_size) % 3 WHEN 0 THEN 'Basis' WHEN 1 THEN 'Komfort' ELSE 'Premium' END AS level FROM part WHERE p_size <= 25 GROUP BY ALL)"""


def tariffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each tariff: modules, coverage fields, counts and the scores that rest on them."""
    parts = table(spark, sf_dir, "part")
    named = parts.withColumn("stem", stem(F.col("p_brand"), F.col("p_type")))
    top, n = F.max("p_size") % 4, F.count(F.lit(1))
    base = named.groupBy("stem", F.col("p_brand").alias("insurer"), F.col("p_type").alias("product")).agg(
        F.when(top == 0, "unbegrenzt").when(top == 1, "1.000.000 EUR").when(top == 2, "").alias("sum_insured"),
        F.when(n % 5 != 0, F.min("p_size") % 6).alias("wait_months"),
        F.when(n % 4 == 0, "weltweit").when(n % 4 == 1, "Europa").when(n % 4 == 2, "Deutschland").alias("scope"),
        F.concat(F.lit("h"), (F.max("p_size") % 7).cast("string"), F.lit("-"), (n % 5).cast("string")).alias("input_hash"),
    )
    included = F.map_from_entries(F.collect_list(F.struct("module", F.struct(F.lit(True).alias("included"), "level"))))
    mods = modules(spark, sf_dir).groupBy("stem").agg(included.alias("modules"))
    cats = items(spark, sf_dir).groupBy("stem").agg(F.countDistinct("category").alias("n_categories"))
    joined = base.join(mods, "stem", "left").join(cats, "stem", "left")
    none = F.create_map().cast("map<string,struct<included:boolean,level:string>>")
    full = joined.withColumns({"modules": F.coalesce("modules", none), "n_categories": F.coalesce("n_categories", F.lit(0)).cast("long")})
    return full.withColumns({
        "n_modules": F.size("modules").cast("long"),
        "leistung_cov": F.col("n_categories") / F.lit(float(len(TAXONOMY))),
        "module_breadth": F.size("modules") / F.lit(float(len(MODULES))),
        "coverage_gen": generosity(F.col("sum_insured"), F.col("wait_months"), F.col("scope")),
    })


TARIFFS = f"""{ITEMS}, {MODULE_ROWS}, base AS (
  SELECT lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem, p_brand AS insurer, p_type AS product,
         CASE max(p_size) % 4 WHEN 0 THEN 'unbegrenzt' WHEN 1 THEN '1.000.000 EUR' WHEN 2 THEN '' END AS sum_insured,
         CASE WHEN count(*) % 5 <> 0 THEN min(p_size) % 6 END AS wait_months,
         CASE count(*) % 4 WHEN 0 THEN 'weltweit' WHEN 1 THEN 'Europa' WHEN 2 THEN 'Deutschland' END AS scope,
         'h' || (max(p_size) % 7) || '-' || (count(*) % 5) AS input_hash
  FROM part GROUP BY ALL),
tariffs AS (
  SELECT base.*, coalesce(c.n, 0)::BIGINT AS n_categories, coalesce(m.n, 0)::BIGINT AS n_modules,
         coalesce(c.n, 0) / {float(len(TAXONOMY))}::DOUBLE AS leistung_cov, coalesce(m.n, 0) / 8.0::DOUBLE AS module_breadth,
         (CASE WHEN sum_insured LIKE '%unbegrenzt%' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
          + CASE WHEN wait_months IS NULL THEN 0.5::DOUBLE WHEN wait_months <= 0 THEN 1.0::DOUBLE WHEN wait_months <= 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
          + CASE coalesce(scope, '') WHEN '' THEN 0.5::DOUBLE WHEN 'weltweit' THEN 1.0::DOUBLE WHEN 'Europa' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END) / 3.0::DOUBLE AS coverage_gen
  FROM base LEFT JOIN (SELECT stem, count(DISTINCT category) AS n FROM items GROUP BY stem) c USING (stem)
  LEFT JOIN (SELECT stem, count(*) AS n FROM mods GROUP BY stem) m USING (stem))"""
NOTE_SCORE = "coalesce(least(greatest((2.5::DOUBLE - note) / 1.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE)"
RATING_SCORE = "coalesce(least(greatest(bewertung - 3.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 0.5::DOUBLE)"
