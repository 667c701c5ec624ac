"""Which record a row means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators import dedup, resolve
from .registry import query
from .views import NOW, REFERENCE, REFERENCE_BAND, SNAP, snapshot, table, tariffs

_KNOWN = ("Brand#13", "Brand#21", "Brand#24", "Brand#25", "Brand#5", "Brand#6", "Brand#7")
_IN = ", ".join(f"'{b}'" for b in _KNOWN)
_MANIFEST = f"manifest AS (SELECT DISTINCT p_brand AS insurer, p_type AS product, lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem FROM part WHERE p_brand IN ({_IN}))"
_NAMES = "names AS (SELECT DISTINCT p_brand AS insurer, p_type AS product, p_brand || '/' || p_type AS row_id FROM part)"


def _names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("insurer"), F.col("p_type").alias("product")).distinct().withColumn("row_id", F.concat_ws("/", "insurer", "product"))


def _manifest(spark, sf):
    known = tariffs(spark, sf).filter(F.col("insurer").isin(*_KNOWN))
    return known.select("insurer", "product", "stem", F.lit(1).alias("ordinal"))


@query(f"""WITH {_MANIFEST}, {_NAMES}, exact AS (SELECT row_id, stem FROM names JOIN manifest USING (insurer, product)),
loose AS (SELECT n.row_id, min(m.stem) AS stem FROM names n JOIN manifest m ON m.product = n.product AND (contains(lower(m.insurer), lower(n.insurer)) OR contains(lower(n.insurer), lower(m.insurer)))
  WHERE n.row_id NOT IN (SELECT row_id FROM exact) GROUP BY n.row_id HAVING count(*) = 1)
SELECT row_id, coalesce(e.stem, l.stem) AS stem, CASE WHEN e.stem IS NOT NULL THEN 'exact' WHEN l.stem IS NOT NULL THEN 'loose' ELSE 'none' END AS tier
FROM names LEFT JOIN exact e USING (row_id) LEFT JOIN loose l USING (row_id)""")
def resolve_stem(spark, sf):
    return resolve.resolve(_names(spark, sf), _manifest(spark, sf))


_FAVOURITES = "favourites AS (SELECT p_brand AS insurer, p_type AS product, CASE WHEN count(*) % 2 = 0 THEN 'AF' ELSE 'none' END AS band FROM part WHERE p_size = 7 GROUP BY ALL)"


def _favourites(spark, sf):
    few = table(spark, sf, "part").filter("p_size = 7").groupBy(F.col("p_brand").alias("insurer"), F.col("p_type").alias("product"))
    return few.agg(F.when(F.count(F.lit(1)) % 2 == 0, "AF").otherwise("none").alias("band"))


@query(f"""WITH {SNAP}, {NOW}, {_FAVOURITES} SELECT insurer, product, band, found_band, price, position FROM (
  SELECT f.*, n.band AS found_band, n.price, n.position, row_number() OVER (PARTITION BY insurer, product, f.band ORDER BY CASE WHEN n.band = f.band THEN 0 ELSE 1 END, n.price NULLS LAST, n.position NULLS LAST) AS r
  FROM favourites f LEFT JOIN (SELECT insurer, product, band, price, position FROM now) n USING (insurer, product)) WHERE r = 1""")
def match_favorite(spark, sf):
    return resolve.match_favourites(_favourites(spark, sf), snapshot(spark, sf)).select("insurer", "product", "band", "found_band", "price", "position")


@query(f"""WITH {SNAP}, {NOW}, ref AS (SELECT price, band FROM now WHERE stem = '{REFERENCE}' ORDER BY CASE WHEN band = '{REFERENCE_BAND}' THEN 0 ELSE 1 END, price, position LIMIT 1)
SELECT now.position, now.key, now.price, CASE WHEN abs(now.price - ref.price) < 0.005 THEN 0.0::DOUBLE ELSE now.price - ref.price END AS delta, now.band <> ref.band AS approximate FROM now LEFT JOIN ref ON true""")
def reference_delta(spark, sf):
    return resolve.against_reference(snapshot(spark, sf), F.lit(REFERENCE), F.lit(REFERENCE_BAND)).select("position", "key", "price", "delta", "approximate")


@query("""WITH t AS (SELECT p_brand AS insurer, p_type AS product, lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem, bool_or(p_brand IN ('Brand#1', 'Brand#2') OR p_size = 50) AS analysed FROM part GROUP BY ALL)
SELECT a.stem, min(b.stem) AS equivalent FROM t a JOIN t b ON b.analysed AND a.product = b.product AND a.insurer <> b.insurer GROUP BY a.stem HAVING count(*) = 1""")
def equivalent_product(spark, sf):
    def tariffs_of(parts):
        rows = parts.select(F.col("p_brand").alias("insurer"), F.col("p_type").alias("product")).distinct()
        return rows.withColumn("stem", F.concat_ws("__", slug(F.col("insurer")), slug(F.col("product"))))

    every = table(spark, sf, "part")
    analysed = every.filter("p_brand IN ('Brand#1', 'Brand#2') OR p_size = 50")
    return resolve.only_equivalent(tariffs_of(every), analysed=tariffs_of(analysed))


_RATINGS = """ratings AS (SELECT * FROM (VALUES ('tariff', 'brand-13__promo', 'a', 'good'), ('tariff', 'brand-1__small', 'b', 'fair'), ('insurer', '13', 'c', 'top'), ('insurer', 'brand', 'd', 'any'), ('insurer', '1', 'e', 'whole')) AS r(scope, subject, source, badge)),
aliases AS (SELECT * FROM (VALUES ('brand-2__small', 'brand-1__small'), ('brand-13__promo', 'brand-1__small')) AS a(stem, alias_of))"""


@query(f"""WITH {_RATINGS}, t AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem, p_brand AS insurer FROM part),
own AS (SELECT stem, source, badge, scope, NULL::VARCHAR AS via FROM t JOIN ratings ON stem = subject AND scope = 'tariff')
SELECT * FROM own UNION ALL
SELECT t.stem, source, badge, scope, alias_of FROM t JOIN aliases a ON a.stem = t.stem JOIN ratings ON subject = alias_of AND scope = 'tariff' WHERE t.stem NOT IN (SELECT stem FROM own)
UNION ALL SELECT stem, source, badge, scope, NULL FROM t JOIN ratings ON scope = 'insurer' AND list_contains(list_distinct(string_split(regexp_replace(lower(insurer || ' ' || stem), '[^a-z0-9]+', ' ', 'g'), ' ')), subject)""")
def ratings_whole_word(spark, sf):
    given = [("tariff", "brand-13__promo", "a", "good"), ("tariff", "brand-1__small", "b", "fair"), ("insurer", "13", "c", "top"), ("insurer", "brand", "d", "any"), ("insurer", "1", "e", "whole")]
    ratings = spark.createDataFrame(given, "scope string, subject string, source string, badge string")
    aliases = spark.createDataFrame([("brand-2__small", "brand-1__small"), ("brand-13__promo", "brand-1__small")], "stem string, alias_of string")
    return resolve.ratings_for(tariffs(spark, sf).select("stem", "insurer"), ratings, aliases)


@query(f"WITH {SNAP}, {NOW} SELECT insurer, product, min(position) AS position FROM now GROUP BY ALL")
def collapse_product(spark, sf):
    return resolve.collapse_products(snapshot(spark, sf)).select("insurer", "product", "position")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS unique_key FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_stem_suffix(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", slug(F.col("p_name")).alias("base"))
    return dedup.with_suffix(named, "base", F.col("p_partkey")).select("p_partkey", "unique_key")


_PAIRS = "pairs AS (SELECT * FROM (VALUES ('brand#13', 'PROMO'), ('Brand#2', 'small'), ('Brand#99', 'SMALL')) AS p(insurer, product))"


def _pairs(spark):
    return spark.createDataFrame([("brand#13", "PROMO"), ("Brand#2", "small"), ("Brand#99", "SMALL")], "insurer string, product string")


@query(f"WITH {SNAP}, {NOW}, {_PAIRS} SELECT now.insurer, now.product, min(position) AS position FROM now JOIN pairs p ON lower(now.insurer) = lower(p.insurer) AND lower(now.product) = lower(p.product) GROUP BY ALL")
def select_pairs(spark, sf):
    return resolve.select_pairs(snapshot(spark, sf), _pairs(spark))[0].select("insurer", "product", "position")


@query(f"WITH {SNAP}, {NOW}, {_PAIRS} SELECT insurer, product FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM now WHERE lower(now.insurer) = lower(p.insurer) AND lower(now.product) = lower(p.product))")
def select_pairs_missing(spark, sf):
    return resolve.select_pairs(snapshot(spark, sf), _pairs(spark))[1].select("insurer", "product")


@query(f"WITH {SNAP}, {NOW} SELECT position, key, price FROM now WHERE contains(lower(insurer), 'd#2') OR contains(lower(product), 'promo')")
def market_filter(spark, sf):
    return resolve.sort_market(resolve.loose_filter(snapshot(spark, sf), "d#2"), "price", False).select("position", "key", "price").unionByName(
        resolve.loose_filter(snapshot(spark, sf), "PROMO").filter("NOT contains(lower(insurer), 'd#2')").select("position", "key", "price")
    )


@query("""WITH t AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem, p_brand AS insurer, p_type AS product FROM part WHERE p_size < 40),
r AS (SELECT p_partkey AS row_id, p_brand AS insurer, p_type AS product, CASE WHEN p_partkey % 2 = 0 THEN 'brand-13__promo' END AS stem FROM part)
SELECT row_id, coalesce(a.stem, b.stem) AS stem FROM r LEFT JOIN t a ON a.stem = r.stem LEFT JOIN t b ON b.insurer = r.insurer AND b.product = r.product""")
def lookup_by_stem_or_name(spark, sf):
    parts = table(spark, sf, "part")
    known = parts.filter("p_size < 40").select(F.col("p_brand").alias("insurer"), F.col("p_type").alias("product")).distinct()
    known = known.withColumn("stem", F.concat_ws("__", slug(F.col("insurer")), slug(F.col("product"))))
    rows = parts.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("insurer"), F.col("p_type").alias("product"), F.when(F.col("p_partkey") % 2 == 0, "brand-13__promo").alias("stem"))
    return resolve.lookup(rows, known)


@query("""WITH asked AS (SELECT * FROM (VALUES ('brand-13__prom'), ('brnd-13__promo'), ('xyz__q')) AS a(asked)),
t AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) || '__' || lower(p_type) AS stem FROM part),
near AS (SELECT asked, stem, row_number() OVER (PARTITION BY asked ORDER BY stem) AS place FROM asked JOIN t ON split_part(asked, '__', 1) = split_part(stem, '__', 1)),
far AS (SELECT asked, stem, row_number() OVER (PARTITION BY asked ORDER BY s DESC, stem) AS place FROM (SELECT asked, stem, 1 - levenshtein(asked, stem) / greatest(length(asked), length(stem)) AS s FROM asked CROSS JOIN t WHERE asked NOT IN (SELECT asked FROM near)) WHERE s >= 0.4)
SELECT * FROM near WHERE place <= 5 UNION ALL SELECT * FROM far WHERE place <= 3""")
def key_suggestions(spark, sf):
    asked = spark.createDataFrame([("brand-13__prom",), ("brnd-13__promo",), ("xyz__q",)], "asked string")
    return resolve.suggestions(asked, tariffs(spark, sf).select("stem"))


