"""Offers, runs, reconciliation, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import merges
from .registry import query
from .views import ITEMS, MODULE_ROWS, TARIFFS, items, table, tariffs

_OFFERS = """offers AS (SELECT stem, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 10.0::DOUBLE ELSE 12.5::DOUBLE END AS month, CASE n % 5 WHEN 1 THEN NULL WHEN 2 THEN 150.0::DOUBLE WHEN 3 THEN 140.0::DOUBLE ELSE NULL END AS year,
  n % 7 <> 6 AS has, CASE WHEN n % 3 = 0 THEN 'm1' WHEN n % 3 = 1 THEN 'm9' END AS k, CASE WHEN n % 4 = 0 THEN '150' END AS ded FROM (SELECT stem, row_number() OVER (ORDER BY stem) AS n FROM tariffs)),
recs AS (SELECT t.stem, m.stem IS NOT NULL AS m1, CASE WHEN n_modules % 2 = 0 THEN '300' END AS ded, CASE WHEN n_modules = 8 THEN 9.0::DOUBLE END AS month FROM tariffs t LEFT JOIN (SELECT stem FROM mods WHERE module = 'm1') m USING (stem))"""


def _records(spark, sf):
    bare = F.transform_values("modules", lambda k, m: F.struct(m["included"].alias("included"), F.lit(None).cast("string").alias("level")))
    return tariffs(spark, sf).select(
        "stem", bare.alias("modules"), F.when(F.col("n_modules") == 8, 9.0).alias("premium_month"), F.lit(None).cast("double").alias("premium_year"), F.when(F.col("n_modules") % 2 == 0, "300").alias("deductible")
    )


def _offers(spark, sf):
    n = tariffs(spark, sf).select("stem", F.row_number().over(Window.orderBy("stem")).alias("n"))  # 150 tariffs
    key = F.when(F.col("n") % 3 == 0, "m1").when(F.col("n") % 3 == 1, "m9")
    return n.select(
        "stem", F.when(F.col("n") % 5 == 1, 10.0).when(F.col("n") % 5 != 0, 12.5).alias("premium_month"), F.when(F.col("n") % 5 == 2, 150.0).when(F.col("n") % 5 == 3, 140.0).alias("premium_year"),
        (F.col("n") % 7 != 6).alias("has_premium"), F.when(key.isNotNull(), F.create_map(key, F.lit("Premium"))).alias("levels"), F.when(F.col("n") % 4 == 0, "150").alias("deductible"),
    )


_V = """v AS (SELECT o.*, r.m1, r.ded AS rded, r.month AS rmonth, CASE WHEN has AND o.month IS NULL AND o.year IS NULL THEN 'empty premium' END AS v1,
  CASE WHEN has AND NOT (o.month IS NULL AND o.year IS NULL) AND r.month IS NOT NULL THEN 'premium already set' END AS v2, CASE WHEN k = 'm9' OR (k = 'm1' AND NOT m1) THEN 'module unknown ' || k END AS v3 FROM offers o JOIN recs r USING (stem)),
w AS (SELECT *, concat_ws(', ', v1, v2, v3) AS violations FROM v)"""
_OVERLAY = f"WITH {TARIFFS}, {_OFFERS}, {_V}"


@query(f"{_OVERLAY} SELECT stem, violations FROM w WHERE violations <> ''")
def overlay_violations(spark, sf):
    laid = merges.overlay(_records(spark, sf), _offers(spark, sf)).filter(F.size("violations") > 0)
    return laid.select("stem", F.array_join("violations", ", ").alias("violations"))


@query(f"""{_OVERLAY} SELECT stem, CASE WHEN violations = '' AND has THEN coalesce(month, year / 12) ELSE rmonth END AS premium_month, CASE WHEN violations = '' THEN coalesce(ded, rded) ELSE rded END AS deductible,
CASE WHEN violations = '' AND ded IS NOT NULL AND rded IS NOT NULL AND ded <> rded THEN rded END AS original_deductible, coalesce(violations = '' AND k = 'm1', false) AS level_set,
concat_ws(', ', CASE WHEN has AND abs(month * 12 - year) > 0.5 THEN 'premium mismatch' END, CASE WHEN ded IS NOT NULL AND rded IS NOT NULL AND ded <> rded THEN 'deductible superseded' END) AS notes FROM w""")
def overlay_merge(spark, sf):
    laid = merges.overlay(_records(spark, sf), _offers(spark, sf))
    level = F.coalesce(F.try_element_at("modules", F.lit("m1"))["level"] == "Premium", F.lit(False))
    return laid.select("stem", "premium_month", "deductible", "original_deductible", level.alias("level_set"), F.array_join("notes", ", ").alias("notes"))


@query(f"{_OVERLAY} SELECT stem, 'premium' AS path FROM w WHERE violations = '' AND has AND coalesce(month, year / 12) IS DISTINCT FROM rmonth")
def containment(spark, sf):
    """Paths that an overlay changed and its own list of fields does not cover when only the deductible is allowed."""
    records = _records(spark, sf)
    laid = merges.overlay(records, _offers(spark, sf))
    long = lambda d: d.select("stem", F.explode(F.array(F.struct(F.lit("premium").alias("path"), F.col("premium_month").cast("string").alias("value")), F.struct(F.lit("coverage.deductible").alias("path"), F.col("deductible").alias("value")))).alias("x")).select("stem", "x.*")
    changed = merges.leaf_differences(long(records), long(laid), ["stem"])
    return merges.uncovered(changed, F.array(F.lit("coverage"))).select("stem", "path")


_RUNS = f"""{ITEMS}, runs AS (SELECT stem, ordinal % 3 AS run, ordinal, CASE WHEN ordinal % 2 = 0 THEN upper(item) ELSE item END AS item FROM items)"""
_UNITED = """base AS (SELECT stem, run AS b FROM (SELECT stem, run, row_number() OVER (PARTITION BY stem ORDER BY sum(length(item)) DESC, run) AS r FROM runs GROUP BY stem, run) WHERE r = 1),
placed AS (SELECT stem, lower(item) AS k, item, CASE WHEN run = b THEN -1 ELSE run END AS ro, row_number() OVER (PARTITION BY stem, run ORDER BY ordinal) AS io FROM runs JOIN base USING (stem)),
firsts AS (SELECT stem, k, min((ro, io, item)) AS x FROM placed GROUP BY ALL)"""


def _runs(spark, sf):
    spelled = F.when(F.col("ordinal") % 2 == 0, F.upper("item")).otherwise(F.col("item"))
    rows = items(spark, sf).select("stem", (F.col("ordinal") % 3).alias("run"), "ordinal", spelled.alias("item"))
    grouped = rows.groupBy("stem", "run").agg(F.sum(F.length("item")).alias("size"), F.sort_array(F.collect_list(F.struct("ordinal", "item"))).alias("x"))
    return grouped.select("stem", "run", "size", F.transform("x", lambda x: x["item"]).alias("items"))


@query(f"WITH {_RUNS}, {_UNITED} SELECT f.stem, any_value(b) AS run, string_agg(x[3], '; ' ORDER BY x[1], x[2]) AS items FROM firsts f JOIN base USING (stem) GROUP BY f.stem")
def merge_runs_union(spark, sf):
    return merges.merge_runs(_runs(spark, sf)).select("stem", "run", F.array_join("items", "; ").alias("items"))


@query(f"""WITH {_RUNS}, {MODULE_ROWS}, a AS (SELECT stem, item, row_number() OVER (PARTITION BY stem ORDER BY ordinal) AS i FROM runs WHERE run = 1), b AS (SELECT stem, item, row_number() OVER (PARTITION BY stem ORDER BY ordinal) AS i FROM runs WHERE run = 0),
u AS (SELECT stem, lower(item) AS k, min((s, i, item)) AS x FROM (SELECT 0 AS s, * FROM a UNION ALL SELECT 1, * FROM b WHERE stem IN (SELECT stem FROM a)) GROUP BY ALL),
l AS (SELECT stem, string_agg(x[3], '; ' ORDER BY x[1], x[2]) AS items, count(*) AS n FROM u WHERE stem IN (SELECT stem FROM a) GROUP BY stem),
m AS (SELECT stem, count(*) AS n FROM mods GROUP BY stem), p AS (SELECT DISTINCT stem FROM b),
j AS (SELECT l.*, CASE WHEN p.stem IS NULL THEN 0 ELSE coalesce(m.n, 0) END AS mn, p.stem IS NOT NULL AND length(l.stem) % 2 = 0 AS cov, length(l.stem) % 3 = 0 AND p.stem IS NOT NULL AS named, length(l.stem) % 4 = 0 AND p.stem IS NOT NULL AS dated,
  (SELECT count(*) FROM a WHERE a.stem = l.stem) AS own FROM l LEFT JOIN m USING (stem) LEFT JOIN p USING (stem))
SELECT stem, items, greatest(mn, 4)::INT AS n_modules, CASE WHEN cov THEN 'weltweit' ELSE '' END AS scope, CASE WHEN named OR length(stem) % 3 <> 0 THEN 'I' END AS insurer, CASE WHEN dated THEN '2023' WHEN length(stem) % 4 <> 0 THEN '2024' ELSE '' END AS stand, 'kept' AS _model,
  concat_ws(', ', CASE WHEN mn > 4 THEN 'modules 4->' || mn END, CASE WHEN cov THEN 'coverage 1->2' END, CASE WHEN n <> own THEN 'leistungen ' || own || '->' || n END, CASE WHEN named THEN 'insurer<-prior' END, CASE WHEN dated THEN 'stand<-prior' END) AS changed
FROM j""")
def reconcile_merge(spark, sf):
    lists, size = _runs(spark, sf), F.length("stem")
    four = F.map_from_entries(F.array(*(F.struct(F.lit(f"m{i}"), F.struct(F.lit(True).alias("included"), F.lit("x").alias("level"))) for i in range(4))))
    cover = lambda scope: F.struct(F.lit("1").alias("sum"), F.lit(None).cast("int").alias("wait"), scope.alias("scope"))
    fresh = lists.filter("run = 1").select(
        "stem", F.col("items").alias("leistungen"), four.alias("modules"), cover(F.lit("")).alias("coverage"), F.when(size % 3 != 0, "I").alias("insurer"), F.lit("t").alias("tariff"),
        F.when(size % 4 != 0, "2024").otherwise("").alias("stand"), F.lit("kept").alias("_model"),
    )
    prior = lists.filter("run = 0").select("stem", F.col("items").alias("leistungen")).join(tariffs(spark, sf).select("stem", "modules"), "stem")
    prior = prior.withColumns({"coverage": cover(F.when(size % 2 == 0, "weltweit")), "insurer": F.lit("I"), "tariff": F.lit("t"), "stand": F.lit("2023"), "_model": F.lit("old")})
    out = merges.reconcile(prior, fresh, ["leistungen"])
    return out.select("stem", F.array_join("leistungen", "; ").alias("items"), F.size("modules").alias("n_modules"), "coverage.scope", "insurer", "stand", "_model", F.array_join("changed", ", ").alias("changed"))


@query("""WITH p AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), f AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate >= DATE '2000-01-01' GROUP BY 1)
SELECT f.k, f.v, CASE WHEN p.k IS NULL THEN 'added' ELSE 'updated' END AS action FROM f LEFT JOIN p USING (k) UNION ALL SELECT k, v, 'kept' FROM p WHERE k NOT IN (SELECT k FROM f)""")
def manifest_upsert(spark, sf):
    orders = table(spark, sf, "orders")
    of = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return merges.upsert(of(orders.filter("o_orderdate < DATE '1998-01-01'")), of(orders.filter("o_orderdate >= DATE '2000-01-01'")), ["k"])


@query("SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_nationkey <= 12 OR c_nationkey > 18 ORDER BY 1")
def insert_missing(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"), "c_nationkey")
    low, high = c.filter("c_nationkey <= 12").drop("c_nationkey"), c.filter("c_nationkey > 18 OR c_nationkey = 12").drop("c_nationkey")
    return merges.insert_missing(low, high, ["k"])


@query("SELECT c_custkey AS k FROM customer WHERE (c_nationkey < 10) <> (c_nationkey BETWEEN 5 AND 15)")
def toggle_favorite(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return merges.toggle(c.filter("c_nationkey < 10").select("k"), c.filter("c_nationkey BETWEEN 5 AND 15").select("k"), ["k"])


@query(f"""WITH {TARIFFS}, cache AS (SELECT stem, CASE WHEN n_modules = 5 THEN 'other' ELSE input_hash END AS h, n_modules % 4 AS r, n_modules = 3 AS c FROM tariffs WHERE n_modules <> 2), jobs AS (SELECT stem, input_hash AS h FROM tariffs),
tw AS (SELECT h, min(stem) AS twin FROM cache WHERE NOT c GROUP BY h), j AS (SELECT jobs.stem, tw.twin, coalesce(cache.c, false) OR coalesce(cache.h = jobs.h AND cache.r >= 1, false) AS cached FROM jobs LEFT JOIN cache USING (stem) LEFT JOIN tw ON tw.h = jobs.h)
SELECT stem, CASE WHEN cached THEN 'cached' WHEN coalesce(twin <> stem, false) THEN 'shared' ELSE 'extract' END AS outcome, CASE WHEN NOT cached AND twin <> stem THEN twin END AS source FROM j""")
def cache_classify(spark, sf):
    t = tariffs(spark, sf)
    digest = F.when(F.col("n_modules") == 5, "other").otherwise(F.col("input_hash"))
    cache = t.filter("n_modules <> 2").select("stem", digest.alias("input_hash"), (F.col("n_modules") % 4).alias("repeat"), (F.col("n_modules") == 3).alias("curated"))
    return merges.cache_classes(t.select("stem", "input_hash", F.lit(1).alias("repeat")), cache)
