"""Taxonomy, matrices, rules over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..functions.text import short_scope, short_sum, short_wait
from ..operators import quality, taxonomy
from .registry import query
from .views import ITEMS, MODULE_ROWS, TARIFFS, TAXONOMY, items, modules, table, tariffs

_COLUMNS = ["brand-1__promo", "brand-2__promo", "brand-13__promo", "brand-21__small"]
_IN = ", ".join(f"'{c}'" for c in _COLUMNS)


def _pivot(source: str, row: str, value: str) -> str:
    cells = ", ".join(f"coalesce(max(CASE WHEN stem = '{c}' THEN {value} END), '–') AS \"{c}\"" for c in _COLUMNS)
    return f"SELECT {row}, {cells} FROM {source} WHERE stem IN ({_IN}) GROUP BY {row}"


@query(f"WITH {ITEMS} SELECT stem, ordinal, item, category FROM items")
def classify_items(spark, sf):
    return items(spark, sf)


@query(f"WITH {ITEMS} SELECT stem, count(DISTINCT category) AS n_categories, count(*) FILTER (category IS NULL) AS n_unmatched FROM items GROUP BY stem")
def coverage_counts(spark, sf):
    return taxonomy.category_counts(items(spark, sf))


@query(f"WITH {ITEMS} SELECT count(category) AS matched, count(*) AS total, count(category) / count(*) AS ratio FROM items")
def mapping_ratio(spark, sf):
    return taxonomy.mapping_ratio(items(spark, sf))


#: A cue of partial cover behind some of the items, and words that are none behind others.
_CUES = ["", " eingeschr. auf Europa", " bis zu 500 EUR", " außer Haus", " nur einmal", " optional", " ausser Haus", " teilweise", " begrenzt"]
_CUED = "(SELECT stem, ordinal, item || [" + ", ".join(f"'{c}'" for c in _CUES) + "][ordinal % 9 + 1] AS item, category FROM items) items"
_CELL = "CASE WHEN contains(item, 'nur ') OR contains(item, 'eingeschr') OR contains(item, 'außer') OR contains(item, 'ausser') OR contains(item, 'begrenzt') OR contains(item, 'teilweise') THEN '~' ELSE '✓' END"


@query(f"WITH {ITEMS}, first AS (SELECT stem, category, min_by(item, ordinal) AS item FROM {_CUED} WHERE category IS NOT NULL GROUP BY ALL) {_pivot('first', 'category', _CELL)}")
def category_matrix(spark, sf):
    cue = F.element_at(F.array(*map(F.lit, _CUES)), (F.col("ordinal") % 9 + 1).cast("int"))
    first = taxonomy.first_items(items(spark, sf).filter(F.col("stem").isin(_COLUMNS)).withColumn("item", F.concat("item", cue)))
    cells = first.withColumn("cell", taxonomy.cell(F.col("item")))
    return taxonomy.matrix(cells, "category", "stem", "cell", _COLUMNS)


@query(f"WITH {ITEMS}, first AS (SELECT stem, category, min_by(item, ordinal) AS item FROM items WHERE category IS NOT NULL GROUP BY ALL) {_pivot('first', 'category', 'item')}")
def fulltext_matrix(spark, sf):
    first = taxonomy.first_items(items(spark, sf).filter(F.col("stem").isin(_COLUMNS)))
    return taxonomy.matrix(first, "category", "stem", "item", _COLUMNS)


@query(f"WITH {MODULE_ROWS} {_pivot('mods', 'module', 'level[1]')}")
def module_matrix(spark, sf):
    cells = modules(spark, sf).filter(F.col("stem").isin(_COLUMNS)).withColumn("cell", display.module_cell(F.lit(True), F.col("level")))
    return taxonomy.matrix(cells, "module", "stem", "cell", _COLUMNS)


@query(f"""WITH {TARIFFS}, attrs AS (
  SELECT stem, 'sum' AS attribute, CASE WHEN coalesce(sum_insured, '') = '' THEN 'k.A.' WHEN sum_insured = 'unbegrenzt' THEN 'unbegrenzt' ELSE '1 Mio.' END AS value FROM tariffs
  UNION ALL SELECT stem, 'wait', coalesce(wait_months || ' Mon.', 'k.A.') FROM tariffs UNION ALL SELECT stem, 'scope', coalesce(scope, 'k.A.') FROM tariffs) {_pivot('attrs', 'attribute', 'value')}""")
def coverage_matrix(spark, sf):
    few = tariffs(spark, sf).filter(F.col("stem").isin(_COLUMNS))
    short = few.select("stem", short_sum(F.col("sum_insured")).alias("sum"), short_wait(F.col("wait_months")).alias("wait"), short_scope(F.col("scope")).alias("scope"))
    return taxonomy.matrix(taxonomy.attribute_rows(short, "stem", ["sum", "wait", "scope"]), "attribute", "stem", "value", _COLUMNS)


@query(f"WITH {ITEMS} SELECT stem, string_agg(item, '; ' ORDER BY ordinal) AS items FROM items WHERE category IS NULL GROUP BY stem")
def unmatched_bucket(spark, sf):
    return taxonomy.unmatched_bucket(items(spark, sf)).select("stem", F.array_join("items", "; ").alias("items"))


@query("SELECT kind, cat_ord, key, count(*) AS n FROM (VALUES " + ", ".join(f"('benefit', {i}, '{k}')" for i, (k, ss) in enumerate(TAXONOMY) for _ in ss) + ") AS t(kind, cat_ord, key) GROUP BY ALL")
def taxonomy_order(spark, sf):
    return taxonomy.taxonomy_frame(spark, TAXONOMY, "benefit").groupBy("kind", "cat_ord", "key").agg(F.count(F.lit(1)).alias("n"))


_RULES = [("sum", "nonnull", ""), ("sum", "contains_all_digits", "1000000"), ("scope", "in", "weltweit|Europa"), ("scope", "isnull", ""), ("scope", "eq", "Europa"), ("sum", "contains", "UNBE")]
_VALUES = """vals AS (SELECT stem, 'sum' AS path, sum_insured AS value FROM tariffs UNION ALL SELECT stem, 'scope', scope FROM tariffs)"""


def _values(spark, sf):
    return taxonomy.attribute_rows(tariffs(spark, sf).select("stem", F.col("sum_insured").alias("sum"), "scope"), "stem", ["sum", "scope"]).withColumnRenamed("attribute", "path")


def _rules(spark, sf):
    rule = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).alias("check"), F.lit(e).alias("expected")) for p, c, e in _RULES)))
    return tariffs(spark, sf).select("stem", rule.alias("r")).select("stem", "r.*")


_CHECKED = f"""WITH {TARIFFS}, {_VALUES}, rules AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{c}', '{e}')" for p, c, e in _RULES)}) AS r(path, "check", expected)),
checked AS (SELECT stem, r.path, "check", CASE "check" WHEN 'nonnull' THEN coalesce(value, '') <> '' WHEN 'isnull' THEN value IS NULL WHEN 'eq' THEN value IS NOT DISTINCT FROM expected
  WHEN 'contains' THEN coalesce(contains(lower(value), lower(expected)), false) WHEN 'contains_all_digits' THEN coalesce(list_contains(regexp_extract_all(replace(value, '.', ''), '[0-9]+'), expected), false)
  ELSE coalesce(list_contains(string_split(expected, '|'), value), false) END AS ok FROM vals JOIN rules r USING (path))"""


@query(f"{_CHECKED} SELECT * FROM checked")
def invariants(spark, sf):
    return quality.invariants(_values(spark, sf), _rules(spark, sf))


@query(f"{_CHECKED} SELECT count(*) FILTER (ok) AS passed, count(*) AS total FROM checked")
def golden_status(spark, sf):
    return quality.passed(quality.invariants(_values(spark, sf), _rules(spark, sf))).select("passed", "total")


@query(f"""WITH {TARIFFS}, {_VALUES} SELECT stem, path, CASE WHEN path <> 'scope' OR stem NOT LIKE 'brand-1%' THEN value END AS value FROM vals""")
def pin_repairs(spark, sf):
    pins = tariffs(spark, sf).filter("stem LIKE 'brand-1%'").select("stem", F.lit("scope").alias("path"), F.lit("isnull").alias("check"))
    return quality.pin_repairs(_values(spark, sf), pins)[0].select("stem", "path", "value")


@query(f"WITH {TARIFFS}, {_VALUES} SELECT stem, path, value FROM vals WHERE path = 'scope' AND stem LIKE 'brand-1%' AND value IS NOT NULL")
def pin_repair_log(spark, sf):
    pins = tariffs(spark, sf).filter("stem LIKE 'brand-1%'").select("stem", F.lit("scope").alias("path"), F.lit("isnull").alias("check"))
    return quality.pin_repairs(_values(spark, sf), pins)[1]


@query("""WITH e AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS wanted,
  string_split(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) || ' ' || lower(p_type) ELSE p_brand END, ' ') AS have0 FROM part),
f AS (SELECT p_partkey, wanted, [x FOR x IN string_split(regexp_replace(lower(array_to_string(have0, ' ')), '[^a-z0-9]+', ' ', 'g'), ' ') IF length(x) >= 2] AS have FROM e)
SELECT p_partkey::VARCHAR AS stem, len([x FOR x IN wanted IF list_contains(have, x)]) AS hits, len(wanted) AS wanted, len([x FOR x IN wanted IF list_contains(have, x)]) / len(wanted) AS share,
  len(have) = 0 OR len([x FOR x IN wanted IF list_contains(have, x)]) / len(wanted) >= 0.5 AS ok FROM f""")
def attribution_share(spark, sf):
    files = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("_"), F.col("p_type"), F.lit(".pdf"))).otherwise(F.concat("p_brand", F.lit(".pdf")))
    entries = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("stem"), F.concat_ws(" ", "p_name", "p_type").alias("tariff"), F.array(files).alias("files"))
    return quality.attribution(entries)


@query("""WITH r AS (SELECT o_custkey::VARCHAR AS stem, o_orderpriority AS doctype, max(o_orderkey)::VARCHAR AS h FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY ALL),
c AS (SELECT o_custkey::VARCHAR AS stem, o_orderpriority AS doctype, max(o_orderkey)::VARCHAR AS h FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY ALL)
SELECT coalesce(a.stem, b.stem) AS stem, coalesce(a.doctype, b.doctype) AS doctype, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'dropped' ELSE 'changed' END AS state
FROM (SELECT * FROM r WHERE stem IN (SELECT stem FROM c)) a FULL JOIN (SELECT * FROM c WHERE stem IN (SELECT stem FROM r)) b ON a.stem = b.stem AND a.doctype = b.doctype WHERE a.h IS DISTINCT FROM b.h""")
def staleness(spark, sf):
    orders = table(spark, sf, "orders")
    of = lambda d: d.groupBy(F.col("o_custkey").cast("string").alias("stem"), F.col("o_orderpriority").alias("doctype")).agg(F.max("o_orderkey").cast("string").alias("content_sha256"))
    return quality.staleness(of(orders.filter("o_orderdate < DATE '1998-01-01'")), of(orders.filter("o_orderdate >= DATE '1996-01-01'")))


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) ORDER BY n DESC, f LIMIT 1")
def provenance_mode(spark, sf):
    return quality.dominant(table(spark, sf, "documents"), ["lang", "source"], "doc_id")


@query("SELECT 'no_premium' AS rule, count(*) AS n FROM orders WHERE o_totalprice IS NULL UNION ALL SELECT 'high_priority', count(*) FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'")
def market_sweep(spark, sf):
    hits = F.array_compact(F.array(F.when(F.col("o_totalprice").isNull(), "no_premium"), F.when(F.col("o_orderpriority") == "2-HIGH", "high_priority"), F.when(F.col("o_orderstatus") == "O", "open")))
    found = table(spark, sf, "orders").select(F.explode(hits).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    rules = spark.range(1).select(F.explode(F.array(F.lit("no_premium"), F.lit("high_priority"), F.lit("open"))).alias("rule"))
    return rules.join(found, "rule", "left").fillna(0, ["n"])


@query("SELECT * FROM (VALUES ('b', '3 to 12 keys'), ('b', 'keys in snake case'), ('b', '5 synonyms at least')) AS t(name, problem)")
def draft_problems(spark, sf):
    rows = [("a", ["x_a", "y_b", "z_c"], ["a", "b", "c"], list("vwxyz")), ("b", ["Bad"], ["a", "b", "c"], ["s"])]
    return quality.draft_problems(spark.createDataFrame(rows, "name string, keys array<string>, anchors array<string>, synonyms array<string>"))


