"""Documents on their way in, and what runs did with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake, reports
from ..session import work_folder
from .registry import query
from .views import ITEMS, MODULE_ROWS, REFERENCE, TARIFFS, items, modules, table, tariffs

_PREFIXES = [("avb", "avb"), ("pib", "produktinfoblatt")]
_KNOWN = {"brand#1": "one", "bolt": "bolts"}
_FILES = """f AS (SELECT p_partkey, p_size, string_split(p_brand || ' ' || p_name, ' ') AS tok, CASE WHEN p_brand = 'Brand#1' THEN 'brand#1' WHEN list_contains(string_split(p_name, ' '), 'bolt') THEN 'bolt' ELSE lower(p_brand) END AS key FROM part),
g AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'avb' WHEN 1 THEN 'produktinfoblatt' END AS doctype, CASE key WHEN 'brand#1' THEN 'one' WHEN 'bolt' THEN 'bolts' ELSE replace(key, '#', '-') END AS insurer,
  trim(regexp_replace(lower(array_to_string([x FOR x IN tok IF lower(x) <> key], '-')), '[^a-z0-9]+', '-', 'g'), '-') AS tariff,
  array_to_string(list_concat(CASE WHEN p_size % 3 = 2 THEN ['unknown document type'] ELSE [] END, CASE WHEN key IN ('brand#1', 'bolt') THEN [] ELSE ['insurer guessed'] END), '; ') AS warnings FROM f)"""


def _names(spark, sf):
    """Names with prefixes in both cases, blanks and underscores, a legal form where no prefix stands."""
    begins = F.when(F.col("p_size") % 3 == 0, "AVB_").when(F.col("p_size") % 3 == 1, "pib ").otherwise("GmbH__")
    return table(spark, sf, "part").select("p_partkey", F.concat(begins, "p_brand", F.lit(" "), "p_name", F.lit(".pdf")).alias("file"))


def _identity():
    return intake.file_identity(F.col("file"), _PREFIXES, _KNOWN, ["gmbh", "ag"]).alias("f")


def _files(spark, sf):
    return _names(spark, sf).select("p_partkey", _identity()).select("p_partkey", "f.*")


@query(f"WITH {_FILES} SELECT p_partkey, doctype, insurer, tariff, insurer || '__' || tariff AS stem, warnings FROM g")
def file_identities(spark, sf):
    return _files(spark, sf).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"WITH {_FILES} SELECT DISTINCT insurer || '__' || tariff AS stem FROM g WHERE insurer <> 'bolts'")
def orphan_stems(spark, sf):
    """Each name is read once, however many files bear it; put down, as filters on what it says would read it again for every file."""
    at = work_folder(spark)
    _names(spark, sf).select("file").distinct().select(_identity()).select("f.insurer", "f.stem").write.parquet(at)
    found = spark.read.parquet(at)
    return intake.orphans(found, found.filter("insurer = 'bolts'"))


@query("""WITH l AS (SELECT o_custkey AS bundle, o_orderkey AS ordinal, CASE o_orderkey % 7 WHEN 0 THEN 'k' END AS kind, o_orderkey % 5 AS w FROM orders),
d AS (SELECT bundle, ordinal, CASE WHEN kind = 'k' THEN 'antrag' WHEN w IN (1, 2) THEN 'avb' WHEN w = 3 THEN 'produktinfoblatt' WHEN w = 4 THEN 'weitere_unterlagen' END AS d FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY bundle, d ORDER BY ordinal) AS n FROM d WHERE d IS NOT NULL), s AS (SELECT bundle, ordinal, CASE WHEN d = 'avb' AND n > 1 THEN 'avb_besondere' ELSE d END AS doctype FROM n)
SELECT bundle, min(ordinal) AS ordinal, doctype FROM s GROUP BY bundle, doctype""")
def link_doctypes(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ["Erstinformation AVB", "Allgemeine Versicherungsbedingungen", "AVB 2024", "Ein Informationsblatt", "Antrag"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("ordinal"), text.alias("text"), F.lit("https://x/file/1").alias("url"), F.when(F.col("o_orderkey") % 7 == 0, "k").alias("kind"))
    return intake.link_doctypes(links, {"k": "antrag"}).select("bundle", "ordinal", "doctype")


@query("""WITH n AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, p_brand, p_type || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.pdf' AS target FROM n""")
def document_targets(spark, sf):
    docs = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return intake.targets(docs, ["p_brand"], F.concat(F.lit("../x/"), "p_type", F.lit(".PDF")), ["p_partkey"]).drop("p_type")


@query(f"""WITH {TARIFFS} SELECT stem, sha256('v1|model=m|filter=trim|' || CASE WHEN n_modules > 2 THEN 'repeat=3|' ELSE '' END || 'avb:' || input_hash || '|pib:x') AS signature FROM tariffs""")
def input_signatures(spark, sf):
    docs = F.array(*(F.struct(F.lit(t).alias("doctype"), h.alias("content_sha256")) for t, h in (("avb", F.col("input_hash")), ("pib", F.lit("x")))))
    return tariffs(spark, sf).select("stem", intake.signature(docs, "v1", F.lit("m"), F.lit("trim"), F.when(F.col("n_modules") > 2, 3).otherwise(1)).alias("signature"))


@query(f"""WITH {TARIFFS}, r AS (SELECT stem, input_hash AS signature, n_modules % 2 = 0 AS echo FROM tariffs) SELECT signature, min(stem) AS seed FROM r WHERE NOT echo GROUP BY signature""")
def shared_seeds(spark, sf):
    """Half of the records echo their stem and seed nothing."""
    named = F.when(F.col("n_modules") % 2 == 0, F.col("product")).otherwise(F.concat(F.lit("Tarif "), "product"))
    return intake.seeds(tariffs(spark, sf).select("stem", "insurer", named.alias("tariff"), F.col("input_hash").alias("signature")))


@query("SELECT p_partkey, [p_size % 7, 7 + p_size]::VARCHAR AS taken, 'x' || p_size AS ignored FROM part")
def position_lists(spark, sf):
    n = F.col("p_size").cast("string")
    spec = F.concat((F.col("p_size") + 7).cast("string"), F.lit(", x"), n, F.lit(",,"), (F.col("p_size") % 7).cast("string"), F.lit(" , 0"), (F.col("p_size") % 7).cast("string"))
    read = table(spark, sf, "part").select("p_partkey", intake.positions(spec).alias("p"))
    return read.select("p_partkey", F.concat(F.lit("["), F.array_join("p.taken", ", "), F.lit("]")).alias("taken"), F.array_join("p.ignored", ";").alias("ignored"))


@query("SELECT " + ", ".join(f"count(*) FILTER (event_type = '{o}') AS \"{o}\"" for o in ("view", "click", "none")) + ", count(*) AS total FROM events")
def tallies(spark, sf):
    return reports.tally(table(spark, sf, "events"), "event_type", ["view", "click", "none"])


@query(f"WITH {TARIFFS} SELECT (SELECT count(*) FROM tariffs WHERE scope IS NULL) AS repairs, (SELECT count(*) FROM tariffs) AS records, 0::BIGINT AS failures, (SELECT count(*) FROM events) AS calls")
def run_entry(spark, sf):
    t = tariffs(spark, sf)
    return reports.run_entry({"repairs": t.filter("scope IS NULL"), "records": t, "failures": t.filter("stem IS NULL"), "calls": table(spark, sf, "events")})


@query("""WITH d AS (SELECT p_brand AS stem, p_size % 4 AS s, p_partkey FROM part), c AS (SELECT stem, count(*) FILTER (s = 0) AS m, count(*) FILTER (s = 2) AS a, count(*) FILTER (s = 3) AS r,
list_sort(list(DISTINCT 'f' || (p_partkey % 6)) FILTER (s = 1))[1:4] AS f FROM d GROUP BY stem)
SELECT stem, concat_ws('; ', CASE WHEN m > 0 THEN m || ' Modul(e)' END, CASE WHEN len(f) > 0 THEN 'Coverage: ' || array_to_string(f, ', ') END, CASE WHEN a + r > 0 THEN 'Leistungen +' || a || '/−' || r END) AS line FROM c""")
def difference_lines(spark, sf):
    part = F.col("p_size") % 4
    section = F.when(part == 0, "modules").when(part == 1, "coverage").otherwise("leistungen")
    name = F.when(part == 1, F.concat(F.lit("f"), (F.col("p_partkey") % 6).cast("string"))).when(part == 2, "added").otherwise("removed")
    return reports.difference_lines(table(spark, sf, "part").select(F.col("p_brand").alias("stem"), section.alias("section"), name.alias("name")))


@query(f"WITH {ITEMS}, {MODULE_ROWS} SELECT stem FROM items UNION SELECT stem FROM mods")
def tracked_keys(spark, sf):
    return reports.tracked_keys(items(spark, sf), modules(spark, sf), spark.createDataFrame([("_index",)], "stem string"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'label ' || n_nationkey ELSE n_name END AS label, CASE WHEN n_nationkey % 4 = 0 THEN 'beta' ELSE '' END AS status, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_nationkey <> 3) AS n FROM nation WHERE n_nationkey % 5 <> 0")
def namespaces(spark, sf):
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    status = F.when(k % 5 == 0, "disabled").when(k % 4 == 0, "beta")
    registry = n.select(F.col("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("label "), k.cast("string"))).alias("label"), status.alias("status"))
    records = table(spark, sf, "customer").filter("c_nationkey <> 3").join(n, F.col("c_nationkey") == k).select(F.col("n_name").alias("namespace"))
    return reports.namespaces(registry, records)


def _compared(spark, sf):
    """Analysed tariffs, and a set to compare of which some are not analysed."""
    t = tariffs(spark, sf)
    waiting = t.filter("n_modules = 1").select(F.concat("stem", F.lit("-new")).alias("stem"))
    return t, t.filter("n_modules % 2 = 0").select("stem").unionByName(waiting)


@query(f"WITH {TARIFFS} SELECT stem, stem = '{REFERENCE}' AS is_reference, n_modules % 2 = 0 AS included FROM tariffs")
def compare_pool(spark, sf):
    return reports.compare_pool(*_compared(spark, sf), REFERENCE)


@query(f"WITH {TARIFFS} SELECT stem FROM tariffs WHERE n_modules > 2 UNION SELECT stem || '-new' FROM tariffs WHERE n_modules = 1")
def compare_set(spark, sf):
    analysed, before = _compared(spark, sf)
    return reports.compare_set(analysed.filter("n_modules > 2"), before, analysed)


@query("SELECT p_partkey, p_brand || ' / ' || p_type AS tariff, 'avb+pib' AS variant, 'trim' AS filter, 'm' || p_size AS model, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::INT AS run FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 9 = 0")
def run_names(spark, sf):
    """One in nine has too few parts."""
    n = F.col("p_size").cast("string")
    model = F.concat(F.lit("m"), n, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("__r"), n)).otherwise(""))
    name = F.when(F.col("p_partkey") % 9 == 0, "a~b~c~d").otherwise(F.concat_ws("~", "p_brand", "p_type", F.lit("avb+pib"), F.lit("trim"), model))
    return table(spark, sf, "part").select("p_partkey", reports.run_name(name).alias("r")).select("p_partkey", "r.*")


@query(f"WITH {ITEMS} SELECT stem, ordinal, CASE category WHEN 'motion' THEN 'Bewegung' ELSE category END AS label, category AS key FROM items WHERE category IS NOT NULL")
def labelled_items(spark, sf):
    labels = spark.createDataFrame([("motion", "Bewegung")], "key string, label string")
    return reports.labelled_keys(items(spark, sf).filter("category IS NOT NULL").select("stem", "ordinal", F.col("category").alias("key")), labels)
