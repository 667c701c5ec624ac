"""Sources and sinks: relations written to the shared folder in the data model's own formats, and read back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.scores import included_count
from ..functions.text import money
from ..operators import merges, quality
from ..session import work_folder
from ..sources import files, html, http, sinks
from ..streaming import append_on_change, keyed_state
from .registry import query
from .views import NEW, NOW, OLD, SNAP, TARIFFS, snapshot, table, tariffs


def _one_text(df, column, path):
    """One text file out of one row."""
    df.select(F.col(column).alias("value")).coalesce(1).write.text(path)


def _id_of(path, key):
    return F.regexp_extract(path, rf"{key}=([^/]+)/", 1)


@query(f"""WITH {TARIFFS} SELECT stem, insurer, CASE WHEN n_modules % 2 = 0 THEN 'E' ELSE product END AS tariff, n_modules % 2 = 0 AS enriched, n_modules AS n_included, wait_months::INT AS wait_months,
CASE WHEN scope = '' THEN NULL ELSE scope END AS scope FROM tariffs""")
def stored_records(spark, sf):
    """Pure records and, for some, enriched ones that stand for them; one file breaks and one is not a record."""
    at = work_folder(spark)
    cover = F.struct(F.col("sum_insured").alias("versicherungssumme"), F.col("wait_months").cast("int").alias("wartezeit_monate"), F.col("scope").alias("geltungsbereich"))
    rec = tariffs(spark, sf).select("stem", "insurer", F.col("product").alias("tariff"), "modules", cover.alias("coverage"), F.col("input_hash").alias("_input_hash"))
    sinks.json_by_key(rec, "stem", f"{at}/pure")
    sinks.json_by_key(rec.filter(included_count(F.col("modules")) % 2 == 0).withColumn("tariff", F.lit("E")), "stem", f"{at}/enriched")
    _one_text(spark.createDataFrame([('{"insurer": "broken', "x")], "value string, k string"), "value", f"{at}/pure/stem=broken")
    sinks.json_by_key(spark.createDataFrame([("_index", "no record")], "stem string, insurer string"), "stem", f"{at}/more")
    found = files.records(spark, [f"{at}/pure/*/*.txt", f"{at}/more/*/*.txt"], f"{at}/enriched/*/*.txt")
    return found.select("stem", "insurer", "tariff", "enriched", included_count(F.col("modules")).alias("n_included"), F.col("coverage.wartezeit_monate").alias("wait_months"), F.col("coverage.geltungsbereich").alias("scope"))


@query(f"WITH {SNAP} SELECT date, position::INT AS position, insurer, product, price AS monatlich_eur, key FROM snap WHERE date IN (DATE '{OLD}', DATE '{NEW}')")
def stored_snapshots(spark, sf):
    at = work_folder(spark)
    both = snapshot(spark, sf, OLD).unionByName(snapshot(spark, sf, NEW))
    row = F.struct("position", "insurer", "product", F.col("price").alias("monatlich_eur"), "key")
    sinks.json_by_key(both.groupBy("date").agg(F.collect_list(row).alias("tariffs")).withColumn("source", F.lit("test")), "date", at)
    return files.snapshots(spark, f"{at}/*/*.txt").select("date", "position", "insurer", "product", "monatlich_eur", "key")


@query(f"WITH {SNAP} SELECT date, count(*) AS n, sum(cents)::BIGINT AS cents FROM snap WHERE date IN (DATE '{OLD}', DATE '{NEW}') GROUP BY date")
def snapshot_sink(spark, sf):
    """Three snapshots of which the second holds the rows of the first and is not stored."""
    at = work_folder(spark)
    rows = lambda month: snapshot(spark, sf, month).select("key", "cents")
    sinks.snapshot_if_changed(rows(OLD), rows(OLD).withColumn("date", F.to_date(F.lit(OLD))).limit(0), OLD, at)
    sinks.snapshot_if_changed(rows(OLD), spark.read.parquet(at), f"{OLD[:8]}15", at)
    sinks.snapshot_if_changed(rows(NEW), spark.read.parquet(at), NEW, at)
    return spark.read.parquet(at).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(f"WITH {SNAP}, {NOW} SELECT position::INT AS position, key, price, CASE WHEN position % 5 = 0 THEN '' ELSE '1,5' END AS tarifnote FROM now")
def delimited_file(spark, sf):
    at, cents = work_folder(spark), F.col("cents")
    price = F.concat(F.expr("cents div 100").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" EUR"))
    line = F.concat_ws(" | ", F.col("position").cast("string"), "insurer", "product", F.when(F.col("position") % 5 == 0, "").otherwise("1,5"), price, "band")
    lines = snapshot(spark, sf).select(line.alias("value")).unionByName(spark.createDataFrame([("# position | insurer | product",)], "value string"))
    lines.write.text(at)
    return files.delimited_rows(spark, at).select("position", "key", F.col("monatlich_eur").alias("price"), F.coalesce("tarifnote", F.lit("")).alias("tarifnote"))


@query(f"""WITH {TARIFFS}, d AS (SELECT stem, unnest(['avb', 'pib']) AS doctype FROM tariffs WHERE n_modules > 2)
SELECT stem, doctype, doctype || '_' || stem AS file_name, 'https://x/' || stem || '/' || doctype || '.pdf' AS url FROM d""")
def document_index(spark, sf):
    at = work_folder(spark)
    doc = lambda kind: F.struct(F.lit(kind).alias("doctype"), F.lit("pdf").alias("kind"), F.concat(F.lit(f"{kind}_"), "stem").alias("file"), F.concat(F.lit("https://x/"), "stem", F.lit(f"/{kind}.pdf")).alias("url"))
    entry = F.struct("stem", "insurer", F.col("product").alias("tariff"), F.when(F.col("n_modules") > 2, F.array(doc("avb"), doc("pib"))).otherwise(F.array()).alias("docs"))
    whole = tariffs(spark, sf).agg(F.collect_list(entry).alias("tariffs"))  # brands times types, whatever the scale
    _one_text(whole.select(F.to_json(F.struct("tariffs")).alias("j")), "j", at)
    return files.document_index(files.manifest(spark, f"{at}/*.txt")).drop("kind")


@query(f"""WITH {TARIFFS} SELECT 'tariff' AS scope, stem AS subject, 'src' || n AS source, 'b' || n AS badge, NULL::VARCHAR AS alias_of FROM (SELECT stem, unnest([1, 2]) AS n FROM tariffs WHERE n_modules % 2 = 1)
UNION ALL SELECT DISTINCT 'insurer', lower(insurer), 'i', 'any', NULL FROM tariffs UNION ALL SELECT 'alias', stem, NULL, NULL, insurer FROM tariffs WHERE n_modules % 2 = 0""")
def ratings_file(spark, sf):
    at, t = work_folder(spark), tariffs(spark, sf)
    rating = lambda source, badge: F.struct(F.lit(source).alias("source"), F.lit(badge).alias("badge"))
    own = t.filter("n_modules % 2 = 1").agg(F.map_from_entries(F.collect_list(F.struct("stem", F.array(rating("src1", "b1"), rating("src2", "b2"))))).alias("tariffs"))
    names = t.select(F.lower("insurer").alias("i")).distinct().agg(F.map_from_entries(F.collect_list(F.struct("i", F.array(rating("i", "any"))))).alias("insurers"))
    alias = t.filter("n_modules % 2 = 0").agg(F.map_from_entries(F.collect_list(F.struct("stem", "insurer"))).alias("tariff_aliases"))
    whole = own.join(names, F.lit(True)).join(alias, F.lit(True))  # one row each
    _one_text(whole.select(F.to_json(F.struct("*")).alias("j")), "j", at)
    found, aliases = files.ratings(spark, f"{at}/*.txt")
    none = F.lit(None).cast("string")
    rows = found.select("scope", "subject", "source", "badge", none.alias("alias_of"))
    return rows.unionByName(aliases.select(F.lit("alias").alias("scope"), F.col("stem").alias("subject"), none.alias("source"), none.alias("badge"), "alias_of"))


@query("""WITH c AS (SELECT DISTINCT p_type AS kind, p_brand AS key, p_size::VARCHAR AS synonym FROM part), k AS (SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY key) - 1 AS cat_ord FROM (SELECT DISTINCT kind, key FROM c))
SELECT kind, cat_ord::INT AS cat_ord, key, upper(key) AS label_de, (row_number() OVER (PARTITION BY kind, key ORDER BY synonym) - 1)::INT AS syn_ord, synonym FROM c JOIN k USING (kind, key)""")
def taxonomy_file(spark, sf):
    at = work_folder(spark)
    cats = table(spark, sf, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("key")).agg(F.sort_array(F.collect_set(F.col("p_size").cast("string"))).alias("synonyms"))
    kinds = cats.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("key", F.upper("key").alias("label_de"), "synonyms"))).alias("cs"))
    whole = kinds.agg(F.map_from_entries(F.collect_list(F.struct("kind", "cs"))).alias("taxonomy"))
    _one_text(whole.select(F.to_json(F.struct("taxonomy")).alias("j")), "j", at)
    return files.taxonomy(spark, f"{at}/*.txt")


@query("SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS ord, k AS key FROM (SELECT DISTINCT lower(p_type) AS k FROM part)")
def module_keys_file(spark, sf):
    at = work_folder(spark)
    keys = table(spark, sf, "part").agg(F.sort_array(F.collect_set(F.lower("p_type"))).alias("k"))
    text = F.concat(F.lit('{"properties": {"modules": {"properties": {'), F.array_join(F.transform("k", lambda k: F.concat(F.lit('"'), k, F.lit('": {"type": "object"}'))), ", "), F.lit("}}}}"))
    _one_text(keys.select(text.alias("j")), "j", at)
    return files.module_keys(spark, f"{at}/*.txt")


@query("SELECT max(p_size)::INT AS \"limit\", 'given' AS name, 0.5::DOUBLE AS weight FROM part")
def config_file(spark, sf):
    """What the file gives stands, what it lacks has its default, what it has besides is ignored."""
    at = work_folder(spark)
    given = table(spark, sf, "part").agg(F.max("p_size").alias("limit")).withColumns({"name": F.lit("given"), "unknown": F.lit(1)})
    _one_text(given.select(F.to_json(F.struct("*")).alias("j")), "j", at)
    return files.json_config(spark, f"{at}/*.txt", "limit int, name string, weight double", {"limit": 3, "name": "default", "weight": 0.5})


@query("SELECT lang AS tariff, source AS model, count(*)::INT AS runs, avg(n_chars)::DOUBLE AS wall_s FROM documents GROUP BY ALL")
def benchmark_file(spark, sf):
    at = work_folder(spark)
    cells = table(spark, sf, "documents").groupBy(F.col("lang").alias("tariff"), F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.avg("n_chars").alias("wall_s"))
    sinks.json_by_key(cells.groupBy("tariff").agg(F.collect_list(F.struct("tariff", "model", "runs", "wall_s")).alias("rows")).withColumnRenamed("tariff", "k"), "k", at)
    return files.benchmark_rows(spark, f"{at}/*/*.txt").select("tariff", "model", "runs", "wall_s")


def _item_files(spark, sf):
    at = work_folder(spark)
    marked = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text"))
    table(spark, sf, "benchmark").select("item_id", marked.alias("value")).repartition("item_id").write.partitionBy("item_id").text(at)
    return f"{at}/*/*.txt"


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '%PDF-' || text ELSE text END AS text FROM benchmark")
def text_files(spark, sf):
    found = files.texts(spark, _item_files(spark, sf))
    return found.select(_id_of(F.col("file"), "item_id").cast("long").alias("item_id"), F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


@query("SELECT item_id, item_id % 2 = 0 AS is_pdf, strlen(text) + 1 + CASE WHEN item_id % 2 = 0 THEN 5 ELSE 0 END AS length FROM benchmark WHERE item_id % 3 <> 0")
def binary_files(spark, sf):
    """Files as bytes; those known from a time after their own are left out."""
    path = _item_files(spark, sf)
    item = _id_of(F.col("path"), "item_id").cast("long")
    known = spark.read.format("binaryFile").load(path).filter(item % 3 == 0).select("path", F.to_timestamp(F.lit("2999-01-01")).alias("seen"))
    return files.binary_documents(spark, path, known).select(item.alias("item_id"), "is_pdf", "length")


_URLS = "CASE WHEN n % 3 = 0 THEN 'nowhere:' || n ELSE 'data:,page' || n END"


@query(f"SELECT DISTINCT url, CASE WHEN url LIKE 'data:%' THEN 200 END AS status, CASE WHEN url LIKE 'data:%' THEN substring(url, 7) END AS body, url NOT LIKE 'data:%' AS failed FROM (SELECT {_URLS} AS url FROM (SELECT p_size AS n FROM part))")
def fetched_pages(spark, sf):
    """Each address once; what cannot be fetched is a row that says why."""
    n = F.col("p_size").cast("string")
    urls = table(spark, sf, "part").select(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("nowhere:"), n)).otherwise(F.concat(F.lit("data:,page"), n)).alias("url"))
    return http.fetch_all(urls, attempts=1).select("url", "status", "body", F.col("error").isNotNull().alias("failed"))


@query("SELECT 'data:,' || lower(r_name[1:3]) AS url, lower(r_name[1:3]) AS body, http_change.known IS NOT NULL AND http_change.known <> 3 AS changed FROM region JOIN (VALUES (0, 3), (1, 4), (2, NULL), (3, 3), (4, 9)) AS http_change(k, known) ON k = r_regionkey")
def http_source(spark, sf):
    """The data source by its name, and which sizes say that a page changed."""
    spark.dataSource.register(http.HttpSource)
    named = table(spark, sf, "region").select("r_regionkey", F.concat(F.lit("data:,"), F.lower(F.substring("r_name", 1, 3))).alias("url"))
    urls = " ".join(r.url for r in named.select("url").collect())  # the option of a source: five names
    known = F.when(F.col("r_regionkey").isin(0, 3), 3).when(F.col("r_regionkey") == 1, 4).when(F.col("r_regionkey") == 4, 9)
    found = spark.read.format("http_pages").option("urls", urls).option("attempts", "1").load().join(named, "url")
    return found.select("url", "body", F.coalesce(http.size_changed(known, F.length("body")), F.lit(False)).alias("changed"))


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def run_log(spark, sf):
    """A log that is only ever added to, as JSON lines."""
    at, runs = work_folder(spark), table(spark, sf, "events").select("event_id", "event_type")
    sinks.append(runs, at)
    sinks.json_lines(runs, at, "append")
    return spark.read.schema("event_id long, event_type string").json(at).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT '# nations' AS value UNION ALL SELECT '| n_name | region | n |' UNION ALL SELECT '|---|---|---|' UNION ALL
SELECT '| ' || n_name || '\\|x | ' || CASE WHEN n_regionkey = 0 THEN '–' ELSE n_regionkey::VARCHAR END || ' | ' || n_nationkey || ' |' FROM nation""")
def markdown_table(spark, sf):
    rows = table(spark, sf, "nation").select(F.concat("n_name", F.lit("|x")).alias("n_name"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("region"), F.col("n_nationkey").alias("n"))
    return sinks.markdown(rows, "nations")


@query("SELECT n_nationkey, '<!doctype html><meta charset=utf-8><pre>' || n_name || ' &lt;a&gt; &amp; b</pre>' AS page FROM nation")
def text_pages(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", sinks.html_page(F.concat("n_name", F.lit(" <a> & b"))).alias("page"))


@query("""SELECT p_partkey, p_name || ' & co' AS item, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR || ',5' END AS grade, p_brand AS rating,
CASE WHEN p_size % 3 = 0 THEN 'A=3|B=' || p_size ELSE '-' END AS waits FROM part""")
def html_fields(spark, sf):
    n = F.col("p_size").cast("string")
    grade = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<em class="g">'), n, F.lit(",5</em>"))).otherwise("")
    waits = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<dt>A</dt><dd>3</dd>\n<dt>B</dt><dd>"), n, F.lit("</dd><dt>A</dt><dd>9</dd>"))).otherwise("")
    block = F.concat(F.lit("<b>"), "p_name", F.lit("\n &amp;   co</b>"), grade, F.lit('<i>Rating</i> <span class="v">'), "p_brand", F.lit("</span>"), waits)
    found = F.map_entries(html.pairs(block, r"<dt>([^<]*)</dt>\s*<dd>([^<]*)</dd>"))
    said = F.coalesce(F.array_join(F.transform(found, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"), F.lit("-"))
    return table(spark, sf, "part").select("p_partkey", html.field(block, "<b>([^<]*)</b>").alias("item"), html.field(block, '<em class="g">([^<]*)</em>').alias("grade"), html.labelled(block, "Rating").alias("rating"), said.alias("waits"))


@query("""SELECT n_regionkey AS page, n_nationkey AS node, n_nationkey // 3 AS parent FROM nation a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey // 3 = a.n_nationkey)""")
def innermost_nodes(spark, sf):
    nodes = table(spark, sf, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").cast("long").alias("node"), F.expr("n_nationkey div 3").alias("parent"))
    return html.innermost(nodes)


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>', 0)) AS mark FROM pages), p AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>', 0)) AS mark FROM pages)
SELECT page_id, mark, count(*) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM p WHERE page_id NOT IN (SELECT page_id FROM t)) GROUP BY ALL""")
def fallback_rows(spark, sf):
    """The rows of a second extractor for pages on which the first finds nothing."""
    of = lambda mark: table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(f"({mark})"), F.lit(1))).alias("mark"))
    return html.first_nonempty(of("<li>"), of("<p>"), "page_id").groupBy("page_id", "mark").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, list_sort(list(DISTINCT event_type)) AS l FROM events GROUP BY ALL)
SELECT k, d, array_to_string([x FOR x IN l IF NOT list_contains(coalesce(b, []), x)], ',') AS new_links FROM (SELECT *, lag(l) OVER (PARTITION BY k ORDER BY d) AS b FROM s)""")
def revealed_links(spark, sf):
    states = table(spark, sf, "events").groupBy(F.col("user_id").alias("k"), F.col("ts").cast("date").alias("d")).agg(F.sort_array(F.collect_set("event_type")).alias("l"))
    return html.revealed(states, "k", "d", "l").select("k", "d", F.array_join("new_links", ",").alias("new_links"))


_MET = """e AS (SELECT p_partkey, p_name, 'u' || p_size AS url, '2024-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS stand FROM part),
g AS (SELECT 'u' || p_size AS url, string_agg(DISTINCT upper(p_name), '; ') AS plain, '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS page_at FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size)"""


def _entries(spark, sf):
    day = lambda n: F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))
    parts = table(spark, sf, "part").withColumn("url", F.concat(F.lit("u"), F.col("p_size").cast("string")))
    entries = parts.select(F.lit("tariff").alias("scope"), F.col("p_partkey").cast("string").alias("subject"), "url", day(F.col("p_partkey")).alias("stand"), F.array("p_name").alias("evidence"))
    pages = parts.filter("p_partkey % 2 = 0").groupBy("url", "p_size").agg(F.array_join(F.collect_set(F.upper("p_name")), "; ").alias("plain"))  # few names in all
    return entries, pages.select("url", "plain", day(F.col("p_size")).alias("page_stand"))


@query(f"""WITH {_MET} SELECT p_partkey::VARCHAR AS subject, CASE WHEN plain IS NULL THEN 'failed' WHEN NOT contains(lower(plain), p_name) THEN 'review' WHEN stand = page_at THEN 'ok' WHEN stand < page_at THEN 'pending' ELSE 'review' END AS state FROM e LEFT JOIN g USING (url)""")
def verdict_states(spark, sf):
    return quality.verdict_states(*_entries(spark, sf)).select("subject", "state")


@query(f"WITH {_MET} SELECT url, max(stand) AS stand FROM e GROUP BY url")
def newest_stands(spark, sf):
    return quality.newest_stands(_entries(spark, sf)[0])


@query("SELECT p_partkey::VARCHAR AS stem, p_partkey % 5 = 0 OR p_partkey % 3 = 0 AS fits FROM part")
def bundle_fits(spark, sf):
    """Insurers with a word of four letters are looked for in their files; one in five has none."""
    file = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Conditions_"), F.upper("p_brand"))).otherwise(F.col("p_type"))
    name = F.when(F.col("p_partkey") % 5 == 0, "X#1").otherwise(F.col("p_brand"))
    return quality.bundle_fits(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("stem"), name.alias("insurer"), F.array(F.struct(file.alias("file"), F.lit("https://x/y").alias("url"))).alias("docs")))


@query(f"""WITH {TARIFFS} SELECT stem, 'scope' AS path, 'null is not string' AS message FROM tariffs WHERE scope IS NULL UNION ALL SELECT stem, 'stand', 'is required' FROM tariffs
UNION ALL SELECT stem, 'extra', 'is not declared' FROM tariffs WHERE n_modules = 3""")
def shape_errors(spark, sf):
    t = tariffs(spark, sf)
    kind = lambda c: F.when(F.col(c).isNull(), "null").otherwise("string")
    cell = lambda path, c: F.struct(F.lit(path).alias("path"), kind(c).alias("kind"), F.col(c).alias("value"))
    cells = F.array(cell("sum", "sum_insured"), cell("scope", "scope"), F.when(F.col("n_modules") == 3, cell("extra", "insurer")))
    values = t.select("stem", F.explode(F.array_compact(cells)).alias("x")).select("stem", "x.*")
    declared = spark.createDataFrame([("sum", "string?", False), ("scope", "string", True), ("stand", "string", True)], "path string, kind string, required boolean")
    return quality.shape_errors(values, declared)


@query("""WITH d AS (SELECT o_custkey AS stem, CAST(o_orderdate AS DATE) AS day, max(o_orderkey % 5) * 0.004::DOUBLE AS price FROM orders GROUP BY ALL)
SELECT stem, day, old_price, price AS new_price, price - old_price AS delta FROM (SELECT *, lag(price) OVER (PARTITION BY stem ORDER BY day) AS old_price FROM d) WHERE abs(price - old_price) > 0.005""")
def price_events_stream(spark, sf):
    """Price changes as events of a keyed stream: prices in order, then late ones among newer ones, then some once more."""
    at = work_folder(spark)
    day = F.col("o_orderdate").cast("date")
    prices = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("stem"), day.cast("timestamp").alias("at")).agg((F.max(F.col("o_orderkey") % 5) * F.lit(0.004)).alias("price"))
    last = prices.agg(F.max("at")).first()[0]
    cut = [last - datetime.timedelta(days=d) for d in (600, 300)]
    held = (F.col("at") > F.lit(cut[0] - datetime.timedelta(days=50))) & (F.pmod(F.xxhash64("stem", "at"), F.lit(4)) == 0)
    old, middle = F.col("at") <= F.lit(cut[0]), (F.col("at") > F.lit(cut[0])) & (F.col("at") <= F.lit(cut[1]))
    repeated = (F.col("at") > F.lit(cut[1] - datetime.timedelta(days=50))) & (F.col("at") <= F.lit(cut[1]))
    end = spark.createDataFrame([(None, last + datetime.timedelta(days=400), None)], prices.schema)
    for batch in (prices.filter(old & ~held), prices.filter(middle | old & held), prices.filter(repeated | (F.col("at") > F.lit(cut[1]))), end):
        batch.write.mode("append").parquet(f"{at}/in")
        stream = keyed_state.price_events(spark.readStream.schema(prices.schema).parquet(f"{at}/in"))
        keyed_state.drained(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(keyed_state.EVENTS).parquet(f"{at}/out")


@query("SELECT DISTINCT user_id FROM events")
def first_of_each_stream(spark, sf):
    """The first row of each key, from a stream; which row comes first is the stream's."""
    at = work_folder(spark)
    events = table(spark, sf, "events").select("user_id", "event_type")
    events.write.parquet(f"{at}/in")
    stream = append_on_change.first_of_each(spark.readStream.schema(events.schema).parquet(f"{at}/in"), ["user_id"])
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{at}/out").select("user_id")


@query("SELECT c_custkey AS k FROM customer WHERE c_nationkey <> 7")
def pruned_entries(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return merges.delete(c.select("k"), c.filter("c_nationkey = 7").select("k"), ["k"])


@query("""SELECT p_partkey, regexp_replace(p_name || '/ü', '[^A-Za-z0-9.+_-]', '_', 'g') AS token, CASE WHEN length(p_name) > 6 THEN left(p_name, 5) || '…' ELSE p_name END AS short, 'a%22b%5B' || p_name || '%5D' AS link,
p_name AS reply, 'grosse ' || lower(p_brand) AS loose, 'Mass ' || p_brand AS plain, 'groesse-' || lower(replace(p_brand, '#', '-')) AS slug FROM part""")
def text_helpers(spark, sf):
    from ..functions import text

    with_name = lambda a, b="": F.concat(F.lit(a), "p_name", F.lit(b))
    return table(spark, sf, "part").select(
        "p_partkey", text.file_token(with_name("", "/ü")).alias("token"), text.cut(F.col("p_name"), 6).alias("short"), text.link(with_name('a"b[', "]")).alias("link"), text.unfenced(with_name(" ```json\n", "\n```")).alias("reply"),
        text.vowel_folded(F.concat(F.lit("Große "), "p_brand")).alias("loose"), text.sharp_s_folded(F.concat(F.lit("Maß "), "p_brand")).alias("plain"), text.url_slug(F.concat(F.lit("Gr%C3%B6%C3%9Fe "), F.replace("p_brand", F.lit("#"), F.lit("%23")))).alias("slug"),
    )


@query("""SELECT p_partkey, printf('%.2f', p_retailprice) AS euros, repeat('█', round(p_size / 5.0)::INT) || repeat('░', 10 - round(p_size / 5.0)::INT) AS bar, printf('#%02x%02x%02x', round_even(255 * (p_size / 50.0::DOUBLE), 0)::INT, 0, 255) AS colour,
CASE WHEN p_partkey % 7 = 0 THEN 'dnf' WHEN p_size * 2 >= 90 THEN 'high' WHEN p_size * 2 >= 60 THEN 'middle' ELSE 'low' END AS band FROM part""")
def cell_helpers(spark, sf):
    from ..functions import display

    share = F.col("p_size") / F.lit(50.0)
    return table(spark, sf, "part").select("p_partkey", display.euros(F.col("p_retailprice")).alias("euros"), display.bar(share, 10).alias("bar"), display.lerp_hex("#0000ff", "#ff00ff", share).alias("colour"), display.score_band(F.col("p_size") * 2, F.col("p_partkey") % 7 == 0).alias("band"))


@query(f"WITH {SNAP}, {NOW} SELECT position, price, cents FROM now")
def money_roundtrip(spark, sf):
    """Prices written in German notation, thousands grouped, and read again."""
    written = F.replace(F.replace(F.replace(F.format_number(F.col("cents") / 100, 2), F.lit(","), F.lit("x")), F.lit("."), F.lit(",")), F.lit("x"), F.lit("."))
    return snapshot(spark, sf).select("position", money(F.concat(written, F.lit(" €"))).alias("price"), "cents")
