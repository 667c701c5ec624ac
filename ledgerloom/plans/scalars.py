"""Scalar functions over test columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, scores, text
from .registry import query
from .views import NOTE_SCORE, NOW, RATING_SCORE, SNAP, snapshot, table


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS eur FROM part")
def parse_eur(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    written = F.concat(F.when(cents >= 100000, F.concat((cents / 100000).cast("long").cast("string"), F.lit("."), F.lpad((F.expr("cast(round(p_retailprice * 100) as bigint) div 100 % 1000")).cast("string"), 3, "0"))).otherwise(F.expr("cast(round(p_retailprice * 100) as bigint) div 100").cast("string")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" EUR"))
    return table(spark, sf, "part").select("p_partkey", text.money(F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(written)).alias("eur"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS grade FROM lineitem")
def parse_note(spark, sf):
    written = F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit(" "), F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(","))))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.grade(written).alias("grade"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS key FROM documents")
def norm_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.squeezed(F.col("text")).alias("key"))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, array_to_string([regexp_replace(x, '[.\\s]', '', 'g') FOR x IN regexp_extract_all(regexp_replace(text, ',[0-9]+', '', 'g'), '[0-9]{1,3}(?:[.\\s][0-9]{3})+|[0-9]+')], '|') AS tokens FROM documents")
def amounts_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.number_tokens(F.col("text")), "|").alias("tokens"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'k.A.' WHEN 1 THEN '1,5 Mio.' WHEN 2 THEN '500 Tsd.' WHEN 3 THEN '2 Mio./unbegr.' WHEN 4 THEN 'unbegrenzt*' ELSE 'auf Anfrage' END AS short FROM part""")
def short_sum(spark, sf):
    given = F.array(*map(F.lit, ["", "1.500.000 EUR", "500 000,00 EUR", "2000000 EUR (Smart); unbegrenzt (Best)", "unbegrenzt (weltweit)", "auf Anfrage"]))
    return table(spark, sf, "part").select("p_partkey", text.short_sum(F.element_at(given, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("short"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ohne/150 €' WHEN 1 THEN '150/300 €' ELSE 'k.A.' END AS deductible, CASE p_partkey % 3 WHEN 0 THEN '1/3/5 J.' WHEN 1 THEN '1 J., tägl.' ELSE 'offen' END AS term, CASE p_partkey % 3 WHEN 0 THEN 'Europa' WHEN 1 THEN 'Europa+ww. temp.' ELSE 'Mars' END AS scope FROM part""")
def short_labels(spark, sf):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", text.short_deductible(pick("ohne oder 150 EUR", "150, 300 oder 500 EUR", "")).alias("deductible"),
        text.short_term(pick("1, 3 oder 5 Jahre", "1 Jahr, täglich kündbar", "offen")).alias("term"), text.short_scope(pick("Europa", "Europa, weltweit befristet", "Mars")).alias("scope"),
    )


@query(f"WITH {SNAP}, {NOW} SELECT position, {NOTE_SCORE} AS grade_score, {RATING_SCORE} AS rating_score, price FROM now")
def clamp_scores(spark, sf):
    return snapshot(spark, sf).select("position", scores.grade_score(F.col("note")).alias("grade_score"), scores.rating_score(F.col("bewertung")).alias("rating_score"), "price")


@query(r"SELECT page_id, regexp_replace(list_last(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')), '\.html$', '') AS name FROM pages")
def url_decode_file(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(text.file_of_url(F.col("url")), r"\.html$", "").alias("name"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '-') AS page, len([p FOR p IN string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') IF p <> '']) AS n FROM pages")
def query_parameters(spark, sf):
    pairs = text.query_pairs(F.col("url"))
    page = F.get(F.filter(pairs, lambda p: p["k"] == "page"), 0)["v"]
    return table(spark, sf, "pages").select("page_id", F.coalesce(page, F.lit("-")).alias("page"), F.size(pairs).cast("long").alias("n"))


@query("SELECT page_id, CASE WHEN contains(url, '?page=2&ref=x') THEN 'ref=x&page=9' WHEN contains(url, '?utm_source=feed') THEN 'utm_source=feed&page=9' ELSE 'page=9' END AS query FROM pages")
def query_replaced(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.query_string(text.with_param(text.query_pairs(F.col("url")), "page", F.lit("9"))).alias("query"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%d.%m.%Y') || '|' || day(o_orderdate) || '. ' ||
['Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember'][month(o_orderdate)] || ' ' || year(o_orderdate) AS printed FROM orders""")
def date_variants(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(text.printed_dates(F.col("o_orderdate").cast("date")), "|").alias("printed"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS newest FROM orders")
def page_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    forms = text.printed_dates(F.date_sub(day, 40))
    plain = F.concat_ws(" ", F.lit("Stand"), F.get(forms, 0), F.lit("und"), F.get(text.printed_dates(day), (F.col("o_orderkey") % 3).cast("int")), F.lit("sowie"), F.get(forms, 2))
    return table(spark, sf, "orders").select("o_orderkey", text.newest_date(plain).alias("newest"))


@query("SELECT o_orderkey, d, CASE WHEN b = 0 THEN 0.0 ELSE d / b * 100 END AS pct, CASE WHEN d < 0 THEN 'cheaper' WHEN d > 0 THEN 'pricier' ELSE 'same' END AS direction FROM (SELECT o_orderkey, o_totalprice - 200000.0::DOUBLE AS d, 200000.0::DOUBLE AS b FROM orders)")
def price_deltas(spark, sf):
    d = display.price_delta(F.col("o_totalprice"), F.lit(200000.0))
    return table(spark, sf, "orders").select("o_orderkey", d["delta"].alias("d"), d["pct"].alias("pct"), d["direction"].alias("direction"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'analysed' WHEN p_size > 30 THEN 'pdf' WHEN p_size > 20 THEN 'urls' ELSE 'listed' END AS status,
CASE WHEN length(p_name) > 9 THEN left(p_name, 8) || '…' ELSE rpad(p_name, 9, ' ') END AS cell, 'Brand-' || substring(p_brand, 7) AS label FROM part""")
def cells(spark, sf):
    stem = text.stem(F.col("p_brand"), F.col("p_type"))
    return table(spark, sf, "part").select(
        "p_partkey", display.status(F.col("p_size") > 40, F.col("p_size") > 30, F.col("p_size") > 20).alias("status"), display.padded(F.col("p_name"), 9).alias("cell"), display.initials(stem).alias("label")
    )


@query("SELECT p_partkey, (p_partkey % 3 > p_size % 3)::BIGINT - (p_partkey % 3 < p_size % 3)::BIGINT AS direction FROM part")
def level_directions(spark, sf):
    level = lambda c: F.element_at(F.array(F.lit("Basis"), F.lit("KOMFORT"), F.lit("Premium ")), (c % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", display.level_direction(level(F.col("p_size")), level(F.col("p_partkey"))).alias("direction"))


@query("SELECT DISTINCT source || ':m' || (doc_id % 3) || '@h' AS spec, source AS provider, 'm' || (doc_id % 3) AS model, 'h' AS endpoint FROM documents")
def model_specs(spark, sf):
    spec = table(spark, sf, "documents").select(F.concat("source", F.lit(":m"), (F.col("doc_id") % 3).cast("string"), F.lit("@h")).alias("spec")).distinct()
    return spec.select("spec", text.spec_parts(F.col("spec")).alias("p")).select("spec", "p.*")
