"""Saved runs of models over the documents, judged again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark, rescoring
from .registry import ORACLE_SQL, query
from .texts import ANCHORS
from .views import table

_MODULES = ["m0", "m1"]
_SCHEMA = {
    "type": "object", "required": ["coverage", "modules", "sources"], "additionalProperties": False,
    "properties": {"coverage": {"type": "object"}, "modules": {"type": "object"}, "beitrag": {"type": "object"}, "sources": {"type": "array"}},
}


def _saved(spark, sf):
    """Three runs of each document and what was fed to them; some tariffs lack documents, some records break."""
    d = table(spark, sf, "documents").withColumn("tariff", F.concat_ws(" / ", "source", F.col("doc_id").cast("string")))
    known = d.filter("doc_id % 7 <> 0")
    short = F.concat_ws(" ", "lang", F.col("n_chars").cast("string"), F.lit("EUR"))
    avb = known.select("tariff", F.lit("avb").alias("doctype"), F.lit(0).alias("ordinal"), "text")
    docs = avb.unionByName(known.select("tariff", F.lit("pib").alias("doctype"), F.lit(1).alias("ordinal"), short.alias("text")))
    none, begins = F.lit(None), F.substring("text", 1, 12)
    cover = lambda total, own, scope, term: F.struct(total.cast("string").alias("versicherungssumme"), own.cast("string").alias("selbstbeteiligung"), scope.cast("string").alias("geltungsbereich"), term.cast("string").alias("vertragslaufzeit"))
    module = lambda *on: F.struct(*(F.struct(F.lit(k in on).alias("included"), F.lit("voll").alias("level")).alias(k) for k in _MODULES))
    run = lambda tail, coverage, fee, modules: F.struct(F.lit(tail).alias("tail"), coverage.alias("coverage"), fee.cast("double").alias("fee"), modules.alias("modules"))
    three = d.withColumn("r", F.explode(F.array(
        run("avb+pib~none~a", cover(F.concat_ws(" ", F.col("n_chars").cast("string"), F.lit("EUR")), none, F.lit("Europaweit"), F.lit("1 Jahr")), none, module("m0", "m1")),
        run("pib~none~b__r2", cover(begins, none, F.lit("Deutschland"), F.lit("")), none, module()),
        run("avb~trim~c", cover(none, begins, F.lit("WELT"), F.lit("1 Jahr")), F.col("doc_id") + 0.5, module("m1")),
    )))
    body = F.struct(
        F.col("r.coverage").alias("coverage"), F.col("r.modules").alias("modules"), F.when(F.col("r.fee").isNotNull(), F.struct(F.col("r.fee").alias("monatlich_eur"))).alias("beitrag"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("maker:model")).alias("model_spec"), F.when(F.col("doc_id") % 13 == 0, F.lit(1)).alias("more"),
    )
    name = F.concat_ws("~", "source", F.col("doc_id").cast("string"), "r.tail")
    saved = three.select(F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("~"), F.col("r.tail"))).otherwise(name).alias("name"), F.when(F.col("doc_id") % 11 == 0, "[1]").otherwise(F.to_json(body)).alias("body"))
    return rescoring.rescored(saved, docs, _SCHEMA, _MODULES, ANCHORS)


def _held(v, s):
    numbers = f"[n FOR n IN [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all({v}, '[0-9][0-9.,\\s]*[0-9]|[0-9]')] IF length(n) > 1]"
    return f"CASE WHEN len({numbers}) > 0 THEN list_bool_and([contains(regexp_replace({s}, '[^0-9]', '', 'g'), n) FOR n IN {numbers}]) ELSE contains(lower({s}), trim(lower({v}), E' \\t\\n\\r\\x0b\\f')) END"


_RESCORED = f"""trimmed AS ({ORACLE_SQL["trim_choice"]}),
d AS (SELECT doc_id, source || ' / ' || doc_id AS tariff, coalesce(text, '') AS t, coalesce(trimmed, '') AS cut, lang || ' ' || n_chars || ' EUR' AS pib, n_chars || ' EUR' AS said,
      nullif(substr(text, 1, 12), '') AS begins, (doc_id + 0.5)::DOUBLE::VARCHAR AS fee FROM documents JOIN trimmed USING (doc_id) WHERE doc_id % 7 <> 0 AND doc_id % 17 <> 0),
claims AS (SELECT *, 'a' AS m, 'avb+pib' AS variant, 'none' AS filter, 0 AS run, 2 AS n_modules, true AS there, [{_held("said", "t || chr(10) || pib")}] AS held FROM d
      UNION ALL SELECT *, 'b', 'pib', 'none', 2, 0, false, CASE WHEN begins IS NULL THEN [] ELSE [{_held("begins", "pib")}] END FROM d
      UNION ALL SELECT *, 'c', 'avb', 'trim', 0, 1, true, CASE WHEN begins IS NULL THEN [] ELSE [{_held("begins", "cut")}] END || [{_held("fee", "cut")}] FROM d),
told AS (SELECT doc_id, tariff, variant, filter, run, doc_id % 11 = 0 AS broken, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS schema_ok, there, m, n_modules, held FROM claims),
runs AS (SELECT tariff, CASE WHEN doc_id % 3 = 0 AND NOT broken THEN 'maker:model' ELSE m END AS model, variant, filter, run, schema_ok,
      CASE WHEN broken THEN 0 ELSE n_modules END AS modules, CASE WHEN broken THEN 0 ELSE len(held) END AS claims, CASE WHEN broken THEN 0 ELSE len([h FOR h IN held IF NOT h]) END AS unsupported,
      schema_ok AND there AND len([h FOR h IN held IF NOT h]) = 0 AS faithful FROM told)"""


@query(f"WITH {_RESCORED} SELECT tariff, model, variant, filter, run, schema_ok, modules::INT AS modules, claims::INT AS claims, unsupported::INT AS unsupported, faithful FROM runs")
def rescored_runs(spark, sf):
    return _saved(spark, sf).select("tariff", "model", "variant", "filter", "run", "schema_ok", F.size("modules").alias("modules"), F.size("claims").alias("claims"), "unsupported", "faithful")


@query(f"""WITH {_RESCORED} SELECT model, variant, filter, count(*) AS runs, count(*) FILTER (schema_ok) AS schema_ok, count(*) FILTER (faithful) AS faithful,
min(modules)::INT AS modules_min, max(modules)::INT AS modules_max, max(unsupported)::INT AS unsupported_max FROM runs GROUP BY ALL""")
def rescored_cells(spark, sf):
    """Runs judged again, one row for each model and input."""
    runs = _saved(spark, sf).withColumns({"ok": F.lit(True), "modules": F.size("modules"), "cost": F.lit(None).cast("double"), "wall": F.lit(None).cast("double")})
    return benchmark.aggregate(runs, ["model", "variant", "filter"]).drop("ok", "cost", "wall")
