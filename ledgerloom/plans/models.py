"""Benchmarks of models, replies, calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.replies import model_call, recover_json
from ..operators import benchmark
from ..session import work_folder
from ..sources import jobs
from .registry import query
from .views import table

_RUNS = "runs AS (SELECT lang AS tariff, source AS model, doc_id, quality = 1 AS faithful, doc_id % 7 <> 0 AS ok, doc_id % 3 <> 0 AS schema_ok, n_chars % 9 AS modules, toxic AS unsupported, CASE WHEN doc_id % 4 <> 0 THEN n_chars / 1000.0::DOUBLE END AS cost, doc_id % 50 AS wall FROM labels JOIN documents USING (doc_id))"
_CELLS = f"""{_RUNS}, cells AS (SELECT tariff, model, count(*) AS runs, count(*) FILTER (ok) AS ok, count(*) FILTER (ok AND schema_ok) AS schema_ok, count(*) FILTER (ok AND faithful) AS faithful,
  min(modules) FILTER (ok) AS modules_min, max(modules) FILTER (ok) AS modules_max, max(unsupported) FILTER (ok)::BIGINT AS unsupported_max, avg(wall) FILTER (ok) AS wall FROM runs GROUP BY ALL)"""


def _runs(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").drop("text"), "doc_id")
    return joined.select(
        F.col("lang").alias("tariff"), F.col("source").alias("model"), "doc_id", (F.col("quality") == 1).alias("faithful"), (F.col("doc_id") % 7 != 0).alias("ok"), (F.col("doc_id") % 3 != 0).alias("schema_ok"),
        (F.col("n_chars") % 9).alias("modules"), F.col("toxic").cast("long").alias("unsupported"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / F.lit(1000.0)).alias("cost"), (F.col("doc_id") % 50).alias("wall"),
    )


@query(f"WITH {_CELLS} SELECT * FROM cells")
def bench_aggregate(spark, sf):
    return benchmark.aggregate(_runs(spark, sf), ["tariff", "model"]).drop("cost")


@query(f"""WITH {_CELLS} SELECT tariff, model, CASE WHEN ok = 0 THEN 0.0::DOUBLE ELSE 50.0::DOUBLE * (faithful / runs) + 20.0::DOUBLE * (schema_ok / runs) + greatest(0, 15 - 5 * unsupported_max) + 15.0::DOUBLE * (modules_max / greatest((SELECT max(modules_max) FROM cells), 1)) * (schema_ok / runs) END AS score FROM cells""")
def bench_scorecard(spark, sf):
    return benchmark.scored(benchmark.aggregate(_runs(spark, sf), ["tariff", "model"])).select("tariff", "model", "score")


@query(f"""WITH {_RUNS}, f AS (SELECT DISTINCT tariff, model, 'm' || modules AS module FROM runs), n AS (SELECT tariff, count(DISTINCT model) AS n_all FROM f GROUP BY tariff)
SELECT tariff, module, count(DISTINCT model) AS n_models, any_value(n_all) AS n_all FROM f JOIN n USING (tariff) GROUP BY tariff, module HAVING any_value(n_all) >= 2 AND count(DISTINCT model) < any_value(n_all)""")
def cross_model_disagreement(spark, sf):
    found = _runs(spark, sf).select("tariff", "model", F.concat(F.lit("m"), F.col("modules").cast("string")).alias("module"))
    return benchmark.disagreement(found)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN contains(regexp_replace(text, '[^0-9]', '', 'g'), n_chars::VARCHAR) ELSE contains(lower(text), lang) END AS grounded FROM documents""")
def grounded_claims(spark, sf):
    claim = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("n_chars").cast("string"), F.lit(" EUR"))).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", benchmark.grounded(claim, F.col("text")).alias("grounded"))


@query(f"WITH {_RUNS} SELECT count(cost) AS priced, count(*) - count(cost) AS unpriced, sum((cost * 1000)::BIGINT)::BIGINT AS thousandths FROM runs")
def cost_totals(spark, sf):
    totals = benchmark.cost_totals(_runs(spark, sf))
    return totals.select("priced", "unpriced", F.round(F.col("total") * 1000).cast("long").alias("thousandths"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS reply FROM events")
def coerce_json(spark, sf):
    written = (
        F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("So {} it is: "), F.col("props"), F.lit(" - done"))).otherwise(F.lit("[1, 2]"))
    )
    return table(spark, sf, "events").select("event_id", recover_json(written).alias("reply"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events")
def json_path_lookup(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.a.b", "string").alias("missing"))


def _stub(instruction: str, payload: str) -> dict:
    if payload.startswith("error"):
        raise ValueError("refused")
    return {"text": f"{instruction} {payload}", "cost_usd": 0.0, "input_tokens": len(payload), "output_tokens": 1}


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'say ' || event_type END AS text, CASE WHEN event_type = 'error' THEN 'ValueError: refused' END AS error, CASE WHEN event_type <> 'error' THEN length(event_type) END AS tokens FROM events")
def model_stub_call(spark, sf):
    reply = model_call(_stub, "say")(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", reply.alias("r")).select("event_id", "r.text", "r.error", F.col("r.input_tokens").alias("tokens"))


def _reader(down: str | None):
    """Tells the words and digits of a payload as a model's reply would; the endpoint that is down refuses."""

    def call(endpoint: str, payload: str | None) -> dict:
        if endpoint == down:
            raise ConnectionError("down")
        said = payload or ""
        reply = {"words": len([w for w in said.split(" ") if w]), "digits": sum(c in "0123456789" for c in said)}
        return {"text": f"Here it is: {reply} ".replace("'", '"'), "input_tokens": len(said), "output_tokens": 2}

    return call


@query("""WITH j AS (SELECT conv_id || ':' || turn AS job, role, conv_id % 2 = 0 AND role <> 'user' AS early, coalesce(text, '') AS t FROM (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1)
SELECT job, role AS endpoint, CASE WHEN early THEN 0 ELSE 1 END AS run, len([x FOR x IN string_split(t, ' ') IF x <> '']) AS words, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(t) AS input_tokens FROM j""")
def resumed_jobs(spark, sf):
    """A job a turn, in two runs of one log: half of the conversations while one endpoint is down, then all, of which the open ones are called."""
    at = work_folder(spark)
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("job"), F.col("role").alias("endpoint"), F.col("text").alias("payload"), (F.col("conv_id") % 2 == 0).alias("early"))
    limits = {e: jobs.Limit(1e6, 2) for e in ("system", "user", "assistant")}
    jobs.run_jobs(turns.filter("early"), at, _reader("user"), limits)
    done = jobs.run_jobs(turns, at, _reader(None), limits)
    v = F.try_parse_json(recover_json(F.col("text")))
    return done.select("job", "endpoint", "run", F.try_variant_get(v, "$.words", "bigint").alias("words"), F.try_variant_get(v, "$.digits", "bigint").alias("digits"), "input_tokens")
