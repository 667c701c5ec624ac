"""Saved runs of models judged again without a call: shape, claims held against what was fed, fields that must be there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from .benchmark import digits, grounded_in
from .reports import run_name
from .shapes import first_errors, json_type
from .trimming import trim

#: Fields whose values are held against the documents.
GUARDED = [("coverage", "versicherungssumme"), ("coverage", "selbstbeteiligung"), ("beitrag", "monatlich_eur"), ("beitrag", "jaehrlich_eur")]
#: Fields that must be there, and what one of their words has to hold, if that is asked for.
REQUIRED = {("coverage", "geltungsbereich"): ("europ", "weltweit", "welt", "international", "ww"), ("coverage", "vertragslaufzeit"): ()}
#: Members that the run adds to a record and that are not the model's.
OWN = ("sources", "model_spec")


def _text_at(record: Column, *names: str) -> Column:
    """A member as text; null where it is missing, null, an empty text or an empty list."""
    text = F.try_variant_get(record, "$" + "".join(f"['{n}']" for n in names), "string")
    return F.when(~text.isin("", "[]"), text)


def _judged(record: Column, schema: dict, modules: list[str], guarded: list[tuple[str, str]], required: dict[tuple[str, str], tuple[str, ...]]) -> dict[str, Column]:
    """What a record shows by itself. Members of the run's own are passed over, whatever the schema says of them."""
    without = {**schema, "properties": {**schema.get("properties", {}), **{m: {} for m in OWN}}}
    errors = F.transform(first_errors(record, without, passed_over=OWN), lambda e: F.concat_ws(": ", e["path"], e["message"]))
    claims = [F.struct(F.lit(".".join(at)).alias("field"), _text_at(record, *at).alias("value")) for at in guarded]

    def there(at: tuple[str, str], words: tuple[str, ...]) -> Column:
        text = F.lower(_text_at(record, *at))
        holds = text.isNotNull()
        if words:
            holds = F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(False))
        return F.struct(F.lit(".".join(at)).alias("field"), holds.alias("there"))

    included = lambda k: F.coalesce(F.try_variant_get(record, f"$['modules']['{k}']['included']", "boolean"), F.lit(False))
    level = lambda k: F.try_variant_get(record, f"$['modules']['{k}']['level']", "string")
    found = [F.when(included(k), F.struct(F.lit(k).alias("module"), level(k).alias("level"))) for k in modules]
    is_object = F.coalesce(json_type(record) == "object", F.lit(False))
    asked = F.array(*(there(at, words) for at, words in required.items()))
    return {
        "schema_errors": errors,
        "claims": F.filter(F.array(*claims), lambda c: c["value"].isNotNull()),
        "required": F.when(is_object, asked).otherwise(F.slice(asked, 1, 0)),
        "modules": F.array_compact(F.array(*found)),
        "spec": _text_at(record, "model_spec"),
    }


def fed_sources(runs: DataFrame, documents: DataFrame, anchors: str, trimmed: str = "avb") -> DataFrame:
    """tariff, variant, filter, source_digits, source_low: what the documents of a variant say, a row each.

    A variant names the kinds of its documents, joined by +. With a filter other than ``none`` those of the kind
    ``trimmed`` were fed trimmed. Their texts follow each other in order of ``ordinal``.
    """
    asked = runs.select("tariff", "variant", "filter").distinct()
    kinds = asked.withColumn("doctype", F.explode(F.array_distinct(F.split("variant", r"\+"))))
    cut = (F.col("filter") != "none") & (F.col("doctype") == trimmed)
    text = F.coalesce(F.when(cut, trim(F.col("text"), anchors)).otherwise(F.col("text")), F.lit(""))
    fed = kinds.join(dealt(documents, "tariff", "doctype"), ["tariff", "doctype"]).select("tariff", "variant", "filter", F.struct("ordinal", "doctype", text.alias("text")).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["text"]), "\n")  # the documents of one tariff
    joined = fed.groupBy("tariff", "variant", "filter").agg(whole.alias("source"))
    return joined.select("tariff", "variant", "filter", digits(F.col("source")).alias("source_digits"), F.lower("source").alias("source_low"))


def rescored(
    saved: DataFrame, documents: DataFrame, schema: dict, modules: list[str], anchors: str,
    guarded: list[tuple[str, str]] = GUARDED, required: dict[tuple[str, str], tuple[str, ...]] = REQUIRED,
) -> DataFrame:
    """A row for each saved run: name, tariff, model, variant, filter, run, schema_errors (five at most), claims (field, value,
    grounded), unsupported, required (field, there), modules (module, level), schema_ok, faithful.

    saved: name, body (JSON). documents: tariff, doctype, ordinal, text. Names that cannot be read and tariffs without any
    document are left out; a body that is no JSON object is a run that failed. A run whose documents are not there has an empty source.
    The model is the one that the record tells of, else the name's. Records meet the text of what was fed in one join, in which each text
    is one row however many runs it had.
    """
    named = saved.select("name", run_name(F.col("name")).alias("n"), F.try_parse_json("body").alias("record")).filter("n IS NOT NULL")
    runs = named.select("name", "n.*", *(c.alias(k) for k, c in _judged(F.col("record"), schema, modules, guarded, required).items()))
    runs = runs.join(documents.select("tariff").distinct(), "tariff", "left_semi")
    met = runs.join(fed_sources(runs, documents, anchors), ["tariff", "variant", "filter"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    held = lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value"), grounded_in(c["value"], empty("source_digits"), empty("source_low")).alias("grounded"))
    judged = met.withColumns({"claims": F.transform("claims", held), "schema_ok": F.size("schema_errors") == 0, "model": F.coalesce("spec", "model")})
    judged = judged.withColumn("unsupported", F.size(F.filter("claims", lambda c: ~c["grounded"])))
    faithful = F.col("schema_ok") & (F.col("unsupported") == 0) & F.forall("required", lambda r: r["there"])
    return judged.select("name", "tariff", "model", "variant", "filter", "run", "schema_errors", "claims", "unsupported", "required", "modules", "schema_ok", faithful.alias("faithful"))
