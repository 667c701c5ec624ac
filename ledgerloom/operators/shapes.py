"""JSON Schema documents compiled into columns over VARIANT: what a record breaks, at whatever depth.

The keywords type, enum, const, required, properties, additionalProperties (false), items, minItems, minimum, maximum, minLength and
pattern are understood; ``$``-keywords and descriptions are passed over, and any other is refused, so that no rule is silently left out.
A record is judged in one expression; nothing is exploded but what it breaks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SAYS_NOTHING = {"title", "description", "default", "examples", "format"}
_KNOWN = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "minimum", "maximum", "minLength", "pattern"}
_ERROR = "array<struct<place:array<string>,message:string>>"


def json_type(value: Column) -> Column:
    """object, array, string, boolean, null, integer or number; a number without a fraction is an integer."""
    t, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    return (
        F.when(F.startswith(t, F.lit("OBJECT")), "object").when(F.startswith(t, F.lit("ARRAY")), "array").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when((t == "BIGINT") | (F.floor(number) == number), "integer").otherwise("number")
    )


def _member(value: Column, name: str) -> Column:
    """A member of an object; null where it is not there."""
    if "'" in name and '"' in name:
        raise ValueError(f"a name with both kinds of quotes: {name}")
    return F.try_variant_get(value, f"$['{name}']" if "'" not in name else f'$["{name}"]', "variant")


def _said(place: Column, message: Column, broken: Column) -> Column:
    one = F.array(F.struct(place.alias("place"), message.alias("message")))
    return F.when(F.coalesce(broken, F.lit(False)), one).otherwise(F.array().cast(_ERROR)).cast(_ERROR)


def compiled(schema: dict, value: Column, place: Column | None = None) -> Column:
    """array<struct<place, message>>: what ``value``, a VARIANT, breaks of the schema. Places are member names and numbers of items."""
    unknown = {k for k in schema if not k.startswith("$")} - _KNOWN - _SAYS_NOTHING
    if unknown or schema.get("additionalProperties", True) not in (True, False):
        raise ValueError(f"keywords that are not understood: {sorted(unknown) or ['additionalProperties']}")
    place = F.array().cast("array<string>") if place is None else place
    kind, text, number, string = json_type(value), F.to_json(value), F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    is_number, parts = kind.isin("integer", "number"), []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = kind.isin(*names, *(["integer"] if "number" in names else []))
        parts.append(_said(place, F.concat(text, F.lit(" is not of type " + ", ".join(f"'{n}'" for n in names))), ~fits))
    if "enum" in schema or "const" in schema:
        allowed = schema["enum"] if "enum" in schema else [schema["const"]]
        parts.append(_said(place, F.concat(text, F.lit(" is not one of " + json.dumps(allowed, ensure_ascii=False))), ~text.isin(*(json.dumps(a, ensure_ascii=False, separators=(",", ":")) for a in allowed))))
    for keyword, short in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m)):
        if keyword in schema:
            parts.append(_said(place, F.concat(text, F.lit(f" is beyond the {keyword} of {schema[keyword]}")), is_number & short(F.lit(float(schema[keyword])))))
    if "minLength" in schema:
        parts.append(_said(place, F.concat(text, F.lit(" is too short")), (kind == "string") & (F.char_length(string) < schema["minLength"])))
    if "pattern" in schema:
        parts.append(_said(place, F.concat(text, F.lit(f" does not match '{schema['pattern']}'")), (kind == "string") & ~F.regexp_like(string, F.lit(schema["pattern"]))))
    if "minItems" in schema:
        parts.append(_said(place, F.concat(text, F.lit(" is too short")), (kind == "array") & (F.size(F.try_variant_get(value, "$", "array<variant>")) < schema["minItems"])))
    for name in schema.get("required", []):
        parts.append(_said(place, F.lit(f"'{name}' is a required property"), (kind == "object") & _member(value, name).isNull()))
    properties = schema.get("properties", {})
    if schema.get("additionalProperties", True) is False:
        extra = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, properties)).cast("array<string>"))
        names = F.array_join(F.transform(F.array_sort(extra), lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
        parts.append(_said(place, F.concat(F.lit("Additional properties are not allowed: "), names), (kind == "object") & (F.size(extra) > 0)))
    nothing = F.array().cast(_ERROR)
    for name, sub in properties.items():
        child = _member(value, name)
        parts.append(F.when((kind == "object") & child.isNotNull(), compiled(sub, child, F.concat(place, F.array(F.lit(name))))).otherwise(nothing))
    if isinstance(schema.get("items"), dict):
        inner = lambda x, i: compiled(schema["items"], x, F.concat(place, F.array(F.lpad(i.cast("string"), 9, "0"))))
        parts.append(F.when(kind == "array", F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), inner))).otherwise(nothing))
    return F.concat(*parts) if parts else nothing


def first_errors(v: Column, schema: dict, most: int = 5, passed_over: tuple[str, ...] = ()) -> Column:
    """array<struct<path, message>>: the first ``most`` errors of a VARIANT, by path.

    Members named in ``passed_over`` need not be there. What is no object has one error, at ``<root>``; null is none.
    Paths join names and numbers of items by ``/``.
    """
    judged = {**schema, "required": [r for r in schema.get("required", []) if r not in passed_over]}
    root = F.array(F.struct(F.array().cast("array<string>").alias("place"), F.concat(F.lit("record is not a JSON object but "), F.when(v.isNull(), "null").otherwise(json_type(v))).alias("message"))).cast(_ERROR)
    found = F.when(v.isNotNull() & (json_type(v) == "object"), compiled(judged, v)).otherwise(root)
    shown = lambda place: F.array_join(F.transform(place, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")), "/")
    path = lambda place: F.when(F.size(place) == 0, "<root>").otherwise(shown(place))
    return F.transform(F.slice(F.array_sort(found), 1, most), lambda e: F.struct(path(e["place"]).alias("path"), e["message"].alias("message")))


def schema_errors(records: DataFrame, schema: dict, key: str = "stem", value: str = "record", most: int = 5, passed_over: tuple[str, ...] = ()) -> DataFrame:
    """key, path, message: the first ``most`` errors of each record, as ``first_errors`` gives them. ``value`` is a VARIANT."""
    found = records.select(key, F.explode(first_errors(F.col(value), schema, most, passed_over)).alias("e"))
    return found.select(key, "e.path", "e.message")


def well_typed(values: Column, kind: str = "object") -> Column:
    """The items of a VARIANT that are of one JSON type, in order; nothing where it is no array."""
    return F.filter(F.coalesce(F.try_variant_get(values, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: json_type(x) == kind)
