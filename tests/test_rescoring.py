"""Saved runs judged again."""

from ledgerloom.operators import benchmark, rescoring
from ledgerloom.plans.texts import ANCHORS
from pyspark.sql import functions as F

SCHEMA = {"type": "object", "required": ["coverage", "sources"], "additionalProperties": False, "properties": {"coverage": {"type": "object"}, "modules": {"type": "object"}, "beitrag": {"type": "object"}, "sources": {"type": "array", "minItems": 1}}}
GOOD = '{"coverage": {"versicherungssumme": "5 000 EUR", "geltungsbereich": "Weltweit", "vertragslaufzeit": 12}, "modules": {"m0": {"included": true, "level": "voll"}, "m1": {"included": false}}'


def test_rescored(spark):
    saved = [
        ("A~x~pib~none~m__r2", GOOD + "}"),
        ("A~x~pib~none~own", GOOD + ', "sources": [], "model_spec": "maker:own"}'),
        ("A~x~pib~none~extra", GOOD + ', "more": 1}'),
        ("A~x~avb~none~wrong", GOOD + ', "beitrag": {"monatlich_eur": 29.9, "jaehrlich_eur": null}}'),
        ("A~x~none~none~empty", GOOD + "}"),
        ("A~x~pib~none~list", "[1]"),
        ("A~x~pib~none~torn", '{"coverage": '),
        ("A~x~pib~none~null", None),
        ("A~y~pib~none~m", GOOD + "}"),  # no documents
        ("A~pib~none~m", GOOD + "}"),  # no name of a run
    ]
    docs = [("A / x", "pib", 0, "Summe 5.000 EUR, weltweit."), ("A / x", "avb", 1, None), ("A / x", "avb", 2, "Beitrag 1234")]
    found = rescoring.rescored(spark.createDataFrame(saved, "name string, body string"), spark.createDataFrame(docs, "tariff string, doctype string, ordinal int, text string"), SCHEMA, ["m0", "m1"], ANCHORS)
    got = {r.name.split("~")[-1]: r for r in found.collect()}
    assert set(got) == {"m__r2", "own", "extra", "wrong", "empty", "list", "torn", "null"}
    first = got["m__r2"]
    assert (first.tariff, first.model, first.run, first.schema_ok, first.unsupported, first.faithful) == ("A / x", "m", 2, True, 0, True)
    assert [tuple(m) for m in first.modules] == [("m0", "voll")]
    assert [tuple(c) for c in first.claims] == [("coverage.versicherungssumme", "5 000 EUR", True)]
    assert (got["own"].model, got["own"].faithful) == ("maker:own", True)
    assert (got["extra"].schema_ok, got["extra"].faithful) == (False, False)
    assert {c.field: c.grounded for c in got["wrong"].claims} == {"coverage.versicherungssumme": False, "beitrag.monatlich_eur": False}
    assert (got["empty"].unsupported, got["empty"].faithful) == (1, False)
    for broken in ("list", "torn", "null"):
        r = got[broken]
        assert (r.schema_ok, r.unsupported, r.required, r.modules, r.faithful, len(r.schema_errors)) == (False, 0, [], [], False, 1)


def test_numbers_with_spaces_are_one(spark):
    rows = [("5 000 EUR", "5.000", True), ("5 000 EUR", "5 und 000", True), ("150/300 EUR", "150", False), ("1.500,00", "1500,00", True), ("7", "nichts", False), ("  Weltweit ", "gilt weltweit", True)]
    frame = spark.createDataFrame(rows, "v string, s string, want boolean")
    assert frame.filter(benchmark.grounded(F.col("v"), F.col("s")) != F.col("want")).count() == 0


def test_only_long_conditions_are_fed_trimmed(spark):
    text = "\n".join(["Nichts"] * 40 + ["Der Selbstbehalt ist 250 Euro."] + ["Nichts"] * 40 + ["Zahl 987654"])
    docs = [("T", "avb", 0, text), ("T", "pib", 1, text)]
    runs = spark.createDataFrame([("T", "avb", "none"), ("T", "avb", "cut"), ("T", "pib", "cut"), ("T", "avb+pib", "cut")], "tariff string, variant string, filter string")
    fed = rescoring.fed_sources(runs, spark.createDataFrame(docs, "tariff string, doctype string, ordinal int, text string"), "selbstbehalt")
    digits = {(r.variant, r.filter): r.source_digits for r in fed.collect()}
    assert digits == {("avb", "none"): "250987654", ("avb", "cut"): "250", ("pib", "cut"): "250987654", ("avb+pib", "cut"): "250250987654"}
