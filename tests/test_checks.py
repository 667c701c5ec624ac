"""Names by shared grams, nested shapes, canonical digests, sweeps and deliveries, on hand-made cases."""

import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.canonical import canonical_text, content_digest
from ledgerloom.operators import shapes, similar
from ledgerloom.operators.sweep import sweep
from ledgerloom.plans import checks
from ledgerloom.streaming import ingest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("least", "q"), [(0.4, None), (0.7, None), (0.8, 3), (1.0, 2)])
def test_similar_names_lose_no_pair(spark, least, q):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdü") for _ in range(rng.randint(1, 14)))
    asked = [word() for _ in range(40)] + ["", None, "aaaaaaaa"]
    known = asked[:15] + [w[:-1] for w in asked[:15]] + [word() for _ in range(60)] + [None, "", "aaaaaaa", "aaaaaaa"]
    want = {(a, k) for a in asked for k in known if a and k and 1 - distance(a, k) / max(len(a), len(k)) >= least}
    a, k = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((asked, "asked"), (known, "stem")))
    rows = [(r.asked, r.stem) for r in similar.similar_names(a, k, least, q).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_grams_must_be_able_to_tell(spark):
    assert [similar.gram_length(x) for x in (0.4, 0.66, 0.7, 0.8, 1.0)] == [1, 1, 2, 3, 3]
    d = spark.createDataFrame([("a",)], "asked string")
    with pytest.raises(ValueError, match="no grams"):
        similar.similar_names(d, d.toDF("stem"), 0.4, 3)


SCHEMA = {
    "type": "object", "required": ["name", "sources"], "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "pattern": "^[a-z]", "minLength": 2}, "list": {"type": "array", "minItems": 1, "items": {"type": ["string", "null"]}}, "n": {"type": "number", "minimum": 0, "maximum": 9}, "k": {"type": "integer"}, "c": {"const": 3},
        "deep": {"type": "object", "properties": {"it's": {"type": "object", "required": ["on"], "properties": {"on": {"type": "boolean"}, "level": {"enum": ["lo", None]}}}, "rows": {"type": "array", "items": {"type": "object", "required": ["id"]}}}},
    },
}


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ('{"name":"ab"}', []),
        ('{"name":"ab","n":3,"k":2.0,"c":3,"list":["x",null],"deep":{"it\'s":{"on":true,"level":null},"rows":[]}}', []),
        ('{"name":1}', [("name", "1 is not of type 'string'")]),
        ('{"name":"A"}', [("name", '"A" does not match \'^[a-z]\''), ("name", '"A" is too short')]),
        ('{}', [("<root>", "'name' is a required property")]),
        ('{"name":"ab","y":1,"x":null}', [("<root>", "Additional properties are not allowed: 'x', 'y'")]),
        ('{"name":"ab","list":[]}', [("list", "[] is too short")]),
        ('{"name":"ab","n":-1.5,"k":2.5,"c":4}', [("c", "4 is not one of [3]"), ("k", "2.5 is not of type 'integer'"), ("n", "-1.5 is beyond the minimum of 0")]),
        ('{"name":"ab","deep":{"it\'s":{"level":"mid"},"rows":[{"id":1},{},7]}}', [("deep/it's", "'on' is a required property"), ("deep/it's/level", '"mid" is not one of ["lo", null]'), ("deep/rows/1", "'id' is a required property"), ("deep/rows/2", "7 is not of type 'object'")]),
        ("[1]", [("<root>", "record is not a JSON object but array")]),
        ("7", [("<root>", "record is not a JSON object but integer")]),
        (None, [("<root>", "record is not a JSON object but null")]),
    ],
)
def test_nested_schema(spark, record, want):
    df = spark.createDataFrame([("s", record)], "stem string, j string").select("stem", F.parse_json("j").alias("record"))
    assert sorted((r.path, r.message) for r in shapes.schema_errors(df, SCHEMA, passed_over=("sources",)).collect()) == sorted(want)


def test_first_errors_by_path(spark):
    record = json.dumps({"name": "ab", "list": [1] * 12})
    df = spark.createDataFrame([("s", record)], "stem string, j string").select("stem", F.parse_json("j").alias("record"))
    assert [r.path for r in shapes.schema_errors(df, SCHEMA, passed_over=("sources",)).orderBy("path").collect()] == [f"list/{i}" for i in range(5)]
    with pytest.raises(ValueError, match="anyOf"):
        shapes.compiled({"anyOf": []}, F.col("record"))


def test_wrongly_typed_items_go_one_by_one(spark):
    df = spark.createDataFrame([('[{"a":1},2,null,"x",[{}],{"b":[]}]',), ('{"a":1}',), (None,), ("[]",)], "j string").select(F.parse_json("j").alias("v"))
    assert [r.n for r in df.select(F.transform(shapes.well_typed(F.col("v")), lambda x: F.to_json(x)).alias("n")).collect()] == [['{"a":1}', '{"b":[]}'], [], [], []]


def test_canonical_digest(spark):
    text = '{"stand": "2024", "coverage": {"b": 1, "a": "ü"}, "leistungen": ["b", "a"], "insurer": "x", "beitrag": {"m": 1.0}, "besonderheiten": [2, "a", null]}'
    fixed = '{"ausschluesse": null, "beitrag": {"m": 1.0}, "besonderheiten": ["a", 2, null], "coverage": {"a": "ü", "b": 1}, "leistungen": ["a", "b"], "modules": null, "stand": "2024"}'
    assert canonical_text(json.loads(text)) == fixed
    got = spark.createDataFrame([(text,), ("[1]",), ("{broken",), (None,), ("{}",)], "t string").select(content_digest(F.col("t")).alias("d")).collect()
    empty = '{"ausschluesse": null, "beitrag": null, "besonderheiten": null, "coverage": null, "leistungen": null, "modules": null, "stand": null}'
    assert [r.d for r in got] == [hashlib.sha256(fixed.encode()).hexdigest(), None, None, None, hashlib.sha256(empty.encode()).hexdigest()]


def test_sweep_checks_changed_records_alone(spark):
    kinds = "stem string, value int, digest string"
    old = spark.createDataFrame([("a", 1, "1"), ("b", 9, "9"), ("c", 9, "9"), ("d", 9, "9")], kinds)
    new = spark.createDataFrame([("a", 9, "9b"), ("b", 9, "9"), ("c", 2, "2"), ("e", 9, "9"), ("f", 8, None)], kinds)
    seen = []

    def check(records):
        seen.append(sorted(r.stem for r in records.collect()))
        return records.filter("value > 5").select("stem", F.lit("value").alias("path"))

    out = sweep(new, old.select("stem", "digest"), check(old), check)
    assert seen[1] == ["a", "c", "e", "f"]
    assert sorted(r.stem for r in out.violations.collect()) == ["a", "b", "e", "f"]
    assert sorted((r.stem, r.kind) for r in out.events.collect()) == [("a", "new"), ("c", "retracted"), ("d", "retracted"), ("e", "new"), ("f", "new")]
    again = sweep(new, out.marks, out.violations, check)
    assert seen[2] == ["f"] and again.events.count() == 0 and sorted(r.stem for r in again.violations.collect()) == ["a", "b", "e", "f"]


def _deliver(root, name, files):
    for ident, content in files.items():
        insurer, tariff, doctype = ident.split("/")
        folder = root / name / f"insurer={insurer}" / f"tariff={tariff}" / f"doctype={doctype}"
        os.makedirs(folder)
        (folder / "file.txt").write_bytes(content)


def test_ingest(spark, tmp_path):
    take = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    _deliver(tmp_path / "in", "1", {"i/t/a": b"one text\n", "i/t/b": b" \n", "i/t/c": b"", "i/t/d": b"%PDF-1.4 x", "i/t/e": b"\xff\xfe", "i/u/a": b"  one text"})
    take()
    found = ingest.log(spark, str(tmp_path / "out"))
    assert sorted((r.ident, r.text_chars) for r in ingest.manifest(found).collect()) == [("i/t/a", 8), ("i/u/a", 8)]
    assert {r.ident: r.reason for r in ingest.failures(found).collect()} == {"i/t/d": "no reader for PDF", "i/t/e": "no UTF-8"}
    assert [r.ident for r in ingest.without_text(found).collect()] == ["i/t/b"]
    assert sorted((r.ident, r.n) for r in ingest.copies(found).collect()) == [("i/t/a", 2), ("i/u/a", 2)]
    time.sleep(1.1)
    _deliver(tmp_path / "in", "2", {"i/t/a": b"one text\n", "i/t/e": b"now text", "i/u/a": b"changed"})
    (tmp_path / "in" / "2" / "loose.txt").write_bytes(b"x")
    take()
    again = ingest.log(spark, str(tmp_path / "out"))
    assert again.filter("batch = 1").count() == 3  # what is as it was says nothing
    assert {r.ident: r.content_sha256 for r in ingest.manifest(again).collect()} == {i: hashlib.sha256(t).hexdigest() for i, t in (("i/t/a", b"one text\n"), ("i/t/e", b"now text"), ("i/u/a", b"changed"))}
    assert sorted(r.reason for r in ingest.failures(again).collect()) == ["no reader for PDF", "not in its place"]
    assert ingest.copies(again).count() == 0
    take()
    assert ingest.log(spark, str(tmp_path / "out")).count() == again.count()


def test_bundles_are_the_files_in_them(spark, tmp_path):
    files = {"i/t/a": b"one text\n", "i/t/b": b" \n", "i/t/d": b"%PDF-1.4 x", "i/t/e": b"\xff\xfe", "i u+/t/a": b"  one text"}
    later = {"i/t/a": b"one text\n", "i/t/e": b"now text", "i u+/t/a": b"changed"}
    for n, delivery in enumerate((files, later)):
        rows = [(*k.split("/"), "file.txt", v) for k, v in delivery.items()]
        ingest.bundle(spark.createDataFrame(rows, "insurer string, tariff string, doctype string, name string, content binary"), f"{tmp_path}/bundled/{n}")
        _deliver(tmp_path / "single", str(n), {k.replace(" ", "%20").replace("+", "%2B"): v for k, v in delivery.items()})
        for kind in ("bundled", "single"):
            ingest.ingest(spark, f"{tmp_path}/{kind}", f"{tmp_path}/out_{kind}", f"{tmp_path}/check_{kind}", bundled=kind == "bundled")
    got = [sorted(map(str, ingest.log(spark, f"{tmp_path}/out_{k}").drop("path", "modified", "number").collect())) for k in ("bundled", "single")]
    assert got[0] == got[1] and len(got[0]) == 7


def test_deliveries_need_no_file_for_each_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "work_folder", lambda _: str(tmp_path))
    assert checks.ingest_stream(spark, "/root/testdata/sf0.001").count() == 200
    assert len([f for f in (tmp_path / "in").rglob("part-*") if f.is_file()]) < 20
