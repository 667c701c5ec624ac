"""Names, targets, echoes and sets where rows are odd: nulls, clashes, nothing at all."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.operators import intake, reports


def test_names_without_anything_known(spark):
    files = spark.createDataFrame([("avb.pdf",), ("AVBX_a b.pdf",), ("GmbH.pdf",), ("",), (None,)], "file string")
    got = files.select(intake.file_identity(F.col("file"), [("avb", "avb")], {}, ["gmbh"]).alias("f")).select("f.doctype", "f.stem").collect()
    assert [tuple(r) for r in got] == [("avb", "unbekannt__unbenannt"), (None, "avbx__a-b"), (None, "unbekannt__unbenannt"), (None, "unbekannt__unbenannt"), (None, "unbekannt__unbenannt")]


def test_targets_never_meet(spark):
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "a-2.pdf"), (4, "x/a.PDF"), (5, None)], "n long, name string")
    got = {r.n: r.target for r in intake.targets(docs, [], F.col("name"), ["n"]).collect()}
    assert (got[1], got[3], got[4], got[5]) == ("a.pdf", "a-2.pdf", "a-3.pdf", "unnamed.pdf")
    assert len(set(got.values())) == 5 and got[2].startswith("a-2-")


def test_paths_that_leave_their_folder_fail(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("..",)], "s string").select(intake.safe_segment(F.col("s"))).collect()


def test_an_echo_says_both_halves(spark):
    rows = [("arag__a-b", "ARAG", "A b"), ("arag__a-b", "ARAG SE", "A b"), ("arag__a-b", "ARAG", "A b c"), ("arag__a-b", None, None)]
    got = spark.createDataFrame(rows, "stem string, insurer string, tariff string").select(intake.echoes_stem(F.col("stem"), F.col("insurer"), F.col("tariff"))).collect()
    assert [r[0] for r in got] == [True, False, False, False]


def test_terms_twice_and_thrice(spark):
    rows = [("b", i, t, None, None) for i, t in enumerate(["AVB", "avb mehr", "avb noch", "Erstinformation", None])]
    got = intake.link_doctypes(spark.createDataFrame(rows, "bundle string, ordinal int, text string, url string, kind string"), {}).collect()
    assert sorted((r.ordinal, r.doctype) for r in got) == [(0, "avb"), (1, "avb_besondere"), (4, "weitere_unterlagen")]


def test_positions_and_what_is_none(spark):
    got = spark.createDataFrame([("3, 1,x,1 ,",), (None,)], "s string").select(intake.positions(F.col("s")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [([1, 3], ["x"]), ([], [])]


def test_nothing_ran(spark):
    none = spark.createDataFrame([], "stem string")
    assert reports.run_entry({"a": none, "b": none}).collect()[0].asDict() == {"a": 0, "b": 0}
    assert reports.tally(none, "stem", ["ok"]).collect()[0].asDict() == {"ok": 0, "total": 0}
    assert reports.compare_set(none, none, none).count() == 0
