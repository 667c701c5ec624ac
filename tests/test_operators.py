"""Operators on hand-made fixtures."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.operators import benchmark, dedup, history, merges, quality, ranking, resolve, series, snapshots, taxonomy, trimming
from ledgerloom.plans.views import TAXONOMY, numbered
from ledgerloom.sources import files, html, http, sinks
from ledgerloom.streaming import keyed_state

DAY = datetime.date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


# ranking


def test_ties_at_the_cut_are_announced(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("b", 0.5, 2), ("c", 0.5, 3), ("d", 0.4, 4)], "n string, pre_score double, position int")
    got = {r.n: r.mark for r in ranking.top_with_ties(df, 2, "pre_score", "position").collect()}
    assert got == {"a": "selected", "b": "selected", "c": "tied", "d": "dropped"}
    assert {r.mark for r in ranking.top_with_ties(df, 0).collect()} == {"selected"} == {r.mark for r in ranking.top_with_ties(df, 9).collect()}
    assert ranking.top_with_ties(df.limit(0), 2).count() == 0


def test_price_never_changes_the_total(spark):
    records = spark.createDataFrame([("s", 0.5, 0.5, 0.5), ("t", 1.0, 0.0, 0.5)], "stem string, leistung_cov double, module_breadth double, coverage_gen double")
    market = lambda p: spark.createDataFrame([("s", 1.0, 4.5, p, 1)], "stem string, note double, bewertung double, price double, position int")
    a, b = ({r.stem: r for r in ranking.rank(records, market(p)).collect()} for p in (5.0, 500.0))
    assert a["s"].total == b["s"].total and a["s"].value != b["s"].value and a["t"].price is None and a["t"].dim_bewertung == 0.5
    assert [r.stem for r in ranking.best_first(ranking.rank(records, market(1.0))).collect()] == ["s", "t"]


def test_low_confidence_and_shared(spark):
    df = spark.createDataFrame([("a", 10, "h"), ("b", 10, "h"), ("c", 3, "x"), ("d", 2, None), ("e", 2, None)], "stem string, n_categories int, input_hash string")
    assert {r.stem for r in ranking.low_confidence(df).filter("low_confidence").collect()} == {"d", "e"}
    assert ranking.low_confidence(df.filter("stem = 'd'")).filter("low_confidence").count() == 0
    assert rows(ranking.shared_documents(df)) == [("a", "h", 2), ("b", "h", 2)]


# snapshots


@pytest.fixture(scope="module")
def dupes(spark):
    return spark.createDataFrame([("k", 9.0, 1), ("k", 7.0, 2), ("k", 8.0, 3), ("z", None, 4), ("z", 0.0, 5)], "key string, price double, position int")


def test_which_duplicate_stays(dupes):
    assert rows(dedup.keep_cheapest(dupes, ["key"]), "key", "price") == [("k", 7.0), ("z", 0.0)]
    assert rows(dedup.keep_first(dupes, ["key"]), "key", "position") == [("k", 1), ("z", 4)]
    assert rows(dedup.keep_last(dupes, ["key"]), "key", "position") == [("k", 3), ("z", 5)]
    assert rows(dedup.representatives(dupes, "key"), "key", "position") == [("k", 2), ("z", 5)]


def test_tolerance_of_a_change(spark):
    of = lambda *r: spark.createDataFrame(r, "key string, price double, position int")
    old, new = of(("a", 1.0, 1), ("b", 1.0, 2), ("c", 1.0, 3), ("n", None, 4)), of(("a", 1.004, 1), ("b", 1.5, 2), ("d", 1.0, 3), ("n", 2.0, 4))
    change = lambda t, p="cheapest": {r.key: r.change for r in snapshots.difference(old, new, "key", "price", t, p).collect()}
    assert change(0.01) == {"a": "equal", "b": "changed", "c": "removed", "d": "added", "n": "equal"}
    assert change(0.0)["a"] == "changed" and change(0.0, "last")["b"] == "changed"
    assert rows(snapshots.comparison_counts(old, new, "key", "price")) == [(3, 2, 1, 1)]


def test_unchanged_ignores_places_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "position int, key string")
    assert snapshots.same_rows(a, a.withColumn("position", -F.col("position"))).first().unchanged
    assert not snapshots.same_rows(a, a.filter("position < 3")).first().unchanged


def test_snapshot_sink_appends_on_change_only(spark, tmp_path):
    rows_of = lambda *k: spark.createDataFrame([(i, x) for i, x in enumerate(k)], "position int, key string")
    path, schema = str(tmp_path / "s"), "position int, key string, date date"
    stored = spark.createDataFrame([], schema)
    assert sinks.snapshot_if_changed(rows_of("a", "b"), stored, "2024-01-01", path)
    read = lambda: spark.read.schema(schema).parquet(path)
    assert not sinks.snapshot_if_changed(rows_of("b", "a"), read(), "2024-01-02", path)
    assert sinks.snapshot_if_changed(rows_of("b", "a"), read(), "2024-01-02", path, force=True)
    assert sinks.snapshot_if_changed(rows_of("c"), read(), "2024-01-03", path)
    assert not sinks.snapshot_if_changed(rows_of("a", "b"), read(), "2024-01-02", path)  # held against the day before it
    assert read().select("date").distinct().count() == 3


# series


def test_pinned_band_and_gaps(spark):
    df = spark.createDataFrame(
        [("s", DAY(2024, 1, d), b, p) for d, b, p in [(1, "a", 1.0), (4, "a", 1.0), (1, "b", 5.0), (2, "b", 5.0), (3, "b", 5.002)]] + [("t", DAY(2024, 1, 1), "a", None)], "stem string, date date, band string, price double"
    )
    got = series.pinned_series(df)
    assert [(r.date.day, r.band, r.price) for r in got.filter("stem = 's'").orderBy("date").collect()] == [(1, "b", 5.0), (2, "b", 5.0), (3, "b", 5.002), (4, "b", None)]
    assert got.filter("stem = 't'").first().price is None and series.price_changes(got).count() == 0


def test_quartiles_are_nearest_rank(spark):
    df = spark.createDataFrame([("four", float(p)) for p in (4, 1, 3, 2)] + [("five", float(p)) for p in (1, 2, 2, 2, 9)] + [("none", None)], "d string, price double")
    assert rows(series.quartiles(df, ["d"])) == [("five", 2.0, 2.0, 2.0), ("four", 2.0, 3.0, 4.0), ("none", 0.0, 0.0, 0.0)]


# identity


def test_resolution_tiers(spark):
    manifest = spark.createDataFrame([("ALFA SE", "X", "alfa__x", 1), ("Bravo", "Y", "bravo__y", 2), ("Bravo Direct", "Y", "direct__y", 3), ("Romeo", "Z", "romeo__z", 4)], "insurer string, product string, stem string, ordinal int")
    asked = spark.createDataFrame([("1", "alfa se", "x"), ("2", "ALFA", "X"), ("3", "Direct", "Y"), ("4", "All", "Y"), ("5", "Zulu", "Z")], "row_id string, insurer string, product string")
    assert rows(resolve.resolve(asked, manifest)) == [("1", "alfa__x", "exact"), ("2", "alfa__x", "loose"), ("3", "direct__y", "loose"), ("4", None, "none"), ("5", None, "none")]


def test_ratings_match_whole_words(spark):
    records = spark.createDataFrame([("oealfa__x", "OEALFA"), ("alfa__x", "ALFA")], "stem string, insurer string")
    ratings = spark.createDataFrame([("insurer", "alfa", "s", "b")], "scope string, subject string, source string, badge string")
    aliases = spark.createDataFrame([], "stem string, alias_of string")
    assert rows(resolve.ratings_for(records, ratings, aliases), "stem") == [("alfa__x",)]


def test_missing_values_sort_as_stated(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0), (2, "b", 1.0, None), (3, "c", 2.0, 1.0)], "position int, insurer string, price double, bewertung double")
    order = lambda c, up: [r.position for r in resolve.sort_market(df, c, up).collect()]
    assert order("price", True) == [2, 3, 1] and order("price", False) == [1, 3, 2] and order("bewertung", False) == [1, 3, 2] and order("bewertung", True) == [3, 1, 2]


# history


def test_versions_and_changes(spark):
    states = [("s", DAY(2024, 1, 1), "2024", ["a"]), ("s", DAY(2024, 1, 2), "2024", ["a"]), ("s", DAY(2024, 1, 3), "2025", ["a"]), ("s", DAY(2024, 1, 4), "2025", ["b"])]
    df = spark.createDataFrame(states, "stem string, date date, stand string, items array<string>").withColumn("content_sha256", F.sha2(F.concat("stand", F.array_join("items", ",")), 256))
    versions = history.changed_versions(df)
    assert [r.supersedes for r in versions.orderBy("date").collect()] == [None, DAY(2024, 1, 1), DAY(2024, 1, 3)]
    log = history.list_changelog(versions, "items")
    assert rows(log, "added", "removed") == [(["b"], ["a"])]  # the stand is in the digest, not in the difference
    asked = spark.createDataFrame([("s", DAY(2024, 1, 3)), ("s", DAY(2023, 1, 1))], "stem string, as_of date")
    assert {r.as_of: r.stand for r in history.state_as_of(versions, asked).collect()} == {DAY(2024, 1, 3): "2025", DAY(2023, 1, 1): None}


def test_late_states_meet_their_own_predecessor(spark):
    of = lambda *r: spark.createDataFrame(r, "stem string, date date, content_sha256 string")
    past = of(("s", DAY(2024, 1, 1), "x"), ("s", DAY(2024, 1, 9), "y"))
    assert history.append_changed(past, of(("s", DAY(2024, 1, 5), "x"))).count() == 0
    got = history.append_changed(past, of(("s", DAY(2024, 1, 9), "z"), ("t", DAY(2024, 1, 1), "n")))
    assert {r.stem: (r.supersedes, r.replaced) for r in got.collect()} == {"s": (None, True), "t": (None, False)}
    assert history.append_changed(past, of(("s", DAY(2024, 1, 10), "z"))).first().supersedes == DAY(2024, 1, 9)


def test_hash_ignores_the_order_of_lists_and_keys(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) m, map('b', 2, 'a', 1) n, array('x', 'y') l, array('y', 'x') r, 's' s")
    digest = lambda m, x: history.content_hash(F.col("s"), F.col(m), F.lit(None), F.lit(None), F.col(x))
    r = df.select(digest("m", "l").alias("a"), digest("n", "r").alias("b")).first()
    assert r.a == r.b


def _streamed(spark, folder, batches, schema, of):
    for batch in batches:
        df = spark.createDataFrame(batch, schema)
        df.write.mode("append").parquet(f"{folder}/in")
        keyed_state.drained(of(spark.readStream.schema(df.schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/check")
    return spark.read.parquet(f"{folder}/out")


SEEN = lambda d: datetime.datetime(2024, 2, d)


def test_stream_of_versions_equals_batch(spark, tmp_path):
    """In order, late with corrections of the same day, and all of it again."""
    first = [(s, DAY(2024, 1, d), "ab"[(s * d) % 3 % 2], SEEN(1)) for s in range(4) for d in range(1, 12, 2)]
    late = [(s, DAY(2024, 1, d), "abc"[(s + d) % 3], SEEN(2)) for s in range(5) for d in (2, 3, 8, 11)]
    log = _streamed(spark, tmp_path, [first, late, first + late], "stem long, day date, items string, seen timestamp", keyed_state.versions)
    union = {(s, d): (s, d, i) for s, d, i, _ in first + late}
    want = history.changed_versions(spark.createDataFrame(list(union.values()), "stem long, day date, items string"), date="day", digest="items")
    assert rows(keyed_state.current_versions(log), "stem", "day", "items", "supersedes") == rows(want, "stem", "day", "items", "supersedes")
    assert log.agg({"turn": "max"}).first()[0] == 2  # the third batch said nothing
    assert {r.kind for r in log.collect()} == {"version", "correction", "withdrawn"}


def test_stream_of_versions_forgets(spark, tmp_path):
    day = lambda m, d: DAY(2024, m, d)
    batches = [
        [(1, day(1, 1), "a", SEEN(1)), (1, day(1, 5), "b", SEEN(1)), (1, day(1, 9), "b", SEEN(1)), (1, day(1, 20), "c", SEEN(1))],
        [(2, day(1, 1), "x", datetime.datetime(2024, 4, 1))],  # the watermark passes
        [(1, day(1, 2), "z", datetime.datetime(2024, 4, 2)), (1, day(3, 25), "b", datetime.datetime(2024, 4, 2))],
    ]
    log = _streamed(spark, tmp_path, batches, "stem long, day date, items string, seen timestamp", lambda s: keyed_state.versions(s, horizon=10, delay="1 day"))
    assert [(r.day, r["items"]) for r in log.filter("kind = 'late'").collect()] == [(day(1, 2), "z")]
    last = log.filter("stem = 1 AND kind <> 'late' AND turn = 2").collect()
    assert [(r.day, r["items"], r.supersedes) for r in last] == [(day(3, 25), "b", day(1, 20))]


def test_stream_of_prices_equals_batch(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    first = [(1, at(1), 2.0), (1, at(5), 1.5), (2, at(5), 3.0), (2, at(6), None), (2, at(9), 3.004)]
    late = [(1, at(3), 1.5), (1, at(3), 1.7), (1, at(6), 1.501), (2, at(7), 3.5), (1, at(20), 9.0)]
    end = [(None, datetime.datetime(2025, 1, 1), None)]
    events = _streamed(spark, tmp_path, [first, late, late + first, end], "stem long, at timestamp, price double", lambda s: keyed_state.price_events(s, delay="60 days"))
    lowest = {(s, t.date()): (s, t.date(), min(q for k, u, q in first + late if (k, u) == (s, t) and q)) for s, t, p in first + late if p}
    want = series.price_changes(spark.createDataFrame(list(lowest.values()), "stem long, date date, price double")).withColumnRenamed("date", "day")
    assert rows(events, "stem", "day", "old_price", "new_price") == rows(want, "stem", "day", "old_price", "new_price")
    assert events.count() == 4


# taxonomy, trimming


def test_first_category_wins(spark):
    df = spark.createDataFrame([("Large BOLT",), ("large gizmo",), ("gizmo",), ("",), (None,)], "t string")
    assert [r.c for r in df.select(taxonomy.classify(F.col("t"), TAXONOMY).alias("c")).collect()] == ["fastener", "size", None, None, None]


@pytest.mark.parametrize(
    ("text", "context", "want"),
    [("a\nb\nHIT\nc\nd", 1, "[…]\nb\nHIT\nc\n[…]"), ("HIT\na\nb\nc\nHIT", 1, "HIT\na\n[…]\nc\nHIT"), ("HIT\na\nb\nHIT", 1, "HIT\na\nb\nHIT"), ("a\nb", 1, "[…]"), ("x\r\nHIT\r\n", 0, "[…]\nHIT"), ("Anschluß", 0, "Anschluß")],
)
def test_window_trim(spark, text, context, want):
    got = spark.createDataFrame([(text,)], "t string").select(trimming.window_trim(trimming.lines(F.col("t")), "hit|anschluss", context).alias("x")).first().x
    assert got == want


def test_trim_choices(spark):
    one = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first().x
    sections = "intro\n§ 1 a\nfoo\n§ 2 b\nhit here\n§ 3 c\nbar"
    assert one(sections, trimming.section_trim(F.col("t"), "hit")) == "[…]\n§ 2 b\nhit here\n[…]"
    assert one("plain\n" * 50, trimming.trim(F.col("t"), "hit")) == "plain\n" * 50
    dense = "\n".join(["hit"] + ["x" * 20] * 11)
    assert len(one(dense, trimming.trim(F.col("t"), "hit"))) == 91
    assert len(one(dense, trimming.trim_to_budget(F.col("t"), "hit", 60))) == 49
    # The narrowest window falls under the floor, where the sections, which keep all, are left.
    assert one(dense, trimming.trim_to_budget(F.col("t"), "hit", 30)) == dense


# merges, rules, benchmarks


def test_overlay_refuses_and_notes(spark):
    records = spark.sql("SELECT 's' stem, map('m', named_struct('included', true, 'level', CAST(NULL AS STRING)), 'n', named_struct('included', false, 'level', CAST(NULL AS STRING)), 'p', named_struct('included', true, 'level', 'Basis')) modules, CAST(NULL AS DOUBLE) premium_month, CAST(NULL AS DOUBLE) premium_year, '300' deductible")
    schema = "stem string, premium_month double, premium_year double, has_premium boolean, levels map<string,string>, deductible string"
    lay = lambda *o: merges.overlay(records, spark.createDataFrame([o], schema)).first()
    good = lay("s", None, 120.0, True, {"m": "Premium"}, "150")
    assert (good.premium_month, good.deductible, good.original_deductible, good.modules["m"].level, good.violations) == (10.0, "150", "300", "Premium", [])
    assert good.overlay_fields == ["coverage.deductible", "modules.m.level", "premium"] and good.notes == ["deductible superseded"]
    assert lay("t", 1.0, None, True, None, None).violations == ["no record"] and lay("s", None, None, True, None, None).violations == ["empty premium"]
    assert lay("s", 1.0, 99.0, True, {"q": "x"}, None).violations == ["module unknown q"] and lay("s", 1.0, 99.0, True, None, None).notes == ["premium mismatch"]
    assert lay("s", None, None, False, {"n": "x", "p": "x"}, None).violations == ["module not included n", "level already set p"]
    with pytest.raises(PySparkException, match="no record"):
        merges.all_or_nothing(merges.overlay(records, spark.createDataFrame([("t", 1.0, None, True, None, None)], schema))).collect()


def test_lists_unite_by_their_first_spelling(spark):
    runs = spark.createDataFrame([("s", 1, 9, ["Mediation"]), ("s", 2, 20, ["MEDIATION", "Kaution"])], "stem string, run int, size int, items array<string>")
    assert merges.merge_runs(runs).first()["items"] == ["MEDIATION", "Kaution"]
    two = spark.createDataFrame([(["Mediation", None, ""], ["MEDIATION", "Kaution"])], "a array<string>, b array<string>")
    assert two.select(merges.united_lists(F.col("a"), F.col("b")).alias("x")).first().x == ["Mediation", "Kaution"]


def test_rules(spark):
    values = [("eq", "x", "x", True), ("nonnull", "", "", False), ("nonnull", "[]", "", False), ("isnull", None, "", True), ("contains", "ABC", "bc", True), ("contains_all_digits", "1.503,00 EUR", "150|300", False), ("contains_all_digits", "150 / 300", "150|300", True), ("in", "a", "b|a", True), ("in", None, "b|a", False)]
    df = spark.createDataFrame(values, "k string, v string, e string, want boolean")
    assert all(r.got == r.want for r in df.select(quality.check(F.col("v"), F.col("k"), F.col("e")).alias("got"), "want").collect())
    with pytest.raises(PySparkException, match="unknown check"):
        df.select(quality.check(F.col("v"), F.lit("odd"), F.col("e"))).collect()


def test_attribution_passes_without_words(spark):
    df = spark.createDataFrame([("a", "Premium Flex", ["premium_flex.pdf"]), ("b", "Komfort Plus Basis", ["other_thing.pdf"]), ("c", "AVB", ["x9.pdf"]), ("d", "Komfort", ["AVB.pdf"])], "stem string, tariff string, files array<string>")
    assert {r.stem: r.ok for r in quality.attribution(df, ("avb",)).collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_grounding(spark):
    df = spark.createDataFrame([("12.500 EUR", "up to 12 500", True), ("99 EUR", "up to 12", False), ("Mediation", "with MEDIATION", True), ("5 x", "5 X y", True)], "v string, s string, want boolean")
    assert all(r.got == r.want for r in df.select(benchmark.grounded(F.col("v"), F.col("s")).alias("got"), "want").collect())


# sources and sinks


def test_records_prefer_enriched_and_skip_broken(spark, tmp_path):
    for folder, stem, text in (("pure", "a__x", '{"insurer": "A"}'), ("pure", "b__y", '{"insurer": "B"}'), ("pure", "bad", "{oops"), ("pure", "_note", "{}"), ("enriched", "a__x", '{"insurer": "A+"}')):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{stem}.json").write_text(text)
    assert rows(files.records(spark, f"{tmp_path}/pure", f"{tmp_path}/enriched"), "stem", "insurer") == [("a__x", "A+"), ("b__y", "B")]


def test_snapshots_by_their_names(spark, tmp_path):
    row = {"position": 1, "insurer": "A", "product": "P", "monatlich_eur": 1.5, "key": "k"}
    for name in ("2024-01-01", "2024-01-02", "latest"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"tariffs": [row, row]}))
    got = files.snapshots(spark, str(tmp_path))
    assert got.count() == 4 and rows(snapshots.latest(got).select("date").distinct()) == [(DAY(2024, 1, 2),)]


def test_delimited_rows(spark, tmp_path):
    (tmp_path / "a.psv").write_text("# head\n1|A  B|P|1,0|12,90 EUR|150\n")
    assert rows(files.delimited_rows(spark, str(tmp_path / "a.psv")), "monatlich_eur", "key") == [(12.9, "A B|P|150")]


def test_manifest_and_payloads(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"tariffs": [{"stem": "s", "docs": [{"doctype": "avb", "file": "f"}, {"doctype": "pib", "file": "g"}]}]}))
    index = files.document_index(files.manifest(spark, str(tmp_path / "m.json")))
    assert rows(index, "stem", "doctype", "file_name") == [("s", "avb", "f"), ("s", "pib", "g")]
    docs = index.select("stem", "doctype", F.col("file_name").alias("text"))
    assert files.payloads(docs, "H").first().payload == "H\n\n=== avb ===\nf\n\n=== pib ===\ng"


def test_binary_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.txt").write_bytes(b"hello")
    found = files.binary_documents(spark, str(tmp_path))
    assert rows(found, "is_pdf", "length") == [(False, 5), (True, 10)]
    seen = found.filter("is_pdf").select("path", F.col("modificationTime").alias("seen"))
    assert files.binary_documents(spark, str(tmp_path), seen).count() == 1


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "head<li>a=1;b=x&amp;y|<li>a=2;<li>a=3;b= z |")], "id int, html string")
    got = html.rows(html.blocks(pages, "id", "html", "<li>"), "id", {"a": "a=([^;]*);", "b": "b=([^|]*)[|]"}, ["a", "b"])
    assert rows(got, "position", "a", "b") == [(1, "1", "x&y"), (2, "3", "z")]


class _Reply:
    def __init__(self, body, length):
        self.body, self.headers, self.status = body, {"Content-Length": length}, 200

    def read(self):
        return self.body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_fetch_tries_again(spark):
    replies = [_Reply(b"cut", "9"), OSError("down"), _Reply(b"whole", "5")]

    def opener(url, timeout):
        r = replies.pop(0)
        if isinstance(r, OSError):
            raise r
        return r

    assert http.fetch("u", attempts=5, pause=0, opener=opener) == ("u", 200, "whole", None, 3)
    assert http.fetch("u", attempts=1, pause=0, opener=lambda *a, **k: _Reply(b"x", "2"))[3] == "OSError: 1 of 2 bytes"
    spark.dataSource.register(http.HttpSource)
    got = spark.read.format("http_pages").option("urls", "http://127.0.0.1:1/x http://127.0.0.1:1/y").option("attempts", 1).load()
    assert rows(got, "url", "attempts") == [("http://127.0.0.1:1/x", 1), ("http://127.0.0.1:1/y", 1)] and got.filter("error IS NULL").count() == 0


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert {r.value for r in sinks.markdown(df, "T").collect()} == {"# T", "| x | y |", "|---|---|", "| a\\|b | – |"}


# what umlauts, cues and marks do


def test_ratings_join_umlaut_insurers(spark):
    records = spark.createDataFrame([("s-direkt__x", "ÖRAG"), ("arag__y", "ARAG"), ("gross__z", "Groß & Co")], "stem string, insurer string")
    ratings = spark.createDataFrame([("insurer", "OERAG", "a", "top"), ("insurer", "arag", "b", "fair"), ("insurer", "gross", "c", "any")], "scope string, subject string, source string, badge string")
    found = resolve.ratings_for(records, ratings, spark.createDataFrame([], "stem string, alias_of string"))
    assert sorted((r.stem, r.source) for r in found.collect()) == [("arag__y", "b"), ("gross__z", "c"), ("s-direkt__x", "a")]


def test_partial_cues(spark):
    given = ["nur im Inland", "eingeschr. Schutz", "Außer Haus", "ausser Haus", "teilweise", "bis zu 500", "optional", "nurmehr", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, item string")
    assert [r.c for r in df.orderBy("i").select(taxonomy.cell(F.col("item")).alias("c")).collect()] == ["~", "~", "~", "~", "~", "✓", "✓", "✓", "–"]


def test_generic_words_carry_no_identity(spark):
    rows = [("a", "Komfort AG", ["Allgemeine_Bedingungen_Basis.pdf"]), ("b", "Recht Komfort", ["Recht_und_mehr_Komfort.pdf"]), ("c", "Versicherung der AG", ["x.pdf"])]
    df = spark.createDataFrame(rows, "stem string, tariff string, files array<string>")
    assert {r.stem: (r.hits, r.wanted, r.ok) for r in quality.attribution(df).collect()} == {"a": (0, 1, False), "b": (2, 2, True), "c": (0, 0, True)}
    assert quality.attribution(df, ("recht",)).filter("stem = 'b'").first().wanted == 1


def test_reconcile_whole_records(spark):
    schema = "stem string, modules map<string,struct<included:boolean,level:string>>, coverage struct<sum:string,wait:int,outs:array<string>>, leistungen array<string>, insurer string, tariff string, stand string, beitrag double, _model string"
    on = lambda *keys: {k: (True, "x") for k in keys}
    prior = spark.createDataFrame([("a", on("m", "n"), ("1", 3, ["x"]), ["B", "★ a"], "Old", "T", "2023", 9.0, "old")], schema)
    fresh = spark.createDataFrame([("a", {"m": (True, "x"), "n": (False, None)}, ("", 3, []), ["A"], "", "New", None, 5.0, "new"), ("b", None, None, None, "I", "T", "2024", None, "new")], schema)
    got = {r.stem: r for r in merges.reconcile(prior, fresh, ["leistungen"]).collect()}
    a = got["a"]
    assert (a.leistungen, a.insurer, a.tariff, a.stand, a.beitrag, a._model, a.reconciled) == (["A", "B"], "Old", "New", "2023", None, "new", True)
    assert a.coverage.sum == "1" and a.modules["n"].included and a.changed == ["modules 1->2", "coverage 1->3", "leistungen 1->2", "insurer<-prior", "stand<-prior"]
    assert (got["b"].changed, got["b"].reconciled, got["b"].insurer) == ([], False, "I")


def test_structural_difference(spark):
    state = "struct<content_sha256:string,modules:map<string,struct<included:boolean,level:string>>,coverage:struct<sum:string,wait:int>,leistungen:array<string>,ausschluesse:array<string>,besonderheiten:array<string>>"
    old = ("h1", {"m": (True, "Basis"), "n": (True, None)}, ("1", 3), ["a", "b"], None, [])
    new = ("h2", {"m": (True, "Komfort"), "o": (False, None)}, ("1", None), ["b", "c"], ["x"], [])
    df = spark.createDataFrame([("s", old, new), ("t", old, ("h1", *new[1:]))], f"stem string, old {state}, new {state}")
    got = [(r.stem, r.section, r.name, r.old, r.new) for r in history.structural_difference(df, ["sum", "wait"]).collect()]
    assert sorted(got, key=str) == sorted([
        ("s", "modules", "m", '{"included":true,"level":"Basis"}', '{"included":true,"level":"Komfort"}'), ("s", "modules", "n", '{"included":true}', "{}"), ("s", "modules", "o", "{}", '{"included":false}'),
        ("s", "coverage", "wait", "3", None), ("s", "leistungen", "added", None, "c"), ("s", "leistungen", "removed", "a", None), ("s", "ausschluesse", "added", None, "x"),
    ], key=str)


def test_verdicts_against_pages(spark):
    schema = "scope string, subject string, url string, stand string, evidence array<string>"
    rows = [("tariff", "a-b__x", "u1", "2024-01-01", None), ("tariff", "a__x", "u1", "2024-02-01", ["Sehr gut"]), ("insurer", "c/d", "u1", "2024-03-01", ["A B"]), ("insurer", "gone", "u1", "2024-02-01", None), ("insurer", "e", "u2", "2024-02-01", []), ("insurer", "f", None, "2024-02-01", None)]
    pages = spark.createDataFrame([("u1", "Test: A B ist SEHR GUT", "2024-02-01")], "url string, plain string, page_stand string")
    got = {r.subject: (r.state, r.missing) for r in quality.verdict_states(spark.createDataFrame(rows, schema), pages).collect()}
    assert got == {"a-b__x": ("pending", []), "a__x": ("ok", []), "c/d": ("review", []), "gone": ("review", ["gone"]), "e": ("failed", None)}
    assert {r.url: r.stand for r in quality.newest_stands(spark.createDataFrame(rows, schema)).collect()} == {"u1": "2024-03-01", "u2": "2024-02-01"}


def test_bundles_name_their_insurer(spark):
    schema = "stem string, insurer string, docs array<struct<file:string,url:string>>"
    rows = [("a", "ÖRAG", [("Bedingungen_Oerag", "u")]), ("b", "ARAG SE", [("Provinzial", "http://x/arag/1")]), ("c", "ARAG SE", [("Provinzial", None)]), ("d", "DMB", [("x", "y")]), ("e", None, None)]
    assert {r.stem: r.fits for r in quality.bundle_fits(spark.createDataFrame(rows, schema)).collect()} == {"a": True, "b": True, "c": False, "d": True, "e": True}


def test_shape_errors(spark):
    values = spark.createDataFrame([("s", "a", "string", "x"), ("s", "b", "null", None), ("s", "c", "number", "1"), ("s", "z", "string", "y"), ("t", "a", "null", None)], "stem string, path string, kind string, value string")
    declared = spark.createDataFrame([("a", "string", True), ("b", "string?", False), ("c", "string", False), ("d", "array", True)], "path string, kind string, required boolean")
    got = sorted((r.stem, r.path, r.message) for r in quality.shape_errors(values, declared).collect())
    assert got == [("s", "c", "number is not string"), ("s", "d", "is required"), ("s", "z", "is not declared"), ("t", "a", "null is not string"), ("t", "d", "is required")]
    assert quality.shape_errors(values, declared, 1).count() == 2


def test_only_equivalent_is_linear_and_the_same(spark):
    import collections
    import random

    rng = random.Random(3)
    names = [(f"s{i}", rng.choice("ABCD"), rng.choice("pqrstuvw")) for i in range(30)]
    got = {r.stem: r.equivalent for r in resolve.only_equivalent(spark.createDataFrame(names, "stem string, insurer string, product string")).collect()}
    others = collections.defaultdict(list)
    for s, i, p in names:
        others[s] = [t for t, j, q in names if q == p and j != i]
    assert got == {s: o[0] for s, o in others.items() if len(o) == 1}


def test_needs_are_neutral():
    from ledgerloom.functions import scores

    assert scores.needs_are_neutral({}, ["a", "b"]) and scores.needs_are_neutral({"a": -1, "b": 0}, ["a", "b"]) and not scores.needs_are_neutral({"a": 2}, ["a", "b"])


def test_late_states_find_their_predecessor(spark, tmp_path):
    """The same arrivals as before the streams gave corrections: each batch of states, and what holds after it."""
    day = lambda n: DAY(2024, 1, n)
    batches = [[(day(3), "b"), (day(1), "a")], [(day(2), "a"), (day(4), "b")], [(day(2), "c")], [(day(5), "a")]]
    holds = [[(day(1), "a", None), (day(3), "b", day(1))]] * 2
    holds += [[(day(1), "a", None), (day(2), "c", day(1)), (day(3), "b", day(2))], [(day(1), "a", None), (day(2), "c", day(1)), (day(3), "b", day(2)), (day(5), "a", day(3))]]
    days = {}
    for rows_in, want in zip(batches, holds):
        days |= {keyed_state._number(d): i for d, i in rows_in}
        assert [(keyed_state._date(d), i, keyed_state._date(s)) for d, (i, s) in keyed_state.versions_of(days).items()] == want
    stamped = [[(7, d, i, SEEN(n)) for d, i in batch] for n, batch in enumerate(batches, 1)]
    log = _streamed(spark, tmp_path, stamped, "stem long, day date, items string, seen timestamp", keyed_state.versions)
    assert rows(keyed_state.current_versions(log), "day", "items", "supersedes") == holds[-1]
    assert [r.kind for r in log.filter("turn = 2").orderBy("day").collect()] == ["version", "correction"]


# the market of the test tables


def test_places_in_a_month_are_those_of_one_order_over_it(spark):
    months = [DAY(2001, 9, 1), DAY(2001, 10, 1), None]
    lines = [(months[i % 3], None if i % 11 == 0 else i * 7 % 40 - 5, i % 4, i, i % 5, 1.0, 2.0) for i in range(120)]
    df = spark.createDataFrame(lines, "date date, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double")
    got = {(r.date, r.position): r.l_partkey for r in numbered(df, 8).collect()}
    want = {}
    for month in months:
        mine = sorted((x for x in lines if x[0] == month), key=lambda x: (x[1] is not None, x[1] or 0, x[2:]))
        want |= {(month, i): x[3] for i, x in enumerate(mine, 1)}
    assert got == want and {r.position for r in numbered(df).filter("date IS NULL").collect()} == set(range(1, 41))
    assert numbered(df.limit(0)).count() == 0
