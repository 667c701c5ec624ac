"""Scalars on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import display, replies, scores, text


@pytest.fixture
def value(spark):
    """One value through a column function."""

    def run(f, x, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y

    return run


@pytest.mark.parametrize(("s", "want"), [("12,90 EUR", 12.9), ("1.234,56", 1234.56), ("5,00 €", 5.0), ("", None), ("abc", None), ("-5,00", 5.0), (None, None)])
def test_money(value, s, want):
    assert value(text.money, s) == want


@pytest.mark.parametrize(("s", "want"), [("1,0", 1.0), (" 2,3 ", 2.3), ("", None), ("n/a", None), (None, None)])
def test_grade(value, s, want):
    assert value(text.grade, s) == want


@pytest.mark.parametrize(("n", "want"), [(1.0, 1.0), (1.75, 0.5), (2.5, 0.0), (3.0, 0.0), (None, 0.0)])
def test_grade_score(value, n, want):
    assert math.isclose(value(scores.grade_score, n, "double"), want)


@pytest.mark.parametrize(("n", "want"), [(4.5, 1.0), (3.5, 0.0), (9.0, 1.0), (None, 0.5)])
def test_rating_score(value, n, want):
    assert math.isclose(value(scores.rating_score, n, "double"), want)


def test_generosity(spark):
    rows = [(None, None, None, 0.5), ("Unbegrenzt", 0, "weltweit", 1.0), ("1 Mio", 3, "Europa", (0.5 + 0.5 + 0.6) / 3), ("", 4, "Mars", (0.5 + 0 + 0.3) / 3)]
    df = spark.createDataFrame(rows, "a string, b int, c string, want double")
    for r in df.select(scores.generosity(F.col("a"), F.col("b"), F.col("c")).alias("got"), "want").collect():
        assert math.isclose(r.got, r.want)


def test_breadth_with_needs(spark):
    df = spark.sql("SELECT map('m0', named_struct('included', true, 'level', 'Premium'), 'm1', named_struct('included', false, 'level', NULL)) AS m")
    get = lambda c: df.select(c.alias("x")).first().x
    m = F.col("m")
    assert get(scores.breadth(m, ["m0", "m1"])) == 0.5 == get(scores.breadth(m, ["m0", "m1"], {"m0": 2.0, "m1": 2.0}))
    assert get(scores.breadth(m, ["m0", "m1"], {"m0": 3.0, "m1": -5.0})) == 1.0 and get(scores.breadth(m, ["m0"], {"m0": 0.0})) == 0.0
    assert get(scores.tier(m, ["m0", "m1"])) == 0.5 and get(scores.included_count(m)) == 1


@pytest.mark.parametrize(("row", "want"), [((3, 3, 3, 3, 0, 8, 8), 100.0), ((3, 3, 3, 1, 2, 8, 8), 50 / 3 + 20 + 5 + 15), ((3, 0, 0, 0, 0, 0, 8), 0.0)])
def test_scorecard(spark, row, want):
    df = spark.createDataFrame([row], "a int, b int, c int, d int, e int, f int, g int")
    assert math.isclose(df.select(scores.scorecard(*map(F.col, "abcdefg")).alias("s")).first().s, want)


@pytest.mark.parametrize(
    ("f", "s", "want"),
    [
        (text.slug, "Ärger & Größe GmbH!", "aerger-groesse-gmbh"), (text.url_slug, "A%20B+c", "a-b-c"), (text.squeezed, " a  b\n c ", "a b c"), (text.squeezed, None, ""),
        (text.item_key, "• Mediation®  AUCH", "mediation auch"), (text.item_key, "★✗– Groß\u00a0 X", "gross x"), (text.item_key, "* A", "* a"), (text.vowel_folded, "Ölß", "olss"), (text.sharp_s_folded, "Ausschluß", "Ausschluss"),
        (text.file_of_url, "https://h/a/b%20c.pdf?x=1", "b c"), (text.file_token, "a b/c:d", "a_b_c_d"), (text.unfenced, "```json\n{}\n```", "{}"),
        (text.short_sum, "1 000 000,50", "1 Mio."), (text.short_sum, "unbegrenzt", "unbegrenzt"), (text.short_sum, None, "k.A."), (text.short_sum, "750", "750"),
        (text.short_deductible, "ohne", "ohne €"), (text.short_term, "1, 2, 3 oder 5 Jahre", "1/2/3/5 J."), (text.link, 'a"[b]', "a%22%5Bb%5D"), (text.link, None, ""),
        (text.html_text, "<script>x</script><p>a &amp; b</p>c", "a & b c"), (text.dehyphenated, "Versicherungs-\nsumme A-\nB", "Versicherungssumme A-\nB"),
    ],
)
def test_texts(value, f, s, want):
    assert value(f, s) == want


def test_lists_of_tokens(value):
    assert value(text.number_tokens, "1.503,00 EUR, 150 / 300, 1 000 000,50") == ["1503", "150", "300", "1000000"]
    assert value(lambda c: text.first_numbers(c, 2), "1, 1, 2, 3") == ["1", "2"]
    assert value(lambda c: text.identity_tokens(c, ("avb",)), "AVB Größe-XL 2") == ["groe", "xl"]
    assert sorted(value(lambda c: text.word_set(c), "ALFA alfa__x-1")) == ["1", "alfa", "x"]
    assert value(lambda c: text.word_set(c, F.lit("s-direkt__Öl")), "ÖRAG Groß") == ["oerag", "gross", "s", "direkt", "l"]
    assert str(value(text.newest_date, "am 2024-01-05, 07.02.2024 und 3. März 2024")) == "2024-03-03"
    assert value(lambda c: text.query_string(text.with_param(text.query_pairs(c), "a", F.lit("9"))), "h?a=1&b=2&a=3") == "b=2&a=9"


def test_display(value, spark):
    assert value(display.sparkline, [1.0, None, 8.0], "array<double>") == "▁·█" and value(display.sparkline, [2.0, 2.0], "array<double>") == "▅▅"
    assert value(lambda c: display.bar(c, 4), 0.5, "double") == "██░░" and value(lambda c: display.lerp_hex("#000000", "#ffffff", c), 0.5, "double") == "#808080"
    d = spark.createDataFrame([(3.0, 2.0), (3.0, 0.0), (None, 1.0)], "a double, b double").select(display.price_delta(F.col("a"), F.col("b")).alias("d")).collect()
    assert (d[0].d.delta, d[0].d.pct, d[0].d.direction) == (1.0, 50.0, "pricier") and d[1].d.pct == 0.0 and d[2].d is None


def test_replies():
    assert replies.balanced('a {"x": "}"} b {"y": {"z": 1}}') == ['{"x": "}"}', '{"y": {"z": 1}}']
    assert replies.recovered('x {"a": 1} y {"b": {"c": 2}}') == '{"b": {"c": 2}}' and replies.recovered("[1]") is None and replies.recovered(None) is None
    assert replies.recovered('```json\n{"a": 1}\n```') == '{"a": 1}'
