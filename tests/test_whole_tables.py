"""Queries that read whole tables and whole texts, against brute force."""

import re

import pytest

import __spark_entry__
from ledgerloom.plans.texts import ANCHORS

def run(spark, tmp_path, name, table, frame):
    frame.write.parquet(f"{tmp_path}/{table}.parquet")
    return __spark_entry__.queries()[name](spark, str(tmp_path)).toPandas()


def window(text, context):
    ls = text.split("\n")
    hit = [bool(re.search(ANCHORS, x.lower())) for x in ls]
    keep = [any(hit[max(0, i - context) : i + context + 1]) for i in range(len(ls))]
    return "\n".join(x if k else "[…]" for i, (x, k) in enumerate(zip(ls, keep)) if k or i == 0 or keep[i - 1])


def sections(text):
    blocks = re.split(r"\n(?=[^\S\n]*§[^\S\n]*\d)", text)
    hit = [bool(re.search(ANCHORS, b.lower())) for b in blocks]
    return "\n".join(b if k else "[…]" for i, (b, k) in enumerate(zip(blocks, hit)) if k or i == 0 or hit[i - 1])


def choice(text, context=4):
    both = [window(text, context), sections(text)]
    fits = [x for x in both if len(x) >= 0.15 * len(text)]
    if fits:
        return min(fits, key=len)
    return min(both, key=len) if re.search(ANCHORS, text.lower()) else text


def budget(text):
    tries = [choice(text, c) for c in (4, 3, 2, 1)]
    return next((t for t in tries if len(t) <= 300), tries[-1])


@pytest.mark.parametrize("name, by_hand", [("trim_window", lambda t: window(t, 4)), ("trim_sections", sections), ("trim_choice", choice), ("trim_budget", budget), ("trim_stats", lambda t: len(window(t, 4)))])
def test_trims_long_texts(spark, tmp_path, name, by_hand):
    line = "ordinary words that fill a line to some length"
    def long(hits, lines=120, section=17):
        return "\n".join((f"§ {i} " if i % section == 0 else "") + line + (" benefit" if i in hits else f" {i}") for i in range(lines))
    texts = {1: long({60}), 2: long({0, 40, 41, 119}), 3: long(set()), 4: long({5}, 2000, 2001), 5: "short token\nline", 6: "\n".join(["x" * 700] * 5 + ["license"] + ["y" * 700] * 6)}
    assert sum(len(t) >= 3000 for t in texts.values()) == 5
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = run(spark, tmp_path, name, "documents", frame)
    assert dict(zip(got.doc_id, got["kept" if name == "trim_stats" else "trimmed"])) == {i: by_hand(t) for i, t in texts.items()}


def test_scalars_read_long_texts(spark, tmp_path):
    text = "Ein Wort-\nteil, 1.234,56 EUR \u00e4 " + "noch  ein\tSatz. " * 300 + "zuletzt 7.654.321 und Sil-\nbe \u00dc"
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    key = lambda name, column: run(spark, tmp_path / name, name, "documents", docs)[column].tolist()
    assert key("norm_key", "key") == [" ".join(text.split())]
    assert key("amounts_tokens", "tokens") == ["1234|7654321"]
    assert key("dehyphenate", "joined") == [text.replace("-\n", "") + " xxyy Zz-\nAa"]
    slug = key("slug", "slug")[0]
    assert slug.startswith("ein-wort-teil-1-234-56-eur-ae-noch") and slug.endswith("-zuletzt-7-654-321-und-sil-be-ue")
    turns = spark.createDataFrame([(1, "user", text), (1, "assistant", "short")], "conv_id long, role string, text string")
    assert run(spark, tmp_path / "payloads", "payloads", "conversations", turns).payload.tolist() == ["# reply\n\n=== assistant ===\nshort\n\n=== user ===\n" + text]


def test_equivalent_of_every_tariff(spark, tmp_path):
    parts = [(1, "Brand#1", "A", 1), (2, "Brand#9", "A", 1), (3, "Brand#8", "B", 1), (4, "Brand#7", "B", 50), (5, "Brand#2", "C", 1), (6, "Brand#1", "C", 1), (7, "Brand#6", "C", 1)]
    frame = spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int")
    got = run(spark, tmp_path, "equivalent_product", "part", frame)
    assert dict(zip(got.stem, got.equivalent)) == {"brand-9__a": "brand-1__a", "brand-8__b": "brand-7__b", "brand-2__c": "brand-1__c", "brand-1__c": "brand-2__c"}


def test_claims_of_short_documents(spark, tmp_path):
    frame = spark.createDataFrame([(1, "de", "de", 2), (3, "no", "en", 2)], "doc_id long, text string, lang string, n_chars long")
    got = run(spark, tmp_path, "grounded_claims", "documents", frame)
    assert dict(zip(got.doc_id, got.grounded)) == {1: True, 3: False}
