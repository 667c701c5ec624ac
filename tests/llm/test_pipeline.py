"""Each stage on its own input, and the whole."""

import re

import corpus_pipeline
from ledgerloom.llm import pii, quality
from ledgerloom.llm.common import stage

from .test_operators import check_places, components_by_hand, packed_by_hand  # noqa: F401

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert list(STAGES) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]

    good = stage(STAGES["quality classifier"](spark, docs, SF))
    accepted = {r.doc_id for r in quality.score_quality(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == accepted
    clean = labels.join(docs, "doc_id").filter("quality = 1").count()
    assert labels.filter("quality = 1").join(good, "doc_id").count() >= 0.98 * clean

    single = stage(STAGES["exact dedup"](spark, good, SF))
    best = {}
    for r in good.collect():
        text = re.sub("[\x20\x09-\x0d]", "", r.text or "")
        best[text] = min(best.get(text, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in single.collect()} == {d for _, d in best.values()}

    unlike = stage(STAGES["n-gram Jaccard join"](spark, single, SF))
    groups = components_by_hand([(r.doc_id, r.text) for r in single.collect()], 5, 80)
    assert {r.doc_id for r in unlike.collect()} == {c for _, c in groups.values()}

    redacted = stage(STAGES["PII"](spark, unlike, SF))
    field, before = pii.default_field(), {r.doc_id: r.text for r in unlike.collect()}
    for r in redacted.collect():
        text = before[r.doc_id]
        for kind, a, b in sorted(pii.all_spans([text], field)[0][1], key=lambda s: -s[1]):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        assert r.text == text and r.n_chars == len(text)
    for made in (good, single, unlike, redacted):
        assert made.columns == docs.columns and made.dtypes == docs.dtypes

    rows = STAGES["best-fit packing"](spark, redacted, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == packed_by_hand([(r.doc_id, r.text) for r in redacted.collect()])
    check_places(rows, 4096)

    again = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in again} == {(r.doc_id, r.piece, r.ids_crc32) for r in rows}


def test_stages_on_odd_rows(spark):
    long = "word " * 30_000
    rows = [(1, None, None, None, None), (None, "text without an id", "en", "s", 3), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (4, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, key string, digest string"
    docs = spark.createDataFrame([r + ("i", 1, "k", "d") for r in rows], schema)
    for df in (docs, docs.limit(0)):
        for name, work in corpus_pipeline.STAGES[:-1]:
            made = work(spark, df, SF)
            assert made.columns == df.columns, name
            made.collect()
        corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
