"""The dealt operators against brute force, and the cases that their docstrings define."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import exact_dedup, hamming, license_scan, ngram_join, packing, pii, piece_scan, quality, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = DOCS + ", row string, label string, key int, digest string, features int, size int, cls string, id string, kept int, score string, ids int, word string"
LABELS = "doc_id long, quality int, toxic int"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30_000))
    texts = [None, "", " \t\n", "x", long, "y" * 200_000, "same text of six words here", "same text of six words here", "pay 4111 1111 1111 1111 now", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id here", None, None, None), (None, None, None, None, None), (6, "same id, other text", "en", "s", 3)]
    return spark.createDataFrame([r + ("r", "l", 1, "d", 2, 3, "c", "i", 0, "s", 9, "w") for r in rows], WIDE)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(6)] + [(None, 1, 0), (3, None, None), (3, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


def pairs(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1: exact deduplication


def dedup_by_hand(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc))
    out = {}
    for text, members in groups.items():
        keep = min(members)[1]
        for _, doc in members:
            out[doc] = (keep, len(members), doc == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a\n b "), (4, None), (5, ""), (6, " "), (7, "ä b"), (8, "äb"), (9, "a b ")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dedup_by_hand(rows)


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "digests_of_test", buckets=3)
    of = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.add(of((1, "a"), (2, "b"))).collect()
    got = pairs(exact_dedup.DigestIndex(spark, "digests_of_test", buckets=3).add(of((3, "a "), (4, "c"), (5, "c"))))
    assert [(got[i].keep_id, got[i].kept) for i in (3, 4, 5)] == [(1, False), (4, True), (4, False)]
    assert index.read().count() == 3


def test_batches_may_be_added_again(spark):
    index = exact_dedup.DigestIndex(spark, "digests_of_retries", buckets=3)
    of = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.add(of((1, "a"), (2, "b")), batch="one").collect()
    rows = of((3, "a "), (4, "c"), (5, "c"), (6, "d"))
    once = sorted(map(tuple, index.add(rows, batch="two").collect()))
    assert sorted(map(tuple, index.add(rows, batch="two").collect())) == once  # as after a failure between append and report
    assert index.read().count() == 4
    index.compact()
    assert index.read().count() == 4
    assert sorted(map(tuple, index.add(rows, batch="two").collect())) == once and index.read().count() == 4
    index.drop()
    assert not spark.catalog.tableExists("digests_of_retries")


def test_exact_dedup_odd(spark, odd, none):
    assert exact_dedup.exact_dedup(spark, odd).count() == odd.count()
    assert exact_dedup.exact_dedup(spark, odd).filter("kept").count() == exact_dedup.exact_dedup(spark, odd).select("text_sha256").distinct().count()
    kept = exact_dedup.keep_first(spark, odd)
    assert kept.columns == odd.columns
    digests = [hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", r.text or "").encode()).hexdigest() for r in kept.collect()]
    assert len(digests) == len(set(digests)) == exact_dedup.exact_dedup(spark, odd).select("text_sha256").distinct().count()
    assert exact_dedup.exact_dedup(spark, none).count() == 0 == exact_dedup.keep_first(spark, none).count()


# 2: personal data


def spans_by_hand(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_against_plain_regexes():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("aB1 2.@+-(39)%_\n٣é") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(text)) == sorted(spans_by_hand(text)), text
    assert pii.base_spans("4111 1111 1111 1111 4111 1111 1111 1112") == []  # one run of 32 digits, no retries
    assert pii.base_spans("1.2.3.256 0001.2.3.4") == [("ip", 10, 20)]


def test_field_finds_more_than_patterns():
    field = pii.default_field()
    texts = [t for t, _ in pii.labelled_table(200, seed=77)]
    truth = [set(s) for _, s in pii.labelled_table(200, seed=77)]
    right = sum(want <= set(got) for want, got in zip(truth, pii.field_spans(texts, field)))
    assert right >= 190
    assert pii.field_spans(["plain words without anything at all, of the kind that books have"], field) == [[]]


def random_sentence(rng):
    """Words of every kind, with brackets and cues, in any order."""
    word = lambda: "".join(rng.choice("abcdefgAT") for _ in range(rng.randint(1, 6)))
    kinds = [word, word, word, lambda: f"({word()})", lambda: f"[{word()}]", lambda: f"({word()}", lambda: f"{word()})", lambda: "[sic]", lambda: "(at)", lambda: "(AT)", lambda: "[at]", lambda: "[dot]", lambda: "password", lambda: "key", lambda: "token:", lambda: "host",
             lambda: str(rng.randint(0, 10**rng.randint(1, 17))), lambda: f"{word()}@{word()}", lambda: f"x={word()}", lambda: "AKIA" + "A2" * 8, lambda: "0f" * 20, lambda: "...", lambda: "(555) 123-4567"]
    return " ".join(rng.choice(kinds)() for _ in range(rng.randint(0, 40)))


def best_path(field, words):
    """Labels of the best path over all words, from the weights alone."""
    e = np.array([field.emit[field._ids(words, i)].sum(0) for i in range(len(words))]).reshape(-1, len(pii.LABELS))
    return e, field._path(e[None], field.move[0], field.move[:, 0])[0] if len(words) else []


def test_every_word_is_decoded():
    field, rng = pii.default_field(), random.Random(5)
    texts = [random_sentence(rng) for _ in range(1500)]
    texts += [f"{' '.join('abcd' for _ in range(40))} {t} {' '.join('efg' for _ in range(40))} {t}" for t, _ in pii.labelled_table(60, seed=8)]
    for text, got in zip(texts, field.decode(texts)):
        _, path = best_path(field, pii._TOKEN.findall(text))
        assert got == [(i, int(k)) for i, k in enumerate(path) if k], text


def test_viterbi_against_all_paths():
    import itertools

    field, rng = pii.default_field(), random.Random(6)
    for _ in range(60):
        words = pii._TOKEN.findall(random_sentence(rng))[:5]
        if not words:
            continue
        e, path = best_path(field, words)
        score = lambda y: sum(field.move[a, b] for a, b in zip((0, *y), (*y, 0))) + sum(e[i, k] for i, k in enumerate(y))
        assert max(map(score, itertools.product(range(len(pii.LABELS)), repeat=len(words)))) == pytest.approx(score([int(k) for k in path]))


def test_brackets_are_no_personal_data():
    texts = ["he said) the other", "a word (at the end) of it", "as written [sic] there", "(see note) and [note] more", "password manager", "the (great) idea", "in (1999) they"]
    assert pii.field_spans(texts, pii.default_field()) == [[]] * len(texts)
    assert [k for k, _, _ in pii.field_spans(["mail lisa (AT) example.com now"], pii.default_field())[0]] == ["email"]


def test_pii_rows(spark, small, odd, none):
    got = pairs(pii.find_personal_data(small))
    for r in small.collect():
        base = sorted(spans_by_hand(r.text or ""), key=lambda s: (pii.BASE.index(s[0]), s[1]))
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[r.doc_id].spans.split(","))
    assert pii.find_personal_data(odd).count() == odd.count()
    assert pii.find_personal_data(none).count() == 0
    red = pii.redact(spark, odd)
    assert red.columns == odd.columns and "pay [card] now" in [r.text for r in red.collect()]


# 3: URL filter


def test_url_parts_and_rules(spark):
    urls = ["https://A.Example.net/en/x?q", "http://x.example.com/de/1", "http://a.org/fr/", "http://notorg/fr/", "http://b.net", "http://b.net/", "http://example.org?x=/fr/", None, "", "no scheme"]
    got = pairs(url_filter.judge_urls(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("x.example.com", "/de/1", "example.com/de/"), ("a.org", "/fr/", "org/fr/"), ("notorg", "/fr/", None),
        ("b.net", "", None), ("b.net", "/", "net/"), ("example.org", "", None), ("", "", None), ("", "", None), ("", "", None),
    ]
    assert {got[i].verdict for i in range(10)} <= {"allow", "block"} and got[0].verdict == "allow" and got[1].verdict == "block"


def test_urls_odd(spark):
    long = "http://a.net/" + "x" * 50_000
    kinds = "page_id long, url string, host string, path string, known string, page_row long, gram string, score double, h string"
    rows = [(i, u, "h", "p", "block", 7, "g", 0.5, "h") for i, u in enumerate([None, "", "no scheme", long, "http://a.org/fr/1", "http://a.org/fr/1", None])] + [(None, "http://b.net/", None, None, None, None, None, None, None)]
    got = url_filter.judge_urls(spark, spark.createDataFrame([*rows, rows[4]], kinds)).collect()
    assert len(got) == 9 and {r.verdict for r in got} <= {"allow", "block"}
    assert sum(r.rule == "org/fr/" for r in got) == 3 and sum(r.host == "" for r in got) == 4
    assert [r.verdict for r in got if r.page_id == 3] == ["block"] == [r.verdict for r in got if r.page_id is None]


def test_calibration_is_of_pages_that_the_models_have_not_seen(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'evil'}.example.{'net/en/' if i % 2 else 'com/de/'}{'x' * (i % 40)}") for i in range(400)]
    grams = url_filter._grams(spark.createDataFrame([(1, True, "allow", "abc"), (2, False, "block", "abd")], "page_row long, held boolean, known string, folded string"))
    assert {(r.page_row, r.known) for r in grams.collect()} == {(1, None), (2, "block")}
    got = url_filter.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len({r.threshold for r in got}) == 1


def test_url_models_tell_hosts_apart(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'evil'}{i % 7}.example.{'net/en/' if i % 2 else 'com/de/'}{i}") for i in range(200)]
    rows += [(1000 + i, f"http://{'good' if i % 2 else 'evil'}{i % 7}.example.edu/{i}") for i in range(40)]
    got = pairs(url_filter.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string")), "page_id")
    assert all(got[1000 + i].verdict == ("allow" if i % 2 else "block") for i in range(40))
    assert url_filter.judge_urls(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_an_empty_url_scores_0(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'evil'}{i % 7}.example.{'net/en/' if i % 2 else 'com/de/'}{i}") for i in range(200)] + [(900, None), (901, "")]
    got = pairs(url_filter.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string")), "page_id")
    assert (got[900].score, got[901].score) == (0.0, 0.0)
    assert {got[900].verdict, got[901].verdict} == {"allow" if got[900].threshold <= 0 else "block"}


def test_url_model_takes_one_step_for_all_orders(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab^") for _ in range(url_filter.ORDER)), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(60)]
    rows = list({g: (g, a, b) for g, a, b in rows}.values())
    model = url_filter._model(spark.createDataFrame(rows, "gram string, allow long, block long"))
    plan = model._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 6 and plan.count("Join ") <= 1

    def probability(gram, side):
        p = 1 / url_filter.ALPHABET
        for k in range(1, url_filter.ORDER + 1):
            tails = {}
            for r in rows:
                if (tail := r[0][-k:])[:-1] == gram[-k:-1]:
                    tails[tail] = tails.get(tail, 0) + r[side]
            n, t = sum(tails.values()), max(1, sum(c > 0 for c in tails.values()))
            p = (tails[gram[-k:]] + t * p) / (n + t)
        return p

    got = {r.gram: r.llr for r in model.collect()}
    assert got == pytest.approx({g: math.log(probability(g, 1)) - math.log(probability(g, 2)) for g, _, _ in rows}, abs=1e-12)


# 4: SentencePiece


@pytest.mark.parametrize("chunk", [piece_scan.CHUNK, 512, 64])
def test_pieces_are_the_models(spark, small, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = small.filter("doc_id < 120")
    encoded = piece_scan.encode(docs, PIECES, chunk, with_ids=True).cache()
    got, back = pairs(encoded), pairs(piece_scan.decode(encoded, PIECES))
    for r in docs.collect():
        ids = np.frombuffer(got[r.doc_id].ids, "<u4").tolist()
        assert ids == model.encode(r.text) and got[r.doc_id].round_trip and back[r.doc_id].text == r.text
        assert (got[r.doc_id].n_ids, got[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(got[r.doc_id].ids))


def test_pieces_odd(spark, odd, none):
    assert piece_scan.encode(odd, PIECES, 64).count() == odd.count()
    assert piece_scan.encode(none, PIECES).count() == 0
    rng, pieces, model = random.Random(4), piece_scan.Pieces.of(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _ in range(1500):
        text = "".join(rng.choice("abtheion  \n.,1#é日▁🎉") for _ in range(rng.randint(0, 50)))
        assert np.frombuffer(pieces.encode(piece_scan.marked(text)), "<u4").tolist() == model.encode(text), text


def test_joined_crc():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 40))
        assert piece_scan.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_long_facts_without_ids(spark):
    texts = ["word " * 3000, "x▁y " * 2000, "日本" * 3000, "z" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, model = pairs(piece_scan.encode(docs, PIECES, 500)), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, text in enumerate(texts):
        ids = model.encode(text)
        assert (got[i].n_ids, got[i].ids_crc32, got[i].round_trip) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), "▁" not in text)


def test_many_levels(spark, monkeypatch):
    monkeypatch.setattr(piece_scan, "TOGETHER", 3)
    text = "ab" * 700 + " then words " * 60
    got = piece_scan.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECES, 50, with_ids=True).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)


# 5: quality


def test_quality_on_held_out(spark):
    docs, labelled = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labelled).join(labelled, "doc_id").filter("held_out").toPandas()
    assert ((got.score >= quality.ACCEPT) == got.predicted.astype(bool)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got.quality).mean() > 0.93
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id)


def test_a_sample_is_about_as_large_as_asked_for(spark):
    ids = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.sampled(ids, "quality", F.lit(True), 100).count() in range(50, 151)
    assert quality.sampled(ids, "quality", F.lit(True), 5000).count() == 1000


def test_quality_odd(spark, odd, none, labels):
    assert quality.score_quality(odd, labels).count() == odd.count()
    assert quality.score_quality(odd, labels).filter("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


# 6: packing


def packed_by_hand(rows, capacity=4096):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    out = {}
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out[doc, piece] = (at, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()))
    return out


def check_places(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [4096, 100])
def test_packing(small, capacity):
    rows = packing.pack(small, WORD_BPE, capacity).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == packed_by_hand([(r.doc_id, r.text) for r in small.collect()], capacity)
    assert check_places(rows, capacity) <= 1.01 * -(-sum(r.length for r in rows) // capacity) + 1


def test_packed_sequences_hold_the_ids(spark, small):
    packed = packing.pack(small.filter("doc_id < 50"), WORD_BPE, 256, with_ids=True).cache()
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_two_for_one():
    plan = packing.plan_bins({60: 1, 30: 1, 25: 1, 14: 1}, 100)
    assert sorted(n for _, lengths in plan for n in lengths) == [14, 25, 30, 60]
    assert sum(n for n, _ in plan) == 2 and [60, 25, 14] in [lengths for _, lengths in plan]
    rng = random.Random(6)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(rng.randint(1, 20))}
        used = collections.Counter()
        for n, lengths in packing.plan_bins(counts, 50):
            assert sum(lengths) <= 50
            for x in lengths:
                used[x] += n
        assert dict(used) == counts


def test_letters_of_the_tokenizer():
    import regex

    for c in map(chr, range(0x250)):
        assert bool(re.match(f"[{packing._LETTERS}]", c)) == bool(regex.match(r"\p{L}", c)), hex(ord(c))
        assert bool(re.match(f"[{packing._NUMBERS}]", c)) == bool(regex.match(r"\p{N}", c)), hex(ord(c))


def test_ids_are_the_tokenizers():
    tokenizer, encode = Tokenizer.from_file(WORD_BPE), packing.WordEncoder(WORD_BPE)
    same = lambda text: np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode("hello <|endoftext|> world"), "<u4").tolist() == [3306, 49407, 1002]
    for text in ["<|endoftext|> don't we're 's'x", "İΣΣ œuvre ǅ ½²", "a\x1cb\x85c\xa0d 日本 é é", "", " \n ", "Əli", "Ɔkɔ Ɛdɛ", "<|ENDOFTEXT|>", "x<|startoftext|><|endoftext|>y", "<|endoftext|", "\u212bngstr\u00f6m \u212a"]:
        assert same(text), text
    rng = random.Random(12)
    for _ in range(20_000):
        text = "".join(chr(rng.choice([rng.randrange(0x180), rng.randrange(0x600), rng.randrange(32, 127)])) for _ in range(rng.randint(0, 14)))
        assert same(text), text
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "'s", "Ⱥ", "e\u0301", "a", "1", "\n"]
    for _ in range(5000):
        assert same(text := "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))), text


def test_runs_go_past_the_steps_before_the_model():
    tokenizer, encode = Tokenizer.from_file(WORD_BPE), packing.WordEncoder(WORD_BPE)
    text = "Ünder Straße, naïve — no: 12½ \x1f\x7f\xad Ɏ's " + "x" * 60 + "".join(c for c in map(chr, range(0x21, 0x250)) if max(c.lower()) < "\u0250")
    near = text.replace("—", "-")
    far, want = encode(text), [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, near)]
    encode.clear()
    encode.tokenizer = None  # for characters from U+0250 on and special tokens alone
    assert [np.frombuffer(x, "<u4").tolist() for x in (far, encode(near))] == want


def test_packing_odd(odd, none):
    rows = packing.pack(odd, WORD_BPE, 64).collect()
    check_places(rows, 64)
    assert len([r for r in rows if r.piece == 0]) == odd.count()
    assert packing.pack(none, WORD_BPE).count() == 0


# 7: n-gram join


def components_by_hand(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    has, root = collections.defaultdict(list), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sets:
        for s in sets[d]:
            has[s].append(d)
    for d, s in sets.items():
        for e, common in collections.Counter(e for x in s for e in has[x] if e < d).items():
            if 100 * common >= percent * (len(s) + len(sets[e]) - common):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def crowds(seed=9):
    """Groups of copies that differ more and more, so that links make chains; one group as large as all others."""
    rng, rows = random.Random(seed), []
    words = ["w%d" % i for i in range(400)]
    for group in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(90 if group == 0 else 8):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(60)] = rng.choice(words)
            rows.append(" ".join(copy) + (" a passage that very many of all documents share word for word" if rng.random() < 0.5 else ""))
            if rng.random() < 0.2:
                base = copy
    return [(i, t) for i, t in enumerate(rows)] + [(9001, "one two three"), (9002, "ONE  two three"), (9003, None), (9004, "  ")]


@pytest.mark.parametrize(("n", "percent", "salted"), [(4, 85, 4000), (5, 80, 4000), (4, 85, 7), (3, 50, 10)])
def test_components(spark, monkeypatch, n, percent, salted):
    monkeypatch.setattr(ngram_join, "SALTED_FROM", salted)
    rows = crowds()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == components_by_hand(rows, n, percent)


def test_components_of_documents(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark, small, 4, 85).collect()}
    assert got == components_by_hand([(r.doc_id, r.text) for r in small.collect()], 4, 85)


def test_components_odd(spark, odd, none):
    assert ngram_join.near_duplicates(spark, odd, 4, 85).count() == odd.count()
    kept = ngram_join.keep_one(spark, odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 7").count() == 0
    assert ngram_join.near_duplicates(spark, none, 4, 85).count() == 0


def unlike_crowd(seed=4, copies=150):
    """Copies of one text that differ from it by so much that most are no links among themselves, and none has the original."""
    rng, base = random.Random(seed), ["b%d" % i for i in range(60)]
    rows = []
    for i in range(copies):
        copy = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3])):
            copy[k] = f"x{i}_{k}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("tile_rows", [4000, 20])
def test_a_crowd_of_unlike_copies_offers_few_pairs(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile_rows)
    rows, offered = unlike_crowd(), []
    inner = ngram_join._offered

    def counted(*args):
        out = inner(*args)
        offered.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_offered", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == components_by_hand(rows, 5, 80)
    assert offered[0] < len(rows) * 4  # of 11,175 pairs that share most shingles


def test_salts_follow_what_a_counter_has_beyond_the_usual():
    counts = np.random.Generator(np.random.PCG64(1)).poisson(40_000_000, ngram_join.COUNTERS)
    counts[7] = 76_000_000
    salts = ngram_join._salts(counts)
    assert salts[7] > 8000 and np.delete(salts, 7).max() <= 10
    assert set(ngram_join._salts(np.zeros(8, np.int64))) == {1}


def test_rows_of_one_tile_are_never_parted():
    import pyarrow as pa

    rng = random.Random(8)
    key = sorted(rng.randint(0, 9) for _ in range(200))
    cuts = sorted(rng.sample(range(201), 12))
    batches = [pa.record_batch({"key": key[a:b], "x": list(range(a, b))}) for a, b in zip([0, *cuts], [*cuts, 200])]
    parts = list(ngram_join._runs(iter(batches), ["key", "x"], 1))
    assert [int(x) for p in parts for x in p[1]] == list(range(200))
    assert all(a[0][-1] != b[0][0] for a, b in zip(parts, parts[1:]))


def test_one_of_near_copies_stays_by_its_own_text(spark):
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("a")), (2, words("a") + " end"), (2, words("b")), (3, words("b")), (3, words("c")), (4, None), (4, "  "), (None, words("a")), (5, words("d")), (5, words("d").upper())]
    kept = sorted(((r.doc_id or 0, (r.text or "")[:2]) for r in ngram_join.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [(d, t.lower()) for d, t in kept] == [(0, "a0"), (1, "a0"), (2, "b0"), (3, "c0"), (4, ""), (4, "  "), (5, "d0")]


# 8: toxicity


def test_restoring():
    words = "you are an idiot and a clown, the stupid moron is pathetic and worthless trash, loser of losers with scum " * 5
    counts = np.zeros(toxicity.LETTERS**3)
    c = toxicity.letters("  " + words.replace(",", "") + "  ")
    np.add.at(counts, (c[:-2] * toxicity.LETTERS + c[1:-1]) * toxicity.LETTERS + c[2:], 1)
    p = np.full(toxicity.LETTERS, 1 / toxicity.LETTERS)
    for order in (1, 2, 3):
        t = counts.reshape((-1,) + (toxicity.LETTERS,) * order).sum(0)
        kinds = np.maximum((t > 0).sum(-1, keepdims=True), 1)
        p = (t + kinds * p) / (t.sum(-1, keepdims=True) + kinds)
    restored = toxicity.Restorer(np.log(p).astype(np.float32))
    for noisy, clean in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("l0$er", "loser"), ("cl0wn!!", "clown")]:
        assert clean in restored(noisy)
    assert "moron" in restored("what m o r 0 n there")
    assert restored("plain words") == {"plain", "words"}


def test_toxicity_on_held_out(spark):
    docs, labelled = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labelled).join(labelled, "doc_id").filter("held_out").toPandas()
    assert ((got.score >= toxicity.REJECT) == got.predicted.astype(bool)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got.toxic).mean() > 0.96 and got[got.toxic == 0].predicted.mean() < 0.01
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id)


def test_toxicity_odd(odd, none, labels):
    got = toxicity.score_toxicity(odd, labels)
    assert got.count() == odd.count() and got.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}


# 9: licences


def test_license_forms(spark, odd, none):
    canonical = lambda text: spark.range(1).select(license_scan.canonical(F.lit(text)).alias("c")).first().c
    assert canonical("Licence licence LICENCE, v v2 ver. v 3") == "license license license version v2 version version 3"
    rows = [(1, "Released under the  MIT licence!"), (2, "Copyright (c) 2020 A\nreleased UNDER the MIT License"), (3, "Intro\nLicensed under CC BY-NC 4.0.\nmore"), (4, "Released under the MIT License and more"), (5, None)]
    got = pairs(license_scan.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(got[i].text_license, got[i].n_notices, got[i].licenses) for i in range(1, 6)] == [("MIT", 1, "MIT"), ("MIT", 1, "MIT"), (None, 1, "CC-BY-NC-4.0"), (None, 0, ""), (None, 0, "")]
    assert license_scan.scan_licenses(spark, odd).count() == odd.count()
    assert license_scan.scan_licenses(spark, none).count() == 0


# 10: Hamming search


def search_by_hand(rows, queries, k):
    out = set()
    for q, c in queries:
        near = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in rows)[:k]
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize(("spread", "probes"), [(3, hamming.PROBES), (12, 500), (64, 500)])
def test_hamming(spark, monkeypatch, spread, probes):
    monkeypatch.setattr(hamming, "PROBES", probes)
    rng = random.Random(spread)
    base = rng.getrandbits(64)
    rows = []
    for i in range(300):
        c = base
        for _ in range(rng.randint(0, spread)):
            c ^= 1 << rng.randrange(64)
        rows.append((i, c - 2**64 if c >= 2**63 else c))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {tuple(r) for r in hamming.nearest_codes(df, df.filter("id % 20 = 0"), 10).collect()}
    assert got == search_by_hand(rows, [r for r in rows if r[0] % 20 == 0], 10)


def test_hamming_width_is_the_tables(spark):
    vectors = spark.createDataFrame([(0, [1.0, -1.0, 1.0]), (20, [1.0, 1.0, 1.0]), (3, [1.0]), (40, None)], "vec_id long, embedding array<float>")
    rows, bits = hamming.coded(vectors)
    assert bits == 3 and {tuple(r) for r in hamming.nearest_codes(rows, rows.filter("id % 20 = 0"), 2, bits).collect()} == {(0, 1, 0, 0), (0, 2, 20, 1), (20, 1, 20, 0), (20, 2, 0, 1)}


@pytest.mark.parametrize(("bits", "spread"), [(65, 65), (100, 9), (128, 128), (200, 40)])
def test_hamming_wide(spark, bits, spread):
    """Vectors wider than one long, near ones and unrelated ones, repeated and broken ones, against brute force; extra columns clash."""
    rng = random.Random(bits)
    base = [rng.choice((-1.0, 1.0)) for _ in range(bits)]
    rows = []
    for i in range(160):
        v = list(base)
        for _ in range(rng.randint(0, spread)):
            v[rng.randrange(bits)] = rng.choice((-1.0, 1.0))
        rows.append((i, v))
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(2000, None), (2020, [1.0] * (bits - 1)), (2040, [None] + [1.0] * (bits - 1))]
    wide = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, q int, code int, d int")
    codes, n = hamming.coded(wide)
    assert n == bits
    got = {tuple(r) for r in hamming.nearest_codes(codes, codes.filter("id % 20 = 0"), 10, bits).collect()}
    whole = [(i, v) for i, v in rows if v and len(v) == bits and None not in v]
    want = set()
    for q, v in whole:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(v, w)), i) for i, w in whole)[:10]
            want |= {(q, r, i, d) for r, (d, i) in enumerate(near, 1)}
    assert got == want


def test_hamming_odd(spark):
    df = spark.createDataFrame([(20, 5), (1, 4), (2, None), (40, None), (20, 5)], "id long, code long")
    assert {tuple(r) for r in hamming.nearest_codes(df, df.filter("id % 20 = 0"), 10).collect()} == {(20, 1, 20, 0), (20, 2, 1, 1)}
    vectors = spark.createDataFrame([(1, [1.0] * 64), (2, [0.0] * 64), (3, None), (4, [1.0] * 63 + [None]), (5, [1.0]), (6, [-1.0] * 63 + [1.0])], "id long, v array<float>")
    codes = {r.id: r.c for r in vectors.select("id", hamming.sign_code(F.col("v")).alias("c")).collect()}
    assert codes == {1: -1, 2: 0, 3: None, 4: None, 5: None, 6: -(2**63)}
    assert hamming.nearest_codes(df.limit(0), df.limit(0)).count() == 0
