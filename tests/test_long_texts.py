import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import long_texts, trimming


def texts(n, seed=3):
    """Texts of every kind of line end, headers, hits, split words and empty lines."""
    rnd = random.Random(seed)
    kinds = ["plain", "a hit here", "", " § 2 head", "§3 hit", "§ x", "Anschluß", "word hi-", "t follows", "long " * 9]
    ends = ["\n"] * 8 + ["\r\n", "\r", "\x0c", " "]
    out = ["", "\n", "\n\n", "x", "§ 1", "§ 1\n§ 2\nhit", "a\r\nb", "plain\n" * 40, "hit\n" * 40, "plain\n" * 17 + "hit\n" + "plain\n" * 30]
    for _ in range(n):
        weights = [rnd.choice((1, 20)), *(rnd.choice((0, 0, 1)) for _ in kinds[1:])]
        out.append("".join(rnd.choices(kinds, weights)[0] + rnd.choice(ends) for _ in range(rnd.randrange(60)))[: -1 if rnd.random() < 0.3 else None])
    return out


@pytest.mark.parametrize("size, context, budget", [(5, 4, None), (3, 2, None), (2, 1, 40), (6, 4, 60), (64, 4, 60)])
def test_pieces_are_the_text_trimmed_at_once(spark, size, context, budget):
    docs = spark.createDataFrame(list(enumerate(texts(300))), "id int, t string")
    got = long_texts.put_together(long_texts.trim_pieces(docs, "id", "t", "hit|anschluss", context, 0.15, budget, size), "id")
    whole = trimming.trim(F.col("t"), "hit|anschluss", context) if budget is None else trimming.trim_to_budget(F.col("t"), "hit|anschluss", budget, context)
    want = docs.select("id", whole.alias("text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_text_is_cut_evenly(spark):
    docs = spark.createDataFrame([(1, "plain\n" * 1000 + "hit\n" + "plain\n" * 1000), (2, None), (None, "x")], "block int, text string")
    sizes = [len(r.raw.splitlines()) for r in long_texts.line_blocks(docs, "block", "text", 100).collect()]
    assert sorted(sizes) == [1] + [100] * 20
    with pytest.raises(ValueError):
        long_texts.trim_pieces(docs, "block", "text", "hit", 4, size=4)


def test_no_texts(spark):
    docs = spark.createDataFrame([], "id int, t string")
    assert long_texts.put_together(long_texts.trim_pieces(docs, "id", "t", "hit"), "id").isEmpty()
