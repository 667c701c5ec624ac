"""Toxicity: whatever is spelled anywhere in a text is restored, however long the run or token."""

import numpy as np
import pytest

from ledgerloom.llm import toxicity

WORDS = "you are an idiot and a clown, the stupid moron is pathetic and worthless trash, loser of losers with scum, a big pig " * 5


@pytest.fixture(scope="module")
def model():
    counts = np.zeros(toxicity.LETTERS**3)
    c = toxicity.letters("  " + WORDS.replace(",", "") + "  ")
    np.add.at(counts, (c[:-2] * toxicity.LETTERS + c[1:-1]) * toxicity.LETTERS + c[2:], 1)
    p = np.full(toxicity.LETTERS, 1 / toxicity.LETTERS)
    for order in (1, 2, 3):
        t = counts.reshape((-1,) + (toxicity.LETTERS,) * order).sum(0)
        kinds = np.maximum((t > 0).sum(-1, keepdims=True), 1)
        p = (t + kinds * p) / (t.sum(-1, keepdims=True) + kinds)
    return np.log(p).astype(np.float32)


def test_spaced_run_is_restored_to_its_end(model):
    assert "moron" in toxicity.Restorer(model)(" ".join("you are the clown " * 40 + "moron").replace("   ", " "))


def test_blocks_give_the_path_of_the_whole(model, monkeypatch):
    token = " ".join("you are an 1d10t and a $tup1d m0r0n".replace(" ", "")) + "-" + "clooown " * 3
    whole = toxicity.restore(token, model)
    for block in (1, 2, 7, 30):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert toxicity.restore(token, model) == whole


@pytest.mark.parametrize("token, word", [("i" * 100 + "diot", "idiot"), ("the.and,is/" * 12 + "m0r0n", "moron"), ("m0r0n;" + "clown-" * 20 + "a", "moron"), ("bi9pi9" + "pig" * 30, None), ("pi9", "pig")])
def test_long_tokens_and_every_lookalike(model, token, word):
    found = toxicity.Restorer(model)(token)
    assert word in found if word else any("bigpig" in w for w in found)


def all_paths(token, model):
    """The best of all ways to read a token, each tried."""
    import itertools

    ways = []
    for char, stretched, left_out in toxicity._units(token):
        if stretched:
            ways.append([(char, toxicity.STRETCHED), (char * 2, toxicity.STRETCHED)])
        elif char.isalpha():
            ways.append([(char, 0.0)])
        elif char in toxicity.LOOKALIKES:
            ways.append([*((x, toxicity.LOOKALIKE) for x in toxicity.LOOKALIKES[char]), ("", left_out)])
        else:
            ways.append([("", 0.0), (" ", toxicity.WORD_GAP)])
    best = (-np.inf, "")
    for way in itertools.product(*ways):
        text = "".join(w for w, _ in way)
        if "  " in text or text.startswith(" "):  # a space stands behind a letter only
            continue
        c = [0, 0, *toxicity.letters(text), 0]
        best = max(best, (sum(cost for _, cost in way) + sum(float(model[a, b, x]) for a, b, x in zip(c, c[1:], c[2:])), text))
    return best


@pytest.mark.parametrize("token", ["1d10t", "$tup1d", "m.o.r.0.n", "l0$er", "clooown", "4 b1g p1g", "a$$", "9", "7r4$h", "i d i 0 t", "|d!ot", "pa7h37ic"])
def test_restoring_is_the_best_of_all_paths(model, token):
    score, _ = all_paths(token, model)
    text = toxicity.restore(token, model)
    again = [s for s in [all_paths(token, model)] if s[1] == text]
    assert again and again[0][0] == pytest.approx(score)


@pytest.mark.parametrize("token, word", [("5cum", "scum"), ("$cum", "scum"), ("tr4sh", "trash"), ("p1g", "pig"), ("id10+", "idiot")])
def test_a_lookalike_at_any_place(model, token, word):
    assert word in toxicity.Restorer(model)(token)
    assert toxicity.Restorer(model)("2024 17 plain") == {"plain"}


@pytest.fixture(scope="module")
def corpus_model(spark):
    return toxicity.letter_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize(
    "spelled", ["1d10t", "ID1OT!", "1diot", "id10t", "1d1ot", "i...d...i...o...t", "i.d.i.o.t", "what i d 1 o t then", "!d!ot"]
)
def test_spellings_under_the_letters_of_the_documents(corpus_model, spelled):
    assert "idiot" in toxicity.Restorer(corpus_model)(spelled)


@pytest.mark.parametrize("spelled, word", [("6ood", "good"), ("$tup1d", "stupid"), ("l053r", "loser"), ("w0r7hl3ss", "worthless"), ("tr@5h", "trash"), ("covid19", "covid"), ("m o r", "mor"), ("clown!!", "clown"), ("$cum", "scum")])
def test_other_spellings(corpus_model, spelled, word):
    assert word in toxicity.Restorer(corpus_model)(spelled)
