"""Personal data: four kinds by pattern, and more by a linear-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The field labels every word of the
text; its features are word shapes, a few words that it learned from the labelled table, and the same of both
neighbours. It finds what the patterns leave out: keys, passwords and tokens, addresses written with ``[at]``, and
numbers in other spellings. Its spans are added where no pattern's span lies.

Every word's features are looked up and its emission formed. Where "none" is best whatever stands on either side, which
``Field.forced`` proves from the emission and ``Field._parted`` for two words in a row without features, the best path has
"none", and between such places the path is found by Viterbi. So the labels are those of the best path of the whole text.

Defined cases: null and empty texts have no spans. A matched pattern that fails its check is dropped, without another
try inside it. Rows that repeat are searched each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_or_empty

BASE = ("email", "ip", "card", "phone")
LABELS = ("none", "email", "ip", "card", "phone", "secret")
#: Words whose features are remembered by a field; beyond it the memory starts anew. Longer words are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"[\[(](?:at|dot)[\])]", re.I)
_TOKEN = re.compile(r"[^\s=\"']+")
_EDGE = ".,;:!?<>{}"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain, from one @ to the next so that long runs cost no more."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    numbers = any(map(text.__contains__, "0123456789"))
    if numbers:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def labelled_table(rows: int = 1400, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """A small labelled table made from templates: text and the spans in it."""
    random = np.random.Generator(np.random.PCG64(seed))
    pick = lambda options: options[int(random.integers(len(options)))]
    text = lambda letters, n: "".join(letters[int(i)] for i in random.integers(len(letters), size=n))
    digits = lambda n: text("0123456789", n)
    word = lambda: text("aeioubcdfglmnprst", int(random.integers(2, 10)))
    def number(valid: bool) -> str:
        while luhn(out := digits(16)) != valid:
            pass
        return out

    dotted = lambda n: ".".join(n[i : i + 4] for i in range(0, 16, 4))
    made = {
        "email": [lambda: f"{word()} [at] {word()} [dot] {pick(('org', 'com', 'net'))}", lambda: f"{word()}{digits(2)}@{word()}.example.com", lambda: f"{word()}(at){word()}.org", lambda: f"{word()} (at) {word()}.com", lambda: f"{word()}[at]{word()}.net", lambda: f"{word()} (AT) {word()}.com", lambda: f"{word()} [AT] {word()} [DOT] {pick(('org', 'com', 'net'))}", lambda: f"{word()}{digits(int(random.integers(1, 4)))} [at] {word()} [dot] {pick(('org', 'com', 'net'))}", lambda: f"{word()}.{word()} (at) {word()}.org", lambda: f"{word()}{digits(2)} (at) {word()} (dot) com"],
        "ip": [lambda: ".".join(str(int(i)) for i in random.integers(1, 255, size=4)), lambda: f"{digits(2)}.{digits(3)}.{digits(1)}.{digits(2)}"],
        "card": [lambda: dotted(number(True)), lambda: number(True)],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"0{digits(2)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"],
        "secret": [lambda: "AKIA" + text("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: text("0123456789abcdef", 40), lambda: text("0123456789abcdef", 18), lambda: "ghp_" + text("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 36), lambda: text("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 32)],
    }
    cue = {"secret": ["password={}", "token = \"{}\"", "api_key={}", "key {}", "secret: {}", "{}"], "phone": ["call {}", "phone {}", "tel {}", "{}"], "email": ["{}", "mail {}"], "card": ["card {}", "{}"], "ip": ["host {}", "{}"]}
    plain = [lambda: digits(4), lambda: f"{digits(1)}.{digits(1)}", lambda: f"version {digits(1)}.", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)},{digits(3)}", lambda: f"{digits(3)}", lambda: f"{digits(6)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"x = {digits(2)}", lambda: f"{word()}={word()}", lambda: f"{word()}{digits(1)}", lambda: f"@{word()}", lambda: f"{digits(2)}%", lambda: number(False), lambda: number(False), lambda: dotted(number(False))]
    brackets = [lambda: f"({word()})", lambda: f"({word()} {word()})", lambda: f"({word()} {word()} {word()})", lambda: f"[{word()}]", lambda: f"[{word()} {word()}]", lambda: f"({digits(4)})", lambda: f"[{digits(1)}]", lambda: f"{word()} ({word()}, {digits(2)})", lambda: f"{word()}) {word()}", lambda: f"({word()}-{word()})", lambda: f"({word()}). {word()}", lambda: f"{word()} [...] {word()}", lambda: f"({word()} {word()}) {word()} [{word()}]", lambda: f"[{word()}] [{word()} {word()} {word()}]", lambda: f"[{word()} {word()}] [{word()}]"]
    upper, name = lambda n: text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n), lambda: word().capitalize()
    month, year = lambda: pick(("January", "March", "June", "July", "October", "December", "Mai", "juin", "enero")), lambda: pick(("18", "19", "20")) + digits(2)
    amounts = [lambda: f"{digits(2)}.{digits(2)} ({word()})", lambda: f"{year()} ({word()} {digits(2)})", lambda: f"{digits(2)}:{digits(2)} ({word()} {digits(1)})", lambda: f"{digits(1)}pm ({upper(3)}) on {name()}", lambda: f"{digits(3)},{digits(3)} ({word()} {word()}", lambda: f"{digits(1)} ({word()})", lambda: f"{digits(2)}% ({word()}, {word()})", lambda: f"{digits(1)}.{digits(1)} ({upper(2)})", lambda: f"({digits(1)}) {word()} ({digits(2)}) {word()}", lambda: f"({pick('abcdi')}) {word()}", lambda: f"{name()} (c) {year()}", lambda: f"Copyright (C) {year()} {name()}", lambda: f"({upper(3)})", lambda: f"{word()}(s) {word()}", lambda: f"({word()}); {word()}"]
    lists = [lambda: f"{digits(1)}-{digits(1)} ({digits(1)}-{digits(1)})", lambda: f"{year()}, {year()}", lambda: f"{year()}, {year()}, {year()} {word()}", lambda: f"{year()}-{year()}", lambda: f"{year()}-{year()}, {year()}", lambda: f"{digits(1)}, {digits(2)} {month()} {year()}", lambda: f"{digits(2)} {month()} {year()}", lambda: f"{month()} {digits(2)}, {year()}", lambda: f"{digits(1)}.{digits(1)}, {digits(1)}.{digits(1)}, {digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.\n\n{digits(1)}", lambda: f"{digits(1)}.{digits(1)}. {name()}", lambda: f"{digits(2)}.{digits(2)}.{year()}", lambda: f"{digits(2)}/{digits(2)}/{year()}", lambda: f"{digits(1)} {digits(1)} {digits(1)}", lambda: f"{digits(2)}, {digits(3)}, {digits(2)}", lambda: f"{digits(3)} {digits(3)} {word()}", lambda: f"{digits(1)}-{digits(2)} {word()}", lambda: f"{digits(3)}-{digits(3)} {word()}", lambda: f"{digits(2)} x {digits(2)}", lambda: f"{digits(1)}/{digits(1)}, {digits(1)}/{digits(1)}", lambda: f"{digits(1)} + {digits(1)} = {digits(2)}", lambda: f"{digits(1)}:{digits(1)}, {digits(2)}:{digits(2)}", lambda: f"{digits(2)}:{digits(2)}, {digits(2)}:{digits(2)}, {digits(2)}:{digits(2)}", lambda: f"{year()}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(4)} {year()}-{digits(2)}-{digits(2)}", lambda: f"{digits(4)} {digits(4)}"]
    signs = [lambda: f"{word()}({word()}) {word()} {word()}[{digits(1)}]", lambda: f"{word()}({word()})", lambda: f"{word()}[{digits(1)}]", lambda: f"{word()}({digits(1)}, {word()})", lambda: f"{word()}.{word()}({word()})", lambda: f"{word()}()", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()}-{digits(1)}.{digits(1)}", lambda: f"https://{word()}.{pick(('org', 'com', 'net'))}/{word()}", lambda: f"https://www.{word()}.org/{word()}/{word()}-{digits(1)}.{digits(1)}", lambda: f"<http://{word()}.com/>", lambda: f"http://www.{word()}.org/{word()}/", lambda: f"{upper(3)}-{digits(1)}.{digits(1)}", lambda: f"{upper(2)}{digits(2)}", lambda: f"[{digits(1)}] {name()}, [{digits(2)}]", lambda: f"({name()} {year()})", lambda: f"({name()} and {name()} {year()}, p. {digits(2)})", lambda: f"{word()}_{word()}", lambda: f"#{digits(3)}", lambda: f"{word()}@", lambda: f"@{word()}{digits(2)}", lambda: f"{word()}{digits(4)}", lambda: f"{text('abcdef', 6)}", lambda: f"{upper(6)}{digits(3)}", lambda: word() + word() + word() + word()]
    named = ["password", "token", "key", "secret", "call", "phone", "tel", "mail", "card", "host", "api_key"]
    plain += [lambda: pick(amounts)()] * 14 + [lambda: pick(lists)()] * 20 + [lambda: pick(signs)()] * 20
    plain += [lambda: pick(brackets)()] * 12 + [lambda: f"{pick(named)} {word()}"] * 3 + [lambda: f"{pick(named)}: {word()}"] * 2
    table = []
    for i in range(rows):
        kind, out = ("none", *made, "none", "none", "none", "none")[i % (len(made) + 5)], [word() for _ in range(int(random.integers(3, 8)))]
        line = " ".join(out).capitalize() + " "
        spans: list[Span] = []
        if kind == "none":
            line += pick(plain)()
        else:
            before, after = pick(cue[kind]).split("{}")
            value = pick(made[kind])()
            spans.append((kind, len(line) + len(before), len(line) + len(before) + len(value)))
            line += before + value + after
        line += pick((" ", ", ", ". ")) + " ".join(word() for _ in range(int(random.integers(3, 8)))) + "."
        table.append((line, spans))
    return table


def shape_features(token: str) -> list[str]:
    """What a word looks like. Words without signs all look alike, apart from those that a field has learned."""
    bare = token.strip(_EDGE)
    n = sum("0" <= c <= "9" for c in bare)
    out = [f"digits{min(n, 8) if n < 9 else 9 if n < 13 else 13 if n < 20 else 20}"]
    if not n and "@" not in bare and "[" not in bare and "(" not in bare:
        return out
    short = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[^\\W\\d_A-Z]", "a", bare))))
    length = min(len(bare) // 4, 10)
    out += [f"shape {short[:12]}", f"length{length}", f"mixed{n > 0}{any(c.isalpha() for c in bare)}{bare.isupper()}"]
    out += [f"hex{len(bare) >= 12 and n > 1 and not bare.strip('0123456789abcdef')}", f"long{len(bare) >= 14}{n > 0}{bare.isalnum()}", f"dots{bare.count('.')}", f"luhn{13 <= n <= 19}{luhn(re.sub('[^0-9]', '', bare))}", f"at{'@' in bare}{bool(_SPELLED.search(bare))}{bare[:1] in '(['}"]
    return out


class Words(dict):
    """word -> number of its type; words of one type have the same features. Bounded; the types stay."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self.field.type_of(word)
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = found
        return found


class Field:
    """A linear-chain conditional random field, trained by gradient steps on forward-backward sums."""

    def __init__(self, table: list[tuple[str, list[Span]]] | None = None, steps: int = 220, stored: dict | None = None):
        if stored is None:
            self._train(table or [], steps)
        else:
            self.words, self.index = set(stored["words"]), {f: i for i, f in enumerate(stored["features"])}
            self.emit, self.move = np.array(stored["emit"]), np.array(stored["move"])
            self._plain = self._ids(["aa", "aa", "aa"], 1)
        # What label "none" gains over another, whatever the labels on either side are, is at least its emission's and this.
        self._least = (self.move[:, :1] - self.move).min(0) + (self.move[:1] - self.move).min(1)
        self._types: dict[tuple, int] = {}
        self._vectors: list[np.ndarray] = []
        self._edge, self._none = self._type((), (), ()), self.type_of("aa")
        self.known = Words(self)

    def _train(self, table: list[tuple[str, list[Span]]], steps: int) -> None:
        sentences = []
        for text, spans in table:
            tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
            y = [next((LABELS.index(k) for k, s, e in spans if a < e and b > s), 0) for a, b in tokens]
            sentences.append(([text[a:b] for a, b in tokens], y))
        counts: dict[str, int] = {}
        for words, y in sentences:
            for w, k in zip(words, y):
                if not k:
                    counts[w.lower()] = counts.get(w.lower(), 0) + 1
        self.words = {w for w, c in counts.items() if c >= 5 and w.strip(_EDGE).isascii() and len(w) > 2}
        self.index: dict[str, int] = {}
        seen = [[self._ids(words, i, grow=True) for i in range(len(words))] for words, _ in sentences]
        self._fit(seen, [y for _, y in sentences], steps)
        self.emit, self.move = self.emit.round(4), self.move.round(4)
        while not self._parted():  # a stretch of plain words must lead through "none"
            self.emit[self._plain, 1:] -= 0.25

    def stored(self) -> dict:
        """The parameters, as they are kept in a file."""
        return {"words": sorted(self.words), "features": list(self.index), "emit": self.emit.round(4).tolist(), "move": self.move.round(4).tolist()}

    def _type(self, own: tuple, before: tuple, after: tuple) -> int:
        """The number of a set of features; its emissions at its own place, behind it and before it."""
        at = self._types.setdefault((own, before, after), len(self._vectors))
        if at == len(self._vectors):
            self._vectors.append(np.stack([self.emit[list(ids)].sum(0) for ids in (own, before, after)]))
        return at

    def type_of(self, word: str) -> int:
        names = self._names(word)
        sides = (tuple(self.index[s + f] for f in names if s + f in self.index) for s in ("", "<", ">"))
        own, before, after = sides
        return self._type((self.index["bias"], *own), before, after)

    def _names(self, word: str) -> list[str]:
        w = word.lower()
        return shape_features(word) + [f"word {w}"] * (w in self.words)

    def features(self, words: list[str], i: int) -> list[str]:
        out = ["bias"]
        for at, side in ((i, ""), (i - 1, "<"), (i + 1, ">")):
            if 0 <= at < len(words):
                out += [side + f for f in self._names(words[at])]
        return out

    def _ids(self, words: list[str], i: int, grow: bool = False) -> list[int]:
        names = self.features(words, i)
        if grow:
            return [self.index.setdefault(f, len(self.index)) for f in names]
        return [self.index[f] for f in names if f in self.index]

    def _fit(self, seen: list[list[list[int]]], labels: list[list[int]], steps: int) -> None:
        n, k, longest = len(seen), len(LABELS), max(map(len, seen))
        gold = np.zeros((n, longest), np.int64)
        has = np.zeros((n, longest, len(self.index)))  # small: the labelled table's words by the features that they have
        length = np.array([len(s) for s in seen])
        for a, (s, y) in enumerate(zip(seen, labels)):
            gold[a, : len(y)] = y
            for b, f in enumerate(s):
                has[a, b, f] = 1
        flat, which = np.unique(has.reshape(n * longest, -1), axis=0, return_inverse=True)  # words with equal features
        mask = np.arange(longest) < length[:, None]
        w, t = np.zeros((len(self.index), k)), np.zeros((k, k))
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        one = np.eye(k)
        for step in range(1, steps + 1):
            e = (flat @ w)[which].reshape(n, longest, k)
            # Before the first word and behind the last stands "none".
            f, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            f[:, 0] = t[0] + e[:, 0]
            for i in range(1, longest):
                new = _logsum(f[:, i - 1][:, :, None] + t, 1) + e[:, i]
                f[:, i] = np.where(mask[:, i][:, None], new, f[:, i - 1])
            b[:, -1] = t[:, 0]
            for i in range(longest - 2, -1, -1):
                new = _logsum((b[:, i + 1] + e[:, i + 1])[:, None, :] + t, 2)
                b[:, i] = np.where(mask[:, i + 1][:, None], new, t[:, 0])
            z = _logsum(f[:, -1] + t[:, 0], 1)
            p = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
            missed = (one[gold] * mask[:, :, None] - p).reshape(-1, k)
            gw, gt = flat.T @ np.stack([np.bincount(which, missed[:, c], len(flat)) for c in range(k)], 1), np.zeros_like(t)
            for i in range(1, longest):
                inner = np.exp(f[:, i - 1][:, :, None] + t + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None]) * mask[:, i][:, None, None]
                gt += (one[gold[:, i - 1]][:, :, None] * one[gold[:, i]][:, None, :] * mask[:, i][:, None, None] - inner).sum(0)
            gw, gt = gw / n - 2e-4 * w, gt / n - 2e-4 * t
            for j, (x, g) in enumerate(((w, gw), (t, gt))):
                m, s = moments[2 * j], moments[2 * j + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        self.emit, self.move = w, t
        self._plain = self._ids(["aa", "aa", "aa"], 1)

    def _parted(self) -> bool:
        """Whether the best path over two plain words between any two labels has "none" on both."""
        e = self.emit[self._plain].sum(0)
        for first in range(len(LABELS)):
            for last in range(len(LABELS)):
                if self._path(np.tile(e, (1, 2, 1)), self.move[first], self.move[:, last])[0].any():
                    return False
        return True

    def forced(self, e: np.ndarray) -> np.ndarray:
        """Emissions, a row each, with which "none" is best whatever the labels on either side are."""
        return (e[:, :1] - e[:, 1:] + self._least[1:] > 1e-9).all(1)

    def _path(self, e: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Viterbi for a batch of sequences of one length: (batch, words, labels) -> (batch, words)."""
        score, back = e[:, 0] + begin, []
        for i in range(1, e.shape[1]):
            steps = score[:, :, None] + self.move
            back.append(steps.argmax(1))
            score = steps.max(1) + e[:, i]
        path = [(score + end).argmax(1)]
        for b in reversed(back):
            path.append(b[np.arange(len(b)), path[-1]])
        return np.stack(path[::-1], 1)

    def decode(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Of each text the words (number, label) that the best path labels other than "none"."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for i, text in enumerate(texts):
            words = _TOKEN.findall(text) if len(text) < 1 << 20 else (m[0] for m in _TOKEN.finditer(text))
            kinds = np.fromiter(map(self.known.__getitem__, words), np.int32)
            for first, e in self._open(kinds):
                waiting.setdefault(len(e), []).append((i, first, e))
        for parts in waiting.values():  # parts of one length are decoded together
            paths = self._path(np.stack([e for _, _, e in parts]), self.move[0], self.move[:, 0])
            for j in np.flatnonzero(paths.any(1)):
                i, first, _ = parts[j]
                out[i] += [(first + int(k), int(paths[j, k])) for k in np.flatnonzero(paths[j])]
        return [sorted(words) for words in out]

    def _open(self, kinds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First word and emissions of each stretch on which "none" is not known to be best; outside of them it is."""
        if not (kinds != self._none).any():
            kinds = kinds[:4]  # what is left out of the middle is plain as well
        around = np.concatenate([[self._edge], kinds, [self._edge]])
        plain = around == self._none
        middle = plain[:-2] & plain[1:-1] & plain[2:]
        settled = middle & (np.append(False, middle[:-1]) | np.append(middle[1:], False))
        at = np.flatnonzero(~settled)
        if not len(at):
            return
        table = np.stack(self._vectors)
        e = table[around[at + 1], 0] + table[around[at], 1] + table[around[at + 2], 2]
        free = ~self.forced(e)
        at, e = at[free], e[free]
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        for part in np.split(np.arange(len(at)), cuts):
            if len(part):
                yield int(at[part[0]]), e[part]


#: What ``python -m ledgerloom.llm.pii`` made of the labelled table.
PARAMETERS = Path(__file__).with_name("pii_field.json")


@lru_cache(1)
def default_field() -> Field:
    """The field of the labelled table, with the parameters that its training left in PARAMETERS."""
    return Field(stored=json.loads(PARAMETERS.read_text()))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans of each text that the field labels; neighbouring words of one label are one span."""
    out: list[list[Span]] = [[] for _ in texts]
    for spans, text, words in zip(out, texts, field.decode(texts)):
        if not words:
            continue
        places = np.fromiter((x for m in _TOKEN.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
        last = (-2, 0)
        for i, label in words:
            start, end = map(int, places[i])
            word = text[start:end]
            a, b = end - len(word.lstrip(_EDGE)), start + len(word.rstrip(_EDGE))
            if b <= a:  # nothing but marks
                continue
            if last == (i - 1, label):
                spans[-1] = (LABELS[label], spans[-1][1], b)
            else:
                spans.append((LABELS[label], a, b))
            last = (i, label)
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Of each text: the patterns' spans, and those with the field's that touch none of them; by kind, then start."""
    order = {k: i for i, k in enumerate((*BASE, "secret"))}
    key = lambda s: (order[s[0]], s[1], s[2])
    out = []
    for text, more in zip(texts, field_spans(texts, field)):
        base = sorted(base_spans(text), key=key)
        starts, ends = [], []  # of the patterns' spans, joined where they overlap
        for _, start, end in sorted(base, key=lambda s: s[1]):
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start), ends.append(end)
        added = [s for s in more if (i := bisect.bisect_right(ends, s[1])) == len(ends) or starts[i] >= s[2]]
        out.append((base, sorted(base + added, key=key)))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _found(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = all_spans(batch.column("text").to_pylist(), field)
            counts = [[sum(s[0] == k for s in base) for base, _ in rows] for k in BASE]
            digest = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in rows]
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([_written(s) for _, s in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, table: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, their digest, and all spans (code points, end exclusive)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    kinds = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return given.mapInArrow(_found(Field(table) if table else default_field()), kinds)


def redact(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns stay. A null text stays null."""
    field = default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            out = []
            for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], field)):
                done, parts = 0, []
                for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if end > done and text is not None:
                        parts += [text[done : max(start, done)]] + [f"[{kind}]"] * (start >= done)
                        done = end
                out.append(None if text is None else "".join(parts) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


if __name__ == "__main__":
    PARAMETERS.write_text(json.dumps(Field(labelled_table()).stored(), indent=0))
