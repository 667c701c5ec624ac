"""Texts of an Arrow batch cut into runs of letters, digits or symbols, all documents at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .shingles import _BYTE, mixed

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE, _LETTER, _DIGIT, _SYMBOL = range(4)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
SHAPES = 6
#: Bytes looked at together. A longer text is cut at the last white space before each multiple of it.
BLOCK = 1 << 18


class Runs(NamedTuple):
    doc: np.ndarray
    hash: np.ndarray
    shape: np.ndarray


def _powers(n: int, known: list[np.ndarray]) -> np.ndarray:
    if not known or len(known[0]) < n:
        known[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 255), _BASE)]), dtype=np.uint64)]
    return known[0]


_KNOWN: list[np.ndarray] = []


def _cut(raw: np.ndarray, starts: np.ndarray, first_doc: int) -> Runs:
    """raw: bytes of documents that begin at ``starts``."""
    kind = _KIND[raw]
    change = np.empty(len(raw), bool)
    change[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[starts[starts < len(raw)]] = True
    at = np.flatnonzero(change)
    lengths = np.diff(np.append(at, len(raw)))
    solid = kind[at] != _WHITE
    place = np.arange(len(raw)) - np.repeat(at, lengths)
    powers = _powers(int(lengths.max()) + 1, _KNOWN)
    hashes = np.add.reduceat(_BYTE[raw] * powers[place], at)[solid] if len(at) else np.zeros(0, np.uint64)
    upper = np.add.reduceat(_UPPER[raw], at)[solid]
    at, lengths = at[solid], lengths[solid]
    capital = _UPPER[raw[at]]
    shape = np.where(upper == 0, 0, np.where((upper == lengths) & (lengths > 1), 2, np.where((upper == 1) & (capital == 1), 1, 3)))
    shape = np.where(kind[at] == _DIGIT, 4, np.where(kind[at] == _SYMBOL, 5, shape))
    return Runs(first_doc + np.searchsorted(starts, at, side="right") - 1, mixed(hashes + lengths.astype(np.uint64)), shape)


def runs(texts: pa.StringArray) -> Iterator[Runs]:
    """Blocks of runs; a document's runs are in one block unless it is longer than BLOCK bytes."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    doc = 0
    while doc < len(texts):
        to = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + BLOCK, side="right")) - 1)
        begin, end = int(offsets[doc]), int(offsets[to])
        if to == doc + 1 and end - begin > BLOCK:
            while begin < end:
                stop = min(begin + BLOCK, end)
                if stop < end:
                    white = np.flatnonzero(_KIND[data[begin:stop]] == _WHITE)
                    stop = begin + int(white[-1]) + 1 if len(white) else stop
                yield _cut(data[begin:stop], np.zeros(1, np.int64), doc)
                begin = stop
        elif end > begin:
            yield _cut(data[begin:end], offsets[doc:to] - begin, doc)
        doc = to
