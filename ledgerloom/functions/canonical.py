"""Digests of JSON records that other tools can make as well: SHA-256 of a canonical text, byte for byte.

The canonical text has its keys in order, ``", "`` and ``": "`` between its parts, letters beyond ASCII as they are, numbers as
Python writes them, null for a key that is not there, and top-level lists in order, so that their own order does not count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys of a record whose values count as its content.
CONTENT = ("stand", "modules", "coverage", "leistungen", "ausschluesse", "besonderheiten", "beitrag")


def _text(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _in_order(items: list) -> list:
    """Items sorted; of kinds that do not compare, by their own canonical text."""
    try:
        return sorted(items)
    except TypeError:
        return sorted(items, key=_text)


def canonical_text(record: dict, keys: Iterable[str] = CONTENT) -> str:
    chosen = {key: record.get(key) for key in keys}
    return _text({key: _in_order(value) if isinstance(value, list) else value for key, value in chosen.items()})


def _digest_of(keys: tuple[str, ...]) -> Callable[[str | None], str | None]:
    def one(text: str | None) -> str | None:
        try:
            record = json.loads(text) if text else None
        except ValueError:
            return None
        return hashlib.sha256(canonical_text(record, keys).encode("utf-8", "surrogatepass")).hexdigest() if isinstance(record, dict) else None

    return one


def content_digest(record: Column, keys: tuple[str, ...] = CONTENT) -> Column:
    """Digest of a column of JSON texts, in Arrow batches; null for null, for broken texts and for what is no object.

    It takes texts and not VARIANT, whose numbers no longer tell 1 from 1.0.
    """
    one = _digest_of(tuple(keys))

    @F.pandas_udf("string")
    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return digests(record)
