"""What a stream keeps of each key: its first row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_of_each(states: DataFrame, keys: list[str], at: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key that a stream brings.

    With ``at`` and ``within``, a time column and a span, a key is forgotten once the watermark has passed it by that span,
    so that what is remembered does not grow without end; without them it is remembered for good.
    """
    if at and within:
        return states.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
    return states.dropDuplicates(keys)
