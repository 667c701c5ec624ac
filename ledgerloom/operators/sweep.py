"""A standing relation of violations, brought up to date from the records that have changed since a mark.

The mark is each record's digest at the last sweep. Only records that are new or whose digest differs are checked again; what they
broke before is replaced, and what records broke that are gone is taken back. The cost of a sweep is that of the changed
records and of two joins by key, however many records stand.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sweep(NamedTuple):
    violations: DataFrame  #: what holds now
    marks: DataFrame  #: (key, digest) for the next sweep
    events: DataFrame  #: violations that came and went: their columns and kind, ``new`` or ``retracted``


def changed(records: DataFrame, marks: DataFrame, key: str = "stem", digest: str = "digest") -> DataFrame:
    """Records that are new or have another digest than at the mark; a null digest never counts as known."""
    known = marks.select(F.col(key).alias("__key"), F.col(digest).alias("__digest"))
    return records.join(known, (F.col(key) == F.col("__key")) & (F.col(digest) == F.col("__digest")), "left_anti")


def sweep(records: DataFrame, marks: DataFrame, violations: DataFrame, check: Callable[[DataFrame], DataFrame], key: str = "stem", digest: str = "digest") -> Sweep:
    """``check`` gives the violations of some records, with the columns of ``violations``, ``key`` among them."""
    anew = changed(records, marks, key, digest)
    gone = marks.select(key).join(records.select(key), key, "left_anti")
    touched = anew.select(key).unionByName(gone).distinct()
    fresh = check(anew).select(*violations.columns).distinct()
    before = violations.join(touched, key, "left_semi")
    events = fresh.exceptAll(before).withColumn("kind", F.lit("new")).unionByName(before.exceptAll(fresh).withColumn("kind", F.lit("retracted")))
    return Sweep(violations.join(touched, key, "left_anti").unionByName(fresh), records.select(key, digest), events)
