"""The session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ANSI arithmetic, UTC dates, adaptive plans, and the last value where a map key repeats.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("ledgerloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that all machines see: below ``spark.checkpoint.dir``, else (outside of a local session) the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to all shuffle partitions. Adaptive plans merge those of few bytes, which leaves cores without work
    where a byte takes long; they do not merge partitions whose number is given."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
