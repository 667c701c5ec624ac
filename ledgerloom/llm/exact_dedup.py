"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, so that each later batch meets it by a sort-merge
anti-join without shuffling what is already indexed; only unseen digests are appended. As long as each bucket is one
file the join needs no sort of the index either; after several appends it has one until ``compact`` merges the files.

Every digest stands with the batch that brought it. A batch that is added again under its name, as after a failure,
is held against the other batches only: it gets the same report, and what it had appended is not appended twice.

Defined cases: a null text counts as empty, and all empty texts are one group. A null id sorts after every other
id. Rows that repeat completely are one group of which exactly one row is kept. Extra columns are ignored, and
an empty batch appends nothing and returns no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, documents, remove, stage, text_or_empty, work_dir

#: The characters that do not count, as a regular expression.
IGNORED = "[\\x20\\x09-\\x0D]+"


class DigestIndex:
    """A digest table that outlives the session's data frames: ``digest -> keep_id`` of the row that was kept, and its batch."""

    def __init__(self, spark: SparkSession, table: str, location: str | None = None, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            spark.sql(
                f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                f"LOCATION '{location or work_dir(spark)}'"
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame, mode: str, **options: str) -> None:
        bucketed = rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.mode(mode).format("parquet").options(**options)
        bucketed.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def compact(self) -> None:
        """One sorted file for each bucket again."""
        self._write(stage(self.read()), "overwrite", path=work_dir(self.spark))

    def drop(self) -> None:
        """Forget the index, files included."""
        where = self.spark.sql(f"DESCRIBE FORMATTED {self.table}").filter("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {self.table}")
        remove(self.spark, where)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch within itself and against the index, append what is new, and report every row.

        Returns doc_id, keep_id, group_size (rows of this batch with the text), kept and text_sha256. A text that
        another batch brought has that batch's keep_id and no kept row.
        """
        again, batch = batch is not None, batch or uuid.uuid4().hex
        text = text_or_empty(text_col)
        rows = stage(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.unhex(F.sha2(F.regexp_replace(text, IGNORED, "").cast("binary"), 256)).alias("digest"),
                F.char_length(text).alias("n"),
                F.monotonically_increasing_id().alias("row"),
            )
        )
        first = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
        groups = stage(
            rows.groupBy("digest")
            .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
        )
        others = self.read().filter(F.col("batch") != batch)
        fresh = groups.join(others.select("digest").hint("merge"), "digest", "left_anti")
        known = groups.select("digest", "group_size").join(others.select("digest", "keep_id").hint("merge"), "digest")
        report = stage(fresh.unionByName(known, allowMissingColumns=True))
        new = report.filter("keep_row IS NOT NULL").select("digest", "keep_id", F.lit(batch).alias("batch"))
        if again:  # what an earlier try of this batch has appended
            new = new.join(self.read().filter(F.col("batch") == batch).select("digest").hint("merge"), "digest", "left_anti")
        self._write(new, "append")
        # Unique digests on the right, any number of copies on the left: the adaptive skew join may split a hot one.
        return rows.join(report, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Deduplicate one table against a new index of its own, which goes when the table is done."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    found = index.add(docs)
    index.drop()
    return found


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, whole rows, that exact deduplication keeps. Rows that repeat an id and its text stay once."""
    found = stage(exact_dedup(spark, docs).select("doc_id", "kept", "text_sha256"))
    stay = found.filter("kept").select(F.col("doc_id").alias("id"))
    gone = found.filter("NOT kept").select("doc_id").distinct()
    twice = stage(gone.join(stay, F.expr("doc_id <=> id"), "left_semi"))
    gone = gone.join(twice.withColumnRenamed("doc_id", "id"), F.expr("doc_id <=> id"), "left_anti")
    left = docs.join(broadcast_if_small(gone.withColumnRenamed("doc_id", "__gone")), F.expr("doc_id <=> __gone"), "left_anti")
    if twice.isEmpty():
        return left
    # Ids that are both kept and dropped stand on several rows: of those rows each text that is kept by the id stays once.
    named = twice.withColumnRenamed("doc_id", "__twice")
    same = F.sha2(F.regexp_replace(text_or_empty(), IGNORED, "").cast("binary"), 256)
    repeated = left.join(named, F.expr("doc_id <=> __twice"), "left_semi").withColumn("__digest", same)
    own = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept"))
    repeated = repeated.join(own, F.expr("doc_id <=> __id AND __digest = __kept"), "left_semi")
    first = repeated.withColumn("__n", F.row_number().over(Window.partitionBy("__digest").orderBy(F.char_length(text_or_empty()).desc())))
    return left.join(named, F.expr("doc_id <=> __twice"), "left_anti").unionByName(first.filter("__n = 1").select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
