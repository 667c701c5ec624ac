"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what its predecessor wrote and works on all of it: low quality goes, of equal texts one stays, of near
copies (five-word shingles, similarity 0.8) one stays, personal data gives way to its kind in brackets, and what is
left is packed into sequences of 4096 tokens.

Defined cases: null texts count as empty; the classifier judges them by the score of a text without words, equal texts are
one group, texts without words are no near copies, and a null text stays null where personal data is redacted. Whole rows
stay or go: nulls in other columns, and columns besides, whatever their names, are carried along. A row without an id
stays as long as its text is not an exact copy. Of repeated rows one stays, and an id on several rows is judged by each
row's own text. Empty tables pass through every stage and give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, ngram_join, packing, pii, quality
from ledgerloom.llm.common import documents, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(spark, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(spark, docs, n=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(spark, docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else redacted


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Training, tokenising and the field's spans have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
