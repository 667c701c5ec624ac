"""Vector codes by one codebook for each of several parts of a vector, learned from every row.

The rows become blocks of NumPy columns, part by part. In each round ``RDD.treeAggregate`` goes over the blocks: the distances
to a part's entries accumulate dimension by dimension, every row's part goes to its nearest entry, and ``np.add.at`` adds it to
tensors of whole sums and counts. The tensors, of one fixed size whatever the rows, are merged through a tree of tasks, so
the driver meets the last few only. All numbers are whole, so no order of merging changes a result.

Blocks are read from a staged table in each round; a lost executor costs its blocks of that round.

Defined cases: rows with a null vector or with null or non-finite components are dropped (see ``vectors``). A width that parts
do not divide is filled up with zeros. Of rows with one id, that with the smallest vector is the entry that a
codebook starts from; null ids come after all others. With fewer ids than entries, codebooks are smaller. Repeated
rows count as often as they stand. Without rows there is no result. Errors of equal labels are summed, nulls together;
a sum beyond 64 bits is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage
from .vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows of a block, and levels of the tree that merges sums.
BLOCK, DEPTH = 4096, 3


def _columns(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of vectors as (part, position, row), filled up with zeros."""
    rows, width = x.shape
    full = np.zeros((rows, -(-width // parts) * parts), np.int64)
    full[:, :width] = x
    return np.ascontiguousarray(full.T).reshape(parts, -(-width // parts), rows)


def _blocks(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = _columns(matrix(batch.column("x").slice(at, BLOCK), width), parts)
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary()), pa.array([block.shape[2]], pa.int32())], ["block", "rows"])

    return run


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, row): the nearest entry of each part's codebook, the lower of equally near ones, and its squared distance.

    block: (part, position, row). books: (part, position, entry).
    """
    codes = np.empty((block.shape[0], block.shape[2]), np.int64)
    errors = np.empty_like(codes)
    for part, (columns, book) in enumerate(zip(block, books)):
        distance = np.zeros((block.shape[2], books.shape[2]), np.int64)
        for column, entries in zip(columns, book):
            apart = column[:, None] - entries
            distance += apart * apart
        codes[part] = distance.argmin(1)
        errors[part] = np.take_along_axis(distance, codes[part][:, None], 1)[:, 0]
    return codes, errors


def _added(books: np.ndarray):
    def add(total: tuple[np.ndarray, np.ndarray] | None, row) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total or (np.zeros(books.shape, np.int64), np.zeros((books.shape[0], books.shape[2]), np.int64))
        block = np.frombuffer(row["block"], np.int64).reshape(books.shape[0], books.shape[1], row["rows"])
        codes, _ = nearest(block, books)
        for part in range(len(books)):
            np.add.at(counts[part], codes[part], 1)
            for position in range(books.shape[1]):
                np.add.at(sums[part, position], codes[part], block[part, position])
        return sums, counts

    return add


def _merged(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _start(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    ids = [r[0] for r in rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("id").isin([i for i in ids if i is not None])
    wanted = wanted | F.col("id").isNull() if None in ids else wanted
    first = rows.filter(wanted).groupBy("id").agg(F.min("x").alias("x")).orderBy(F.col("id").asc_nulls_last()).collect()
    return _columns(np.array([r["x"] for r in first], np.int64).reshape(len(first), width), parts)


def learned(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, position, entry) of staged integer vectors, after ``rounds`` rounds over all of them."""
    books = _start(rows, width, parts, entries)
    if not books.shape[2]:
        return books
    blocks = rows.select("x").mapInArrow(_blocks(width, parts), "block binary, rows int").rdd
    for _ in range(rounds):
        sums, counts = blocks.treeAggregate(None, _added(books), _merged, DEPTH)
        books = np.where(counts[:, None, :] > 0, sums // np.maximum(counts, 1)[:, None, :], books)
    return books


def _assigned(width: int, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                codes, errors = nearest(_columns(matrix(batch.column("x"), width), len(books)), books)
                digits, long = np.ascontiguousarray(codes.T).astype(np.uint8).tobytes().hex(), 2 * len(books)
                text = pa.array([digits[i : i + long] for i in range(0, len(digits), long)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), text, pa.array(errors.sum(0))], ["id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every row, staged, and the codebooks: codes hold two hex digits a part, so 256 entries at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    books = learned(rows, width, parts, entries, rounds)
    kinds = f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return stage(rows.mapInArrow(_assigned(width, books), kinds)), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, and the error of each, of its label and of nothing else, by codebooks learned from all of them."""
    rows, width = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded, books = compressed(rows, width)
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(broadcast_if_small(stage(of_label)), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as joins of all parts with all entries of their position."""
    steps = [
        "k AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings"
        " WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings) AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"w AS (SELECT max(len(v)) // {PARTS} AS d FROM k)",
        f"pieces AS (SELECT vec_id, label, p, v[p * d + 1 : p * d + d] AS c FROM k, w, range({PARTS}) r(p))",
        f"seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))",
        "b0 AS (SELECT p, e, c FROM pieces JOIN seed USING (vec_id))",
    ]
    near = "SELECT vec_id, label, p, any_value(q.c) AS c, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.c, b.c)])::BIGINT, 'e': b.e}}) AS m FROM pieces q JOIN b{0} b USING (p) GROUP BY ALL"
    for n in range(ROUNDS):
        steps += [
            f"a{n} AS ({near.format(n).replace('GROUP BY ALL', 'GROUP BY vec_id, label, p')})",
            f"s{n} AS (SELECT p, e, i, floor(sum(c[i])::DOUBLE / count(*))::BIGINT AS x FROM (SELECT p, m.e AS e, c, unnest(range(1, len(c) + 1)) AS i FROM a{n}) GROUP BY p, e, i)",
            f"b{n + 1} AS (SELECT p, e, coalesce(n.c, b.c) AS c FROM b{n} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS c FROM s{n} GROUP BY p, e) n USING (p, e))",
        ]
    steps += [
        f"a AS ({near.format(ROUNDS).replace('GROUP BY ALL', 'GROUP BY vec_id, label, p')})",
        "coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY vec_id, label)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, h"


OP11_SQL = _sql()
