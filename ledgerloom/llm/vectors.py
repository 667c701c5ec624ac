"""Vectors as whole numbers, for operators whose results must not hang on how floating point sums are ordered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def integer_vectors(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """(id, label, x array<long>) of every usable row, staged, and the vectors' width.

    x holds floor(scale * component). A row is usable if its vector is there, as wide as the table's widest, and of finite
    components alone: a null component, NaN, an infinity, and a component that a shorter vector lacks all drop the row.
    Components so large that squared distances or inner products would leave 64 bits are held at the largest size
    that cannot.
    """
    width = table.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = max(width, 0)
    most = float(2 ** int((62 - np.log2(max(width, 1))) // 2 - 1))
    whole = F.col("x").isNotNull() & (F.size("x") == width) & F.lit(width > 0)
    finite = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    given = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = given.filter(F.coalesce(whole & finite, F.lit(False)))
    floored = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))).cast("long"))
    return stage(kept.select("id", "label", floored.alias("x"))), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists, all ``width`` long, as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
