"""Vectors between Spark and numpy, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, without nulls and not of infinite, undefined or zero length."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vector.isNotNull() & (F.size(vector) > 0) & square.isNotNull() & ~F.isnan(square) & (square > 0) & (square < F.lit(float("inf")))


def vectors(table: DataFrame) -> DataFrame:
    """(v, e): id and vector of the rows that can be compared; null ids count as the largest.

    Vectors of 32-bit floats stay so on their way, which halves what is shuffled; all is worked out in 64 bits.
    """
    kind = table.schema["embedding"].dataType.simpleString()
    e = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    return table.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("v"), e.alias("e")).filter(usable(F.col("e")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of unit length from lists of the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
