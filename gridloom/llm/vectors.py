"""Rows of vectors as the two searches take them."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid(vectors: DataFrame, zero: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id`` and ``v`` of the rows whose vector has no null or non-finite component; ``zero``: the zero vector too.

    An empty vector takes no part; nor does a row whose vec_id is null.
    """
    x = F.col("embedding")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0)
    if not zero:
        good &= F.exists(x, lambda c: c != 0)
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), *keep)


def component_type(vectors: DataFrame) -> np.dtype:
    """float32 where the column holds floats, else float64."""
    return np.dtype(np.float32 if isinstance(vectors.schema["v"].dataType.elementType, T.FloatType) else np.float64)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch's vectors, all of length ``d``, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
