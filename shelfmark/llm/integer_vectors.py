"""Vectors as whole numbers: which rows take part, and their components scaled and floored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND = 1 << 26  # scaled components are held within it, so that sums of products fit 64 bits


def usable(embedding: str, dim: int | None = None) -> Column:
    """Vectors with a component, none of them null or non-finite, and ``dim`` of them if told."""
    vector, infinity = F.col(embedding), F.lit(float("inf"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == infinity))
    length = F.size(vector) > 0 if dim is None else F.size(vector) == dim
    return F.coalesce(vector.isNotNull() & length & ~odd, F.lit(False))


def scaled(lists: pa.Array, factor: int) -> np.ndarray:
    """``floor(factor * x)`` of each component x as double, for lists of one length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(factor * flat), -BOUND, BOUND).astype(np.int32).reshape(len(lists), -1)
