"""Integer vectors out of a table of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers (an empty vector is)."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def scaled(vector: str, scale: int, most: int) -> Column:
    """floor(scale * x) of each component x, as int; numbers beyond most, which no embedding has, stop there."""
    clipped = lambda x: F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")))
    return F.transform(F.col(vector), lambda x: clipped(x).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of int64, short ones filled with zeros, components beyond width left out."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row[at < width], at[at < width]] = flat[at < width]
    return out
