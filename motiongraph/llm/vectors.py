"""Vector columns: which rows are usable, Arrow lists as matrices, packed blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for a vector that is not null and has only finite components."""
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrices(column: pa.Array):
    """(rows, matrix of doubles) for each length of the vectors in a list column."""
    size = np.asarray(pc.list_value_length(column))
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, values.astype(np.float64).reshape(len(at), int(d))


def from_bytes(b: pa.Scalar, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b.as_buffer(), kind).reshape(shape)
