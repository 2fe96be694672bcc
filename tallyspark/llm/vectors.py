"""Vector columns: which rows hold a whole vector, and their matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether an array is there and holds neither nulls nor non-finite entries."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd, F.lit(False))


def steps(vector: str, scale: float, offset: int, most: int) -> Column:
    """floor(scale * entry) + offset of each entry as long; steps beyond ``most`` either way count as ``most``."""
    return F.transform(vector, lambda c: (F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(most))), F.lit(float(most)))) + offset).cast("long"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column (no nulls) by length: their numbers, and one matrix of them."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        places = (ends[at] - length)[:, None] + np.arange(length)
        yield at, values[places]
