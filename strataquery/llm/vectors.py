"""Vectors out of Arrow lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not empty, all components finite numbers."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad, F.lit(False))


def by_dimension(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row indices and a matrix of doubles for each length of list that occurs."""
    lists = lists.cast(pa.list_(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]
