"""Numeric vectors in Arrow batches, as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) for each length of vector: values as double precision, one row for each of rows. Null vectors and those
    with null or non-finite components are left out."""
    column = column.cast(pa.list_(pa.float64()))
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lengths = column.drop_null().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        values = flat[starts[own][:, None] + np.arange(size)]
        good = np.isfinite(values).all(1)
        yield there[own[good]], values[good]


def gathered(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The same rows in batches of `least` rows or little more, but for the last."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if any(map(len, held)):
        yield pd.concat(held, ignore_index=True)
