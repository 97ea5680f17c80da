"""Helpers for tables of vectors: which rows can be compared, one row per id,
and blocks of one length inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: str = "embedding") -> Column:
    """True where a vector is there, is not empty and all its components are finite numbers."""
    inf = F.lit(float("inf"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def one_row_per_id(vectors: DataFrame, *columns: str) -> DataFrame:
    """``vec_id`` with ``columns`` of one of its rows: the smallest, in the
    order of the columns. Rows without an id go."""
    best = F.min(F.struct(*columns)).alias("_r")
    return vectors.filter("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(best).select("vec_id", "_r.*")


def matrix(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    """The vectors at ``rows`` of a list column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths := column.value_lengths().to_numpy()) - lengths
    return flat[starts[rows][:, None] + np.arange(length)]


def blocks(batches: Iterator[pa.RecordBatch], rows: int, scalars: tuple[str, ...], vector: str = "embedding") -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of about ``rows`` rows with vectors of one length, in the order
    they come: the scalar columns as arrays, then the matrix."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def flush(length):
        return tuple(np.concatenate(parts) for parts in zip(*held.pop(length), strict=True))

    for b in batches:
        col = b.column(b.schema.get_field_index(vector))
        sizes = col.value_lengths().to_numpy()
        given = [b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in scalars]
        for length in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == length)
            for at in range(0, len(own), rows):
                part = own[at : at + rows]
                held.setdefault(length, []).append((*(g[part] for g in given), matrix(col, part, length)))
                if sum(len(h[0]) for h in held[length]) >= rows:
                    yield flush(length)
    for length in list(held):
        yield flush(length)
