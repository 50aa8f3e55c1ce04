"""Validated vectors and Arrow helpers for the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that can take part: not null, not zero, every component a finite number."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(fine & F.exists("v", lambda x: x != 0))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of a list column, one for each length of vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    lens = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    offs = np.cumsum(lens) - lens
    out = []
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        out.append((rows, flat[offs[rows][:, None] + np.arange(d)]))
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b in double precision, alike for equal rows.

    Rows are scaled by their largest component first (by powers of two, which is exact), so nothing overflows.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
