"""Vectors of a table as integers, for the operators that cluster and compress them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import quoted

#: Integers of which squared distances of up to 64 dimensions fit into 64 bits.
LARGEST = 2**27


def whole(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector holds finite numbers only, and ``dims`` of them."""
    kept = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(kept if dims is None else kept & (F.size(vector) == dims), F.lit(False))


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite numbers; raises where that is beyond :data:`LARGEST`, as distances would not be exact."""
    out = np.floor(values.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"components times {scale} must lie within {LARGEST}")
    return out.astype(np.int64)


def matrices(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch's rows whose last column is a whole vector of ``dims`` components, and those as integers."""
    for batch in batches:
        vector = batch.column(batch.num_columns - 1)
        batch = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(vector), -1), dims))
        flat = batch.column(batch.num_columns - 1).flatten().cast(pa.float64())
        values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
        finite = np.isfinite(values).all(1)
        if finite.any():
            yield batch.filter(pa.array(finite)), floors(values[finite], scale)


def named(table: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, by new names."""
    return table.select(*[F.col(quoted(c)).alias(n) for n, c in columns.items()])
