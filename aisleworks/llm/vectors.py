"""Reading embedding columns into checked rows of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import bounded_batches

SCHEMA = "vec_id long, dims int, data binary"


def checked_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, dims, data`` of every row; ``data`` holds doubles and is null where the vector is null, empty, all zero, or
    has a null or non-finite component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            dims, data = [], []
            for vector in batch.column(1):
                values = vector.values
                good = values is not None and len(values) > 0 and values.null_count == 0
                if good:
                    doubles = values.to_numpy(zero_copy_only=False).astype(np.float64)
                    good = bool(np.isfinite(doubles).all() and doubles.any())
                dims.append(len(doubles) if good else 0)
                data.append(doubles.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dims", "data"]
            )

    return table.select(F.col(id_column).cast("long"), F.col(vector_column)).mapInArrow(run, SCHEMA)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dims)
