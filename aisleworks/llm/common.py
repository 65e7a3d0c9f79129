"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleworks.session import shared_folder, ship_package  # noqa: F401

#: White space between words, as every word contract of this package has it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Folders named within ``temporary_tables`` blocks, the innermost block's last.
_SCOPES: list[list[str]] = []


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that all executors share; inside ``temporary_tables`` it goes when the block ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote to the shared folder within it.

    An operator's result may still read its tables, so it has to be written, elsewhere, before the block ends.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut by files that outlive executors."""
    path = path or run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Characters up to which a chunk between white space is kept by a worker's table of chunks already seen. Longer ones, such
#: as paragraphs of a script without spaces or encoded data, hardly come twice; so a table's bytes are bounded by its entries.
KEPT_CHARACTERS = 48

#: Rows of a few numbers up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast only if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def crc_mod(id_column: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def two_columns(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the id and the text, under fixed names, so other columns can't clash with those an operator adds."""
    return df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def bounded_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` (one row at least), so working memory doesn't follow row width."""
    for batch in batches:
        rows, size = batch.num_rows, max(batch.nbytes, 1)
        step = max(1, int(rows * most_bytes / size)) if size > most_bytes else max(rows, 1)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [text or "" for text in column.to_pylist()]


def literal_splitter(*literals: str) -> re.Pattern:
    return re.compile("|".join(map(re.escape, literals)))


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        values = values.astype(np.uint64, copy=True)
        values ^= values >> np.uint64(33)
        values *= np.uint64(0xFF51AFD7ED558CCD)
        values ^= values >> np.uint64(33)
        values *= np.uint64(0xC4CEB9FE1A85EC53)
        values ^= values >> np.uint64(33)
    return values
