"""Exported CSV files as all-text DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

INGEST_ORDER = "_ingest_order"
#: Column with the whole line of a row that has more or fewer fields than the header.
MALFORMED = "_malformed"
#: How a quote stands inside quotes, and what becomes of malformed rows.
CSV = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}


def text_fields(header: list[str]) -> StructType:
    fields = StructType()
    for name in [*header, MALFORMED]:
        fields = fields.add(name, StringType())
    return fields


def read_export(
    spark: SparkSession, path: str | list[str], lower_header: bool = False, multiline: bool = False
) -> DataFrame:
    """Header row, every column STRING, plus ``_ingest_order`` and ``_malformed``.

    The order column ranks rows by file, position of the split in the file, and
    position in the split, so "first row wins" means the same on any cluster and
    after any retry. ``multiline`` allows line breaks inside quotes at the price
    of one task per file. A row without the header's number of fields keeps its line in ``_malformed``, by which the
    cleaning jobs reject it.
    """
    options = {"header": True, "multiLine": multiline, **CSV}
    header = spark.read.options(**options).csv(path).columns  # reads a line
    raw = spark.read.schema(text_fields(header)).options(**options).csv(path)
    if lower_header:
        raw = raw.toDF(*[name.lower() for name in raw.columns])
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.withColumn(INGEST_ORDER, position)


def parse_lines(lines: DataFrame, header: list[str], line: str = "value", carry: list[str] | None = None) -> DataFrame:
    """The same columns from a frame of CSV lines, such as those of a message queue; ``carry`` names columns kept beside them."""
    shape = ", ".join(f"`{f.name}` STRING" for f in text_fields(header))
    return lines.select(*(carry or []), F.from_csv(line, shape, CSV).alias("_fields")).select(*(carry or []), "_fields.*")
