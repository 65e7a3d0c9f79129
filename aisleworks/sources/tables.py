"""The star schema as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from aisleworks import schemas
from aisleworks.sources.keyed_files import KeyedTable
from aisleworks.sources.snapshots import Rule, deltas, read_merged


@dataclass
class Tables:
    """One DataFrame per table; a report only touches the ones it names."""

    brand: DataFrame | None = None
    category: DataFrame | None = None
    supplier: DataFrame | None = None
    store: DataFrame | None = None
    customer: DataFrame | None = None
    date: DataFrame | None = None
    festival: DataFrame | None = None
    festival_products: DataFrame | None = None
    external_factors: DataFrame | None = None
    product: DataFrame | None = None
    inventory: DataFrame | None = None
    transaction: DataFrame | None = None


def keyed_table(spark: SparkSession, table: str, path: str) -> KeyedTable:
    return KeyedTable(spark, path, schemas.struct(table), tuple(schemas.KEYS[table]), schemas.PARTITIONED.get(table))


def overwrite_rule(table: str) -> Rule:
    touched = "updated_at" if "updated_at" in schemas.columns(table) else None
    return Rule(schemas.OVERWRITTEN[table], touched)


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One table by its declared schema: no inference, no listing of footers.

    Batches that an overwritten table holds aside are merged in. Tables dealt to folders keep the folder column, by which
    Spark leaves folders out.
    """
    if name in schemas.OVERWRITTEN:
        table = keyed_table(spark, name, path)
        if deltas(table):
            return read_merged(table, overwrite_rule(name))
    return spark.read.schema(schemas.SCHEMAS[name]).parquet(path)


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The tables under ``folder``."""
    return Tables(**{name: read_table(spark, name, f"{folder}/{name}") for name in schemas.SCHEMAS})


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.struct(name))
