"""The daily grain of the sales as a table that merges keep up to date.

One row per day, product and store. A merge names the days it changes: those of its batch's rows and those that the rows it
replaces had before. These days are summed again from the facts, of which only their months' folders are read, so a late
sale, a return or a sale that moves to another day needs no rule of its own, and a repeated refresh changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aisleworks.operators import sales
from aisleworks.session import short_lived_shuffles
from aisleworks.sources.keyed_files import KeyedTable

SCHEMA = "date_id int, product_id string, store_id string, units bigint, revenue decimal(28,2), sales bigint"
GRAIN = ["date_id", "product_id", "store_id"]


def rollup_table(spark: SparkSession, path: str, facts: DataFrame | None = None) -> KeyedTable:
    """The table at ``path``; keys have the types of ``facts`` where they differ from the retail tables'."""
    schema = StructType.fromDDL(SCHEMA)
    if facts is not None:
        schema = StructType([facts.schema[f.name] if f.name in GRAIN else f for f in schema])
    return KeyedTable(spark, path, schema, tuple(GRAIN), (sales.MONTH, "CAST(FLOOR(date_id / 100) AS INT)"))


def daily_grain(tx: DataFrame) -> DataFrame:
    """Completed sales by day, product and store."""
    summed = sales.completed_sales(tx).groupBy(*GRAIN).agg(sales.units(), sales.revenue(), F.count(F.lit(1)).alias("sales"))
    return summed.withColumn("revenue", F.col("revenue").cast("decimal(28,2)"))


def changed_days(facts: KeyedTable, batch: DataFrame) -> DataFrame:
    """``date_id`` of every day that merging the batch changes; to be asked, and written, before the merge."""
    keys = list(facts.keys)
    stored = facts.read(facts.touched(batch)).select(*keys, "date_id")
    replaced = stored.join(batch.select(*keys).distinct(), keys, "left_semi").select("date_id")
    return replaced.union(batch.select("date_id")).where("date_id IS NOT NULL").distinct()


def refresh(rollup: KeyedTable, tx: DataFrame, days: DataFrame) -> None:
    """Sums the days again from the facts and puts them in the place of the stored ones.

    ``days`` has ``date_id`` rows, as many as there are days at most.
    """
    rollup.recover()
    wanted = days.select("date_id").distinct()
    with short_lived_shuffles(rollup.spark):
        span = wanted.agg(F.min("date_id"), F.max("date_id")).first()
    if span[0] is None:
        return
    within = tx.where(F.col("date_id").between(*span))
    if sales.MONTH in tx.columns:
        within = within.where(F.col(sales.MONTH).between(span[0] // 100, span[1] // 100))
    fresh = daily_grain(within.join(wanted, "date_id", "left_semi"))
    # files are known by ranges that start with the day
    old = sorted(
        name for name, r in rollup.ranges().items() if r["low"] is not None and r["low"][0] <= span[1] and span[0] <= r["high"][0]
    )
    kept = rollup.read(old).join(wanted, "date_id", "left_anti")
    rollup.replace(kept.select(rollup.columns).unionByName(fresh.select(rollup.columns)), old)


def as_facts(grain: DataFrame) -> DataFrame:
    """The grain in the shape of sales, for every report that sums units or revenue by day, product and store."""
    return grain.select(
        *GRAIN,
        F.col("units").alias("quantity_sold"),
        F.col("revenue").alias("final_sale_value"),
        F.lit(False).alias("is_return"),
        F.lit("Completed").alias("transaction_status"),
    )
