"""Retail roles as DataFrames over the driver tables.

The same expressions are written as SQL in ``oracle.py``. Every role grows with
the driver tables; nothing is sampled.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AS_OF = "2001-07-15"
FESTIVAL_AS_OF = "2001-06-10"
STOCK_AS_OF = "2001-08-02"
SEGMENTS = {"MACHINERY": "NEW", "FURNITURE": "REPEAT", "BUILDING": "INACTIVE"}
MONEY = "decimal(18,2)"


def date_id(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.day(day)


_SCHEMAS: dict[str, StructType] = {}


def read_driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file footer once."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


class Roles:
    """Roles over one folder; each is built once and shared by what a query needs it for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return read_driver_table(self.spark, self.folder, name)

    # --- dimensions -------------------------------------------------------

    @lru_cache
    def date(self) -> DataFrame:
        days = self.raw("orders").select(F.col("o_orderdate").cast("date").alias("full_date")).distinct()
        d, month = F.col("full_date"), F.month("full_date")
        return days.select(
            date_id(d).alias("date_id"),
            "full_date",
            F.date_format(d, "EEEE").alias("day_name"),
            month.alias("month_number"),
            F.weekday(d).isin(5, 6).alias("is_weekend"),
            F.when(month.isin(12, 1, 2), "Winter")
            .when(month.between(3, 5), "Summer")
            .when(month.between(6, 9), "Monsoon")
            .otherwise("Autumn")
            .alias("season"),
        )

    @lru_cache
    def external(self) -> DataFrame:
        d = F.col("full_date")
        day, month = F.day(d), F.month(d)
        return (
            self.date()
            .where(day % 10 != 0)
            .withColumn("r_regionkey", day % 5)
            .join(self.raw("region"), "r_regionkey")
            .select(
                F.col("date_id").alias("factor_id"),
                d.alias("record_date"),
                F.col("r_name").alias("region"),
                (F.lit(15.0) + month).alias("temperature_c"),
                F.when(month.between(6, 9), (day % 7).cast("double")).otherwise(0.0).alias("rainfall_mm"),
                F.element_at(F.array(*map(F.lit, ["Sunny", "Cloudy", "Rainy", "Foggy"])), month % 4 + 1).alias(
                    "weather_type"
                ),
                (day % 9 == 0).alias("is_festival"),
                (day % 15 == 0).alias("is_public_holiday"),
                month.isin(2, 5, 11, 12).alias("is_marriage_season"),
            )
        )

    @lru_cache
    def product(self) -> DataFrame:
        suppliers = self.raw("supplier").agg(F.count(F.lit(1)))
        retail = F.round(F.col("p_retailprice").cast("decimal(18,4)"), 2).cast(MONEY)
        return (
            self.raw("part")
            .select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.col("p_type").alias("category_id"),
                (F.col("p_partkey") % suppliers.scalar()).alias("supplier_id"),
                F.col("p_size").alias("pack_size"),
                retail.alias("mrp"),
                F.round(retail * F.lit("0.95").cast("decimal(4,2)"), 2).cast(MONEY).alias("selling_price"),
                F.round(retail * (F.lit(80) + F.col("p_partkey") % 30).cast("decimal(4,0)") / 100, 2)
                .cast(MONEY)
                .alias("cost_price"),
            )
        )

    @lru_cache
    def category(self) -> DataFrame:
        return self.raw("part").select(F.col("p_type").alias("category_id")).distinct().select(
            "category_id", F.col("category_id").alias("category_name")
        )

    @lru_cache
    def store(self) -> DataFrame:
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("store_id"),
                F.col("n_name").alias("store_name"),
                F.col("r_name").alias("city"),
                F.col("r_name").alias("region"),
            )
        )

    @lru_cache
    def customer(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        kind = None
        for name, label in SEGMENTS.items():
            kind = F.when(segment == name, label) if kind is None else kind.when(segment == name, label)
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"), kind.otherwise(segment).alias("customer_type")
        )

    @lru_cache
    def supplier(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.concat(F.lit("98"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("contact_phone"),
            (F.lit(5) + F.col("s_suppkey") % 8).cast("int").alias("lead_time_days"),
        )

    # --- facts ------------------------------------------------------------

    @lru_cache
    def transaction(self) -> DataFrame:
        """Order lines as sales."""
        lines = self.raw("lineitem")
        orders = self.raw("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
        )
        stores = self.raw("supplier").select("s_suppkey", "s_nationkey")
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
                date_id(F.col("o_orderdate")).alias("date_id"),
                F.col("s_nationkey").alias("store_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_quantity").cast("int").alias("quantity_sold"),
                F.round(net.cast("decimal(28,8)"), 2).cast(MONEY).alias("final_sale_value"),
                F.col("o_orderpriority").alias("payment_mode"),
                F.when(F.col("o_orderstatus") == "F", "Completed").otherwise(F.col("o_orderstatus")).alias(
                    "transaction_status"
                ),
                (F.col("l_returnflag") == "R").alias("is_return"),
            )
        )

    @lru_cache
    def inventory(self) -> DataFrame:
        """Every part in the stores that have sold it."""
        p, n = F.col("p_partkey"), F.col("store_id")
        sellers = self.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("store_id"))
        sold = (
            self.raw("lineitem")
            .select("l_partkey", "l_suppkey")
            .distinct()
            .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("l_partkey", "store_id")
            .distinct()
        )
        parts = self.raw("part").select("p_partkey", "p_size", "p_retailprice")
        stocked = parts.join(sold, F.col("p_partkey") == F.col("l_partkey"))
        today = F.lit(STOCK_AS_OF).cast("date")
        closing = ((p * 7 + n * 13) % 120).cast("int")
        return stocked.select(
            F.concat_ws("-", p, n).alias("inventory_id"),
            p.alias("product_id"),
            n.alias("store_id"),
            F.lit(20010802).alias("date_id"),
            closing.alias("closing_stock"),
            (F.lit(40) + F.col("p_size")).cast("int").alias("reorder_level"),
            (F.lit(30) + F.col("p_size")).cast("int").alias("reorder_point"),
            (F.lit(10) + F.col("p_size") % 20).cast("int").alias("safety_stock"),
            ((p + n) % 9).cast("int").alias("units_consumed"),
            F.when(p % 5 != 0, (F.lit(3) + p % 10).cast("int")).alias("lead_time_days"),
            F.round(F.col("p_retailprice").cast("decimal(18,4)") * F.lit("0.8").cast("decimal(3,1)"), 2)
            .cast(MONEY)
            .alias("unit_cost"),
            F.when(p % 11 != 0, F.date_add(today, ((p * 3 + n * 5) % 120 - 10).cast("int"))).alias("expiry_date"),
            (p % 97 == 0).alias("is_stockout"),
        )

    @lru_cache
    def festival(self) -> DataFrame:
        """One festival in the middle of each month that has orders."""
        month = F.trunc(F.col("o_orderdate").cast("date"), "month")
        months = self.raw("orders").select(month.alias("m")).distinct()
        ordinal = F.year("m") * 12 + F.month("m")
        first = months.agg(F.min(ordinal))
        k = (ordinal - first.scalar() + 1).alias("k")
        return months.select("m", k).select(
            "k",
            F.concat(F.lit("FES"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("festival_id"),
            F.concat(F.lit("Festival "), F.col("k").cast("string")).alias("festival_name"),
            F.element_at(F.array(*map(F.lit, ["North", "South", "East"])), F.col("k") % 3 + 1).alias("religion"),
            F.date_add("m", 14).alias("festival_start_date"),
            F.date_add("m", (F.col("k") % 3 + 14).cast("int")).alias("festival_end_date"),
            (F.col("k") % 3 + 1).alias("festival_period_days"),
            (F.col("k") % 4 == 0).alias("is_national_holiday"),
            (F.col("k") % 2 == 0).alias("historically_consistent_uplift"),
            F.when(F.col("k") % 2 == 0, "High").otherwise("Medium").alias("demand_level"),
            (F.lit(1.0) + (F.col("k") % 5) * 0.25).alias("expected_demand_multiplier"),
        )

    @lru_cache
    def festival_products(self) -> DataFrame:
        parts = self.raw("part").agg(F.count(F.lit(1)))
        ranked = self.festival().select("festival_id", "k", F.explode(F.array(*map(F.lit, [1, 2, 3]))).alias("rank"))
        return ranked.select(
            "festival_id", ((F.col("k") * 7 + F.col("rank")) % parts.scalar()).alias("product_id"), "rank"
        )

    @lru_cache
    def forecast_tables(self) -> dict[str, DataFrame]:
        return {
            "tx": self.transaction(),
            "date": self.date(),
            "product": self.product(),
            "category": self.category(),
            "store": self.store(),
            "external": self.external(),
        }

    @lru_cache
    def stand_in_forecast(self) -> DataFrame:
        """A forecast that SQL can state too: a week's worth of the average units per sale."""
        return (
            self.transaction()
            .groupBy("product_id", "store_id")
            .agg((F.sum("quantity_sold") * 7.0 / (F.count(F.lit(1)) * 10)).alias("forecast_7d_qty"))
        )
