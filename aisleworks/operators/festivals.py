"""Festival calendar, product recommendations and revenue uplift."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.functions.calendar import as_date
from aisleworks.functions.rounding import average, round_half_even, round_half_up
from aisleworks.operators import sales
from aisleworks.operators.spikes import daily_totals, with_external

SELLING_DAYS = 30

# --- fixed values -----------------------------------------------------------
LOW_STOCK_NOTE = "Low stock — order urgently"
ENOUGH_STOCK_NOTE = "Stock sufficient"
# ----------------------------------------------------------------------------


def upcoming_festivals(
    festival: DataFrame, as_of: dt.date | str | None = None, days_ahead: int = 30
) -> DataFrame:
    today, start = as_date(as_of), F.col("festival_start_date")
    return festival.where((start >= today) & (start <= F.date_add(today, days_ahead))).select(
        "festival_id",
        "festival_name",
        "religion",
        "festival_start_date",
        "festival_end_date",
        "festival_period_days",
        "is_national_holiday",
        "historically_consistent_uplift",
        "demand_level",
        "expected_demand_multiplier",
        F.datediff(start, today).alias("days_until"),
    )


def festival_product_recs(
    festival_products: DataFrame,
    product: DataFrame,
    category: DataFrame,
    inventory: DataFrame,
    tx: DataFrame,
    date: DataFrame,
    as_of: dt.date | str | None = None,
    festival_id: str | None = None,
) -> DataFrame:
    """Ranked products with stock and selling pace; all festivals in one job unless one is named."""
    wanted = festival_products
    if festival_id is not None:
        wanted = wanted.where(F.col("festival_id") == festival_id)
    wanted = wanted.select("festival_id", "rank", "product_id").distinct()

    listed = wanted.select("product_id").distinct()
    stock = (
        inventory.join(listed, "product_id", "left_semi")
        .groupBy("product_id")
        .agg(
            average(F.sum(F.col("closing_stock").cast("bigint")), F.count("closing_stock")).alias("closing"),
            average(F.sum(F.col("safety_stock").cast("bigint")), F.count("safety_stock")).alias("safety"),
        )
    )
    # One row per product and day first, so counting the days needs no DISTINCT.
    pace = (
        sales.sales_since(tx, date, F.date_sub(as_date(as_of), SELLING_DAYS))
        .join(listed, "product_id", "left_semi")
        .groupBy("product_id", "full_date")
        .agg(sales.units())
        .groupBy("product_id")
        .agg(average(F.sum("units"), F.count("full_date")).alias("pace"))
    )
    joined = (
        wanted
        .join(product.select("product_id", "product_name", "category_id", "mrp", "selling_price"), "product_id")
        .join(category.select("category_id", "category_name"), "category_id")
        .join(stock, "product_id", "left")
        .join(pace, "product_id", "left")
    )
    daily = round_half_up(F.coalesce("pace", F.lit(0.0)), 2)
    return (
        joined.withColumn("daily_avg_units", daily)
        .withColumn("avg_closing_stock", round_half_up(F.col("closing"), 0))
        .withColumn("recommended_extra_stock", round_half_even(F.col("daily_avg_units") * 2.0, 0))
        .select(
            "festival_id",
            "rank",
            "product_id",
            "product_name",
            "category_name",
            "mrp",
            "selling_price",
            "avg_closing_stock",
            round_half_up(F.col("safety"), 0).alias("avg_safety_stock"),
            "daily_avg_units",
            "recommended_extra_stock",
            F.when(
                F.coalesce("avg_closing_stock", F.lit(0.0)) < F.col("recommended_extra_stock"), LOW_STOCK_NOTE
            ).otherwise(ENOUGH_STOCK_NOTE).alias("stock_note"),
        )
    )


def festival_day_revenue(tx: DataFrame, date: DataFrame, external: DataFrame) -> DataFrame:
    days = with_external(daily_totals(tx, date), external, "is_festival")
    grouped = days.groupBy("is_festival").agg(
        F.countDistinct("full_date").alias("days_count"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("txns").alias("total_transactions"),
    )
    per_day = F.col("total_revenue").cast("double") / F.greatest("days_count", F.lit(1))
    return grouped.select(
        F.when(F.col("is_festival"), "Festival Day")
        .when(~F.col("is_festival"), "Normal Day")
        .otherwise("No External Data")
        .alias("day_type"),
        "is_festival",
        "days_count",
        "total_revenue",
        round_half_up(per_day, 2).alias("avg_daily_revenue"),
        "total_transactions",
    )


def festival_uplift(tx: DataFrame, date: DataFrame, external: DataFrame) -> DataFrame:
    """One row comparing festival with normal days; an absent kind of day counts as zero."""
    def of(day_type: str):
        picked = F.max(F.when(F.col("day_type") == day_type, F.col("avg_daily_revenue")))
        return F.coalesce(picked, F.lit(0.0))

    averages = festival_day_revenue(tx, date, external).agg(
        of("Festival Day").alias("festival_avg_daily"), of("Normal Day").alias("normal_avg_daily")
    )
    festive, normal = F.col("festival_avg_daily"), F.col("normal_avg_daily")
    uplift = (festive - normal) / F.greatest(normal, F.lit(1.0)) * 100.0
    return averages.select(
        round_half_even(uplift, 2).alias("festival_uplift_pct"), "festival_avg_daily", "normal_avg_daily"
    )
