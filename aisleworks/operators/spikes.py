"""Demand spikes by z-score, and demand by weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.functions.ladders import DROP_ACTION, SPIKE_ACTION, or_default, spike_status
from aisleworks.functions.rounding import average, round_half_even, round_half_up
from aisleworks.operators import sales

WINDOW_DAYS = 31
STATUS_THRESHOLD = 2.0


def _unit_statistics(tx, date, product, category) -> DataFrame:
    # Units alone, so that the last day's subquery needs the same columns and reuses this exchange.
    daily = sales.daily_by_category(tx, date, product, category, WINDOW_DAYS).drop("daily_revenue")
    on_last_day = F.when(F.col("full_date") == sales.last_day(daily), F.col("daily_units"))
    return daily.groupBy("category_name").agg(
        average(F.sum("daily_units"), F.count("daily_units")).alias("mean"),
        F.stddev_samp("daily_units").alias("stddev"),
        F.max(on_last_day).alias("latest"),
    )


def _rounded_statistics(stats: DataFrame) -> DataFrame:
    return stats.select(
        "*",
        round_half_up(F.col("mean"), 2).alias("mean_units"),
        round_half_up(F.col("stddev"), 2).alias("stddev_units"),
        F.col("latest").cast("double").alias("latest_units"),
    )


def demand_spikes(
    tx: DataFrame, date: DataFrame, product: DataFrame, category: DataFrame, z_threshold: float = 2.0
) -> DataFrame:
    """Categories whose last day lies beyond the threshold; z from unrounded statistics."""
    # greatest() skips NULL, so a single-day category divides by 0.01.
    z = (F.col("latest") - F.col("mean")) / F.greatest(F.col("stddev"), F.lit(0.01))
    scored = _rounded_statistics(_unit_statistics(tx, date, product, category)).withColumn(
        "z_score", F.coalesce(round_half_up(z, 2), F.lit(0.0))
    )
    status = spike_status(F.col("z_score"), z_threshold)
    return scored.where(F.abs("z_score") > z_threshold).select(
        "category_name",
        "mean_units",
        "stddev_units",
        "latest_units",
        "z_score",
        status.alias("status"),
        F.when(status == "SPIKE", SPIKE_ACTION).otherwise(DROP_ACTION).alias("recommended_action"),
    )


def category_demand_status(
    tx: DataFrame, date: DataFrame, product: DataFrame, category: DataFrame
) -> DataFrame:
    """Every category; z from the two-decimal statistics, an idle last day counting as zero units."""
    stats = _rounded_statistics(_unit_statistics(tx, date, product, category))
    spread = F.greatest(or_default(F.col("stddev_units"), 0.01), F.lit(0.01))
    gap = F.coalesce(F.col("latest_units"), F.lit(0.0)) - F.coalesce(F.col("mean_units"), F.lit(0.0))
    return stats.withColumn("z_score", round_half_even(gap / spread, 2)).select(
        "category_name",
        "mean_units",
        "stddev_units",
        "latest_units",
        "z_score",
        spike_status(F.col("z_score"), STATUS_THRESHOLD).alias("status"),
    )


def daily_totals(tx: DataFrame, date: DataFrame) -> DataFrame:
    """Completed sales per calendar day: the whole fact table reduced before any other join."""
    per_day = (
        sales.completed_sales(tx)
        .groupBy("date_id")
        .agg(sales.revenue(), F.count("final_sale_value").alias("priced"), F.count("transaction_id").alias("txns"))
    )
    return per_day.join(date.select("date_id", "full_date"), "date_id")


def with_external(daily: DataFrame, external: DataFrame, *columns: str) -> DataFrame:
    """Left join on the date alone: each region's row of a day repeats that day's sales."""
    factors = external.select(F.col("record_date").alias("full_date"), *columns)
    return daily.join(factors, "full_date", "left")


def weather_demand(tx: DataFrame, date: DataFrame, external: DataFrame) -> DataFrame:
    days = with_external(
        daily_totals(tx, date), external, "weather_type", "temperature_c", "rainfall_mm"
    )

    def weighted(value: str):
        weight = F.when(F.col(value).isNotNull(), F.col("txns"))
        return average(F.sum(F.col(value) * F.col("txns")), F.sum(weight))

    grouped = days.groupBy("weather_type").agg(
        F.countDistinct("full_date").alias("days_count"),
        F.sum("txns").alias("total_transactions"),
        average(F.sum("revenue"), F.sum("priced")).alias("basket"),
        F.sum("revenue").alias("total_revenue"),
        weighted("temperature_c").alias("temp"),
        weighted("rainfall_mm").alias("rain"),
    )
    return grouped.select(
        F.coalesce("weather_type", F.lit("No External Data")).alias("weather_type"),
        "days_count",
        "total_transactions",
        round_half_up(F.col("basket"), 2).alias("avg_basket"),
        "total_revenue",
        round_half_up(F.col("temp"), 1).alias("avg_temp_c"),
        round_half_up(F.col("rain"), 2).alias("avg_rainfall_mm"),
    )
