"""Week-over-week revenue trends per category and per store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks.functions.ladders import trend_action, trend_label
from aisleworks.functions.rounding import average, round_half_up
from aisleworks.operators import sales

WINDOW_DAYS = 30


def _mean_where(condition: Column) -> Column:
    """Mean daily revenue over the selling days that satisfy ``condition``."""
    picked = F.when(condition, F.col("daily_revenue"))
    return average(F.sum(picked), F.count(picked))


def _week_over_week(daily: DataFrame, key: str, *extra: Column) -> DataFrame:
    age = F.col("age")
    this_week, week_before = age < 7, (age >= 7) & (age < 14)
    aged = daily.withColumn("age", F.datediff(sales.last_day(daily), "full_date"))
    periods = aged.groupBy(key).agg(
        _mean_where(this_week).alias("last_avg"), _mean_where(week_before).alias("prev_avg"), *extra
    )
    last, prev = F.col("last_avg"), F.col("prev_avg")
    change = (last - prev) / F.greatest(prev, F.lit(1.0)) * 100.0
    return periods.withColumn("change_pct", F.coalesce(round_half_up(change, 2), F.lit(0.0)))


def category_trends(tx: DataFrame, date: DataFrame, product: DataFrame, category: DataFrame) -> DataFrame:
    daily = sales.daily_by_category(tx, date, product, category, WINDOW_DAYS)
    trend = _week_over_week(
        daily,
        "category_name",
        F.sum("daily_revenue").alias("total_30d_revenue"),
        F.sum("daily_units").alias("total_30d_units"),
    )
    return trend.select(
        "category_name",
        round_half_up(F.col("last_avg"), 2).alias("last_7d_avg_revenue"),
        round_half_up(F.col("prev_avg"), 2).alias("prev_7d_avg_revenue"),
        "change_pct",
        trend_label(F.col("change_pct")).alias("trend_label"),
        "total_30d_revenue",
        "total_30d_units",
        trend_action(trend_label(F.col("change_pct"))).alias("recommended_action"),
    )


def store_trends(tx: DataFrame, date: DataFrame, store: DataFrame) -> DataFrame:
    daily = sales.daily_by_store(tx, date, store, WINDOW_DAYS)
    return _week_over_week(daily, "store_name").select(
        "store_name",
        round_half_up(F.col("last_avg"), 2).alias("last_7d_avg"),
        round_half_up(F.col("prev_avg"), 2).alias("prev_7d_avg"),
        "change_pct",
        trend_label(F.col("change_pct")).alias("trend_label"),
    )
