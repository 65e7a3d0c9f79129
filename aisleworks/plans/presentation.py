"""Row order of the reports, applied only where a result leaves the engine.

Descending order puts NULL first and ascending order puts it last, as the
reports always had it; Spark's own defaults are the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.functions.replenishment import urgency_rank
from aisleworks.session import materialize


def _up(name: str) -> Column:
    return F.asc_nulls_last(name)


def _down(name: str) -> Column:
    return F.desc_nulls_first(name)


def _orders() -> dict[str, list[Column]]:
    return {
        "category_trends": [_down("change_pct"), _up("category_name")],
        "store_trends": [_down("change_pct"), _up("store_name")],
        "demand_spikes": [_down("z_score"), _up("category_name")],
        "category_demand_status": [_down("mean_units"), _up("category_name")],
        "weather_demand": [_down("total_revenue")],
        "upcoming_festivals": [_up("festival_start_date"), _up("festival_id")],
        "festival_product_recs": [_up("festival_id"), _up("rank")],
        "store_category_preferences": [_up("store_id"), _up("rank"), _up("category_name")],
        "seasonal_category_mix": [_up("season"), _up("rank_in_season"), _up("category_name")],
        "payment_preference": [_up("store_id"), _down("txn_count"), _up("payment_mode")],
        "customer_type_breakdown": [_up("store_id"), _down("total_transactions"), _up("customer_type")],
        "restock_candidates": [_down("restock_gap"), _up("raw_days_until_stockout"), _up("inventory_id")],
        "stockout_alerts": [_up("category_name"), _up("store_id"), _up("product_id")],
        "expiry_alerts": [_up("days_to_expiry"), _up("inventory_id")],
        "low_margin_products": [_up("margin_pct"), _up("product_id")],
        "top_demand_forecast": [_up("store_id"), _down("total_7d_forecast"), _up("product_id")],
        "feature_importance": [_down("importance"), _up("feature")],
        "restock_orders": [urgency_rank(F.col("urgency")), _up("store_id"), _up("order_seq")],
        "supplier_orders": [_up("earliest_deadline"), _up("supplier_id")],
    }


#: Bits of ``monotonically_increasing_id`` that count within a partition.
WITHIN = 33


def with_position(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``position``, from 1, in the order.

    A range sort gives every partition a stretch of the order; rows are counted within partitions and partitions by a running
    sum over one row each, so no task sees more than its stretch. The sorted rows are written once, to be ``release``d.
    """
    rows = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "in-order")
    stretch = F.shiftright("_place", WITHIN)
    sizes = rows.groupBy(stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_place").bitwiseAND((1 << WITHIN) - 1) + 1
    placed = rows.withColumn("_stretch", stretch).join(starts, "_stretch")
    return placed.select(*df.columns, position.alias("position"))


def presented(report: str, df: DataFrame) -> DataFrame:
    """The report with each row's place in its order as a column, which outlives any further shuffle."""
    return with_position(df, _orders()[report])


def present(report: str, df: DataFrame) -> DataFrame:
    """The report in its order; one without an order is returned as it is."""
    order = _orders().get(report)
    return df.orderBy(*order) if order else df
