"""Restock, stockout, expiry and margin decisions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.functions.calendar import as_date
from aisleworks.functions.ladders import ladder, or_default
from aisleworks.functions.pricing import clearance_price, expiry_discount
from aisleworks.functions.replenishment import (
    DEFAULT_LEAD_DAYS,
    NEVER_DAYS,
    order_deadline,
    restock_quantity,
    restock_urgency,
)
from aisleworks.functions.rounding import MONEY, round_half_up

# --- fixed values -----------------------------------------------------------
LOW_MARGIN_PCT = 10
BELOW_COST_LABEL = "🔴 SELLING BELOW COST"
NEAR_ZERO_LABEL = "🟠 NEAR ZERO MARGIN"
LOW_MARGIN_LABEL = "🟡 LOW MARGIN"
BELOW_COST_ACTION = "Raise price to at least cost + 5% OR renegotiate supplier cost"
THIN_MARGIN_ACTION = "Review pricing — margin too thin for sustainable business"
# ----------------------------------------------------------------------------


def latest_inventory(inventory: DataFrame) -> DataFrame:
    """Only the newest snapshot of each product and store; the reports take all unless given this."""
    newest = Window.partitionBy("product_id", "store_id").orderBy(F.desc("date_id"), F.desc("inventory_id"))
    return inventory.withColumn("_age", F.row_number().over(newest)).where("_age = 1").drop("_age")


def _goods(product: DataFrame, category: DataFrame, *columns: str) -> DataFrame:
    return product.select("product_id", "product_name", "category_id", *columns).join(
        category.select("category_id", "category_name"), "category_id"
    ).drop("category_id")


def _sourced_goods(product: DataFrame, category: DataFrame, supplier: DataFrame) -> DataFrame:
    """Products with category and supplier, joined among themselves so stock meets them once."""
    sources = supplier.select(
        "supplier_id", "supplier_name", "contact_phone", F.col("lead_time_days").alias("supplier_lead")
    )
    return _goods(product, category, "supplier_id").join(sources, "supplier_id")


def _lead_time():
    return F.coalesce("lead_time_days", "supplier_lead", F.lit(DEFAULT_LEAD_DAYS))


def restock_candidates(
    inventory: DataFrame,
    product: DataFrame,
    category: DataFrame,
    store: DataFrame,
    supplier: DataFrame,
    store_id=None,
    as_of: dt.date | str | None = None,
    zero_stock_critical: bool = False,
) -> DataFrame:
    """Stock at or below its reorder level, with deadline and urgency.

    An empty shelf counts as "never runs out" unless ``zero_stock_critical`` is
    set. ``raw_days_until_stockout`` keeps the figure before that substitution;
    orders are ranked by it.
    """
    low = inventory.where(
        (F.col("closing_stock") <= F.col("reorder_level")) & (F.col("closing_stock") >= 0)
    )
    if store_id is not None:
        low = low.where(F.col("store_id") == store_id)
    stocked = (
        low.select(
            "inventory_id", "product_id", "store_id", "closing_stock", "reorder_level", "safety_stock",
            "reorder_point", "lead_time_days", "unit_cost", "units_consumed",
        )
        .join(_sourced_goods(product, category, supplier), "product_id")
        .join(store.select("store_id", "store_name"), "store_id")
    )
    raw_days = F.when(
        F.col("units_consumed") > 0,
        round_half_up(F.try_divide(F.col("closing_stock"), F.col("units_consumed")), 1),
    ).otherwise(F.lit(float(NEVER_DAYS)))
    figures = stocked.withColumns(
        {
            "lead_time_days": _lead_time(),
            "restock_gap": (F.col("reorder_level") - F.col("closing_stock")).cast("double"),
            "current_stock_value": F.round(
                F.col("closing_stock") * F.col("unit_cost").cast(MONEY), 2
            ).cast(MONEY),
            "raw_days_until_stockout": raw_days,
        }
    )
    raw, lead = F.col("raw_days_until_stockout"), or_default(F.col("lead_time_days"), DEFAULT_LEAD_DAYS)
    days_left = (
        F.coalesce(raw, F.lit(float(NEVER_DAYS))) if zero_stock_critical else or_default(raw, float(NEVER_DAYS))
    )
    decided = figures.withColumns(
        {
            "days_until_stockout": days_left,
            "order_deadline": order_deadline(as_date(as_of), lead),
            "urgency": restock_urgency(
                days_left, lead, F.coalesce("restock_gap", F.lit(0.0)), F.coalesce("safety_stock", F.lit(0))
            ),
        }
    )
    return decided.select(
        "inventory_id", "product_id", "product_name", "category_name", "store_id", "store_name",
        "closing_stock", "reorder_level", "safety_stock", "reorder_point", "lead_time_days", "unit_cost",
        "supplier_id", "supplier_name", "contact_phone", "restock_gap", "current_stock_value",
        "days_until_stockout", "order_deadline", "urgency", "raw_days_until_stockout",
    )


def with_restock_quantity(
    items: DataFrame, forecast_column: str = "forecast_7d_qty", as_of: dt.date | str | None = None
) -> DataFrame:
    """Adds the quantity to order; needs stock, safety, reorder level, lead time and a forecast."""
    lead = or_default(F.col("lead_time_days"), DEFAULT_LEAD_DAYS)
    zero = F.lit(0)
    decision = restock_quantity(
        F.coalesce("closing_stock", zero),
        F.coalesce("safety_stock", zero),
        F.coalesce("reorder_level", zero),
        lead,
        F.coalesce(forecast_column, F.lit(0.0)),
    )
    return items.withColumns(
        {**decision, "lead_time_days": lead, "order_deadline": order_deadline(as_date(as_of), lead)}
    )


def stockout_alerts(
    inventory: DataFrame, product: DataFrame, category: DataFrame, store: DataFrame, supplier: DataFrame
) -> DataFrame:
    return (
        inventory.where(F.col("is_stockout") | (F.col("closing_stock") == 0))
        .select("product_id", "store_id", "closing_stock", "safety_stock", "lead_time_days")
        .join(_sourced_goods(product, category, supplier), "product_id")
        .join(store.select("store_id", "store_name"), "store_id")
        .select(
            "product_id", "product_name", "category_name", "store_id", "store_name", "closing_stock",
            "safety_stock", _lead_time().alias("lead_time_days"), "supplier_name", "contact_phone",
        )
    )


def expiry_alerts(
    inventory: DataFrame,
    product: DataFrame,
    category: DataFrame,
    store: DataFrame,
    as_of: dt.date | str | None = None,
    days_window: int = 90,
) -> DataFrame:
    """Stock that expires within the window, with its markdown and clearance price."""
    today = as_date(as_of)
    expiring = inventory.where(
        (F.col("closing_stock") > 0)
        & (F.col("expiry_date") >= today)
        & (F.col("expiry_date") <= F.date_add(today, days_window))
    ).select("inventory_id", "product_id", "store_id", "closing_stock", "unit_cost", "expiry_date")
    items = (
        expiring.join(_goods(product, category, "selling_price", "cost_price", "mrp"), "product_id")
        .join(store.select("store_id", "store_name"), "store_id")
        .withColumn("days_to_expiry", F.datediff("expiry_date", today))
        .withColumn(
            "value_at_risk",
            F.round(F.col("closing_stock") * F.col("unit_cost").cast(MONEY), 2).cast(MONEY),
        )
        .withColumns(expiry_discount(F.col("days_to_expiry")))
        .withColumns(clearance_price(F.col("selling_price"), F.col("cost_price"), F.col("discount_pct")))
    )
    return items.select(
        "inventory_id", "product_id", "product_name", "category_name", "store_id", "store_name",
        "closing_stock", "unit_cost", "selling_price", "cost_price", "mrp", "expiry_date", "days_to_expiry",
        "value_at_risk", "discount_pct", "discount_range", "label", "action", "urgency", "original_price",
        "clearance_price", "actual_discount_pct", "margin_after_pct", "floor_applied",
    )


def low_margin_products(product: DataFrame, category: DataFrame, supplier: DataFrame) -> DataFrame:
    sell, cost = F.col("selling_price").cast("double"), F.col("cost_price").cast("double")
    # Exact money difference first; only the ratio is inexact.
    gain = (F.col("selling_price").cast(MONEY) - F.col("cost_price").cast(MONEY)).cast("double")
    margin = F.try_divide(gain, sell) * 100.0
    thin = (
        _goods(product, category, "cost_price", "selling_price", "mrp", "supplier_id")
        .withColumn("_margin", margin.cast("decimal(38,10)"))
        .where(F.col("_margin") < LOW_MARGIN_PCT)
        .join(supplier.select("supplier_id", "supplier_name"), "supplier_id")
        .withColumn("margin_pct", round_half_up(F.col("_margin"), 2))
    )
    return thin.select(
        "product_id", "product_name", "category_name", "cost_price", "selling_price", "mrp",
        "supplier_name", "supplier_id", "margin_pct",
        ladder(
            [(sell < cost, BELOW_COST_LABEL), (F.col("_margin") < 5, NEAR_ZERO_LABEL)], LOW_MARGIN_LABEL
        ).alias("margin_label"),
        F.when(F.col("margin_pct") < 0, BELOW_COST_ACTION).otherwise(THIN_MARGIN_ACTION).alias(
            "recommended_action"
        ),
    )
