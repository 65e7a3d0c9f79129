"""Restock urgency and quantity columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisleworks.functions.ladders import ladder
from aisleworks.functions.rounding import round_half_even

# --- fixed values -----------------------------------------------------------
URGENCY_CRITICAL = "🔴 CRITICAL — Stock out before delivery"
URGENCY_HIGH = "🟠 HIGH — Order within 2 days"
URGENCY_MEDIUM = "🟡 MEDIUM — Order this week"
URGENCY_LOW = "🟢 LOW — Monitor"
DEFAULT_LEAD_DAYS = 7
NEVER_DAYS = 999
# ----------------------------------------------------------------------------


def order_deadline(as_of: Column, lead_days: Column) -> Column:
    return F.date_add(as_of, F.greatest(F.lit(1), lead_days - 2).cast("int"))


def restock_urgency(days_left: Column, lead_days: Column, gap: Column, safety_stock: Column) -> Column:
    return ladder(
        [
            (days_left <= lead_days, URGENCY_CRITICAL),
            (days_left <= lead_days * 2, URGENCY_HIGH),
            (gap > safety_stock, URGENCY_MEDIUM),
        ],
        URGENCY_LOW,
    )


def restock_quantity(
    closing_stock: Column,
    safety_stock: Column,
    reorder_level: Column,
    lead_days: Column,
    forecast_7d_qty: Column,
) -> dict[str, Column]:
    closing, safety, reorder, forecast = (
        c.cast("double") for c in (closing_stock, safety_stock, reorder_level, forecast_7d_qty)
    )
    gap = reorder - closing
    from_gap = gap + safety
    from_forecast = F.greatest(forecast / 7.0 * lead_days + safety - closing, gap)
    quantity = F.when(forecast <= 0, from_gap).otherwise(from_forecast)
    # "+ 0.0" turns a rounded -0.0 into 0.0.
    return {
        "restock_qty": F.greatest(F.lit(0.0), round_half_even(quantity, 0)) + F.lit(0.0),
        "daily_demand_est": round_half_even(forecast / 7.0, 2),
        "method": F.when(forecast > 0, "forecast-based").otherwise("gap-based"),
    }


def urgency_rank(urgency: Column) -> Column:
    """0 critical, 1 high, 2 the rest."""
    return ladder([(urgency.contains("CRITICAL"), 0), (urgency.contains("HIGH"), 1)], 2)
