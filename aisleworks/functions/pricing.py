"""Expiry markdown and clearance price columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisleworks.functions.ladders import ladder
from aisleworks.functions.rounding import round_half_even

# --- fixed values: (days up to, least %, most %, label) ---------------------
EXPIRY_TIERS = [
    (7, 40, 50, "🔴 CRITICAL"),
    (15, 25, 35, "🟠 HIGH"),
    (30, 20, 30, "🟡 MEDIUM-HIGH"),
    (60, 10, 20, "🟢 MEDIUM"),
    (90, 5, 10, "🔵 LOW"),
]
EXPIRED_PCT = 50
EXPIRED_LABEL = "🔴 EXPIRED / CLEARANCE"
EXPIRED_ACTION = "Pull from shelf immediately. Donate or discard."
FRESH_LABEL = "✅ FRESH"
FRESH_ACTION = "No discount needed."
COST_FLOOR_FACTOR = 1.01
# ----------------------------------------------------------------------------


def expiry_discount(days: Column) -> dict[str, Column]:
    """Markdown columns for a number of days to expiry."""
    def pick(expired, of_tier, fresh):
        rules = [(days <= 0, expired)]
        rules += [(days <= tier[0], of_tier(tier)) for tier in EXPIRY_TIERS]
        return ladder(rules, fresh)

    def midpoint(tier):
        return (tier[1] + tier[2]) // 2

    pct = pick(EXPIRED_PCT, midpoint, 0)
    apply_text = F.format_string("Apply %d%% discount immediately. Sell within %d days.", pct, days)
    return {
        "discount_pct": pct,
        "discount_range": pick(
            F.lit(None).cast("string"),
            lambda tier: f"{tier[1]}–{tier[2]}%",
            F.lit(None).cast("string"),
        ),
        "label": pick(EXPIRED_LABEL, lambda tier: tier[3], FRESH_LABEL),
        "action": pick(EXPIRED_ACTION, lambda tier: apply_text, FRESH_ACTION),
        "urgency": ladder(
            [(days <= 7, "IMMEDIATE"), (days <= 15, "HIGH"), (days <= EXPIRY_TIERS[-1][0], "MEDIUM")],
            "NONE",
        ),
    }


def clearance_price(selling_price: Column, cost_price: Column, discount_pct: Column) -> dict[str, Column]:
    """Discounted price held above a floor just over cost; NULL percentages where a price is zero."""
    sell = F.coalesce(selling_price.cast("double"), F.lit(0.0))
    cost = F.coalesce(cost_price.cast("double"), F.lit(0.0))
    discounted = sell * (F.lit(1.0) - discount_pct / F.lit(100.0))
    floor = cost * F.lit(COST_FLOOR_FACTOR)
    final = F.greatest(discounted, floor)
    return {
        "original_price": round_half_even(sell, 2),
        "clearance_price": round_half_even(final, 2),
        "cost_price": round_half_even(cost, 2),
        "actual_discount_pct": round_half_even((F.lit(1.0) - F.try_divide(final, sell)) * 100.0, 2),
        "margin_after_pct": round_half_even(F.try_divide(final - cost, final) * 100.0, 2),
        "floor_applied": final > discounted,
    }
