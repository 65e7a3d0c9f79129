"""Tier ladders: ordered (condition, label) rules as one CASE expression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(rules: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """First matching rule wins; a NULL condition does not match."""
    expr = None
    for condition, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def or_default(value: Column, default: object) -> Column:
    """``value``, or ``default`` where it is missing or zero."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


# --- fixed values: trend labels ---------------------------------------------
TREND_FLOORS = [(25, "SPIKE"), (10, "RISING"), (-10, "STABLE"), (-25, "FALLING")]
TREND_BELOW = "CRASH"
TREND_UP_ACTION = "Increase stock. Check for upcoming festivals."
TREND_DOWN_ACTION = "Review pricing. Check competitor activity."
TREND_FLAT_ACTION = "No immediate action needed."
SPIKE_ACTION = "Check festival calendar. Consider emergency restock."
DROP_ACTION = "Investigate cause. Check stockouts or competitor pricing."
# ----------------------------------------------------------------------------


def trend_label(change_pct: Column) -> Column:
    return ladder([(change_pct >= floor, label) for floor, label in TREND_FLOORS], TREND_BELOW)


def trend_action(label: Column) -> Column:
    return ladder(
        [
            (label.isin("SPIKE", "RISING"), TREND_UP_ACTION),
            (label.isin("FALLING", "CRASH"), TREND_DOWN_ACTION),
        ],
        TREND_FLAT_ACTION,
    )


def spike_status(z_score: Column, threshold: float) -> Column:
    return ladder([(z_score > threshold, "SPIKE"), (z_score < -threshold, "DROP")], "NORMAL")
