"""Alerts built from orders and expiring stock, and the channels they go to."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.functions.calendar import as_date
from aisleworks.functions.ladders import ladder
from aisleworks.functions.rounding import MONEY, grouped_integer, quantity_text
from aisleworks.operators.orders import ORDER_COLUMNS

# --- fixed values -----------------------------------------------------------
CHANNELS = {
    "CRITICAL": ["whatsapp", "telegram"],
    "HIGH": ["telegram", "email"],
    "MEDIUM": ["email"],
    "LOW": ["dashboard"],
}
DEFAULT_CHANNELS = ["dashboard"]
CRITICAL_ITEMS_SHOWN = 5
HIGH_ITEMS_SHOWN = 10
EXPIRY_ITEMS_SHOWN = 5
#: Texts of alerts; words in braces are filled in.
CRITICAL_TITLE = "🔴 CRITICAL: {n} products stockout risk at {store}"
CRITICAL_MESSAGE = (
    "Store {store} has {n} products that will stock out before supplier delivery. Top item: {product} (stock: {stock}, "
    "order {quantity} units from {supplier} by {deadline})."
)
HIGH_TITLE = "🟠 HIGH: {n} restock orders needed today"
HIGH_MESSAGE = "{n} products across stores need restock orders today. Estimated total order value: ₹{total}."
WEEK_TITLE, WEEK_MESSAGE = (
    "🔴 EXPIRY: {n} products expire within 7 days!",
    "₹{total} at risk. Apply 40–50% discount IMMEDIATELY. Top item: {product} at {store}.",
)
FORTNIGHT_TITLE, FORTNIGHT_MESSAGE = "🟠 EXPIRY: {n} products expire in 8–15 days", "₹{total} at risk. Apply 25–35% discount this week."
# ----------------------------------------------------------------------------


def _ordered_items(place: str, columns: list[str]) -> Column:
    """Collected rows in the order of ``place``, which is not kept; callers bound the group first."""
    item = F.struct(F.col(place).alias("_place"), F.struct(*columns).alias("_item"))
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_item"])


def _text(wording: str, **values: Column) -> Column:
    """The wording with its words in braces filled in; a missing value reads ``None`` instead of erasing the text."""
    pieces = re.split(r"\{(\w+)\}", wording)
    return F.concat(*[F.coalesce(values[p], F.lit("None")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def _alert(alert_type: str, priority: str | Column, title: Column, message: Column, store: Column, today: Column):
    return [
        F.lit(alert_type).alias("alert_type"),
        (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority"),
        title.alias("title"),
        message.alias("message"),
        store.alias("store_id"),
        F.lit(None).cast("string").alias("product_id"),
        today.alias("created_at"),
        F.col("data"),
    ]


def critical_restock_alerts(orders: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """One alert per store with critical orders; the count covers all, the list shows the first."""
    critical = orders.where(F.col("urgency").contains("CRITICAL"))
    counts = critical.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("store_id").orderBy("order_seq")
    shown = (
        critical.withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= CRITICAL_ITEMS_SHOWN)
        .groupBy("store_id")
        .agg(_ordered_items("_place", ORDER_COLUMNS).alias("data"))
    )
    n, store, top = F.col("n").cast("string"), F.col("store_id").cast("string"), F.col("data")[0]
    title = _text(CRITICAL_TITLE, n=n, store=store)
    message = _text(
        CRITICAL_MESSAGE,
        n=n,
        store=store,
        product=top["product_name"],
        stock=top["current_stock"].cast("string"),
        quantity=quantity_text(top["restock_qty"]),
        supplier=top["supplier_name"],
        deadline=top["order_deadline"].cast("string"),
    )
    return counts.join(shown, "store_id").select(
        *_alert("RESTOCK", "CRITICAL", title, message, store, as_date(as_of))
    )


def high_restock_alert(orders: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """One alert for all high-urgency orders, or none."""
    high = orders.where(F.col("urgency").contains("HIGH"))
    totals = high.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("estimated_order_value").cast(MONEY)).alias("total")
    ).where(F.col("n") > 0)
    first = high.orderBy("store_id", "order_seq").limit(HIGH_ITEMS_SHOWN)
    data = first.withColumn("_place", F.struct("store_id", "order_seq")).agg(
        _ordered_items("_place", ORDER_COLUMNS)
    )
    n = F.col("n").cast("string")
    title = _text(HIGH_TITLE, n=n)
    message = _text(HIGH_MESSAGE, n=n, total=grouped_integer(F.col("total")))
    return totals.withColumn("data", data.scalar()).select(
        *_alert("RESTOCK", "HIGH", title, message, F.lit(None).cast("string"), as_date(as_of))
    )


def restock_alerts(orders: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    return critical_restock_alerts(orders, as_of).unionByName(high_restock_alert(orders, as_of))


EXPIRY_ITEM_COLUMNS = [
    "product_id", "product_name", "category_name", "store_id", "store_name", "closing_stock", "unit_cost",
    "selling_price", "cost_price", "mrp", "expiry_date", "days_to_expiry", "value_at_risk", "discount_pct",
    "discount_range", "label", "action", "urgency", "original_price", "clearance_price",
    "actual_discount_pct", "margin_after_pct", "floor_applied",
]


def expiry_alert_rollup(items: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """At most two alerts: expiring within a week, and within the week after."""
    days = F.col("days_to_expiry")
    priority = ladder(
        [
            ((F.col("urgency") == "IMMEDIATE") & (days <= 7), "CRITICAL"),
            ((days > 7) & (days <= 15), "HIGH"),
        ],
        F.lit(None).cast("string"),
    )
    due = items.withColumn("priority", priority).where(F.col("priority").isNotNull())
    totals = due.groupBy("priority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_at_risk").alias("total")
    )
    soonest = Window.partitionBy("priority").orderBy("days_to_expiry", "inventory_id")
    shown = (
        due.withColumn("_place", F.row_number().over(soonest))
        .where(F.col("_place") <= EXPIRY_ITEMS_SHOWN)
        .groupBy("priority")
        .agg(_ordered_items("_place", EXPIRY_ITEM_COLUMNS).alias("data"))
    )
    critical = F.col("priority") == "CRITICAL"
    n, total, top = F.col("n").cast("string"), grouped_integer(F.col("total")), F.col("data")[0]
    filled = {"n": n, "total": total, "product": top["product_name"], "store": top["store_name"]}
    title = F.when(critical, _text(WEEK_TITLE, **filled)).otherwise(_text(FORTNIGHT_TITLE, **filled))
    message = F.when(critical, _text(WEEK_MESSAGE, **filled)).otherwise(_text(FORTNIGHT_MESSAGE, **filled))
    return totals.join(shown, "priority").select(
        *_alert("EXPIRY", F.col("priority"), title, message, F.lit(None).cast("string"), as_date(as_of))
    )


def route_alerts(alerts: DataFrame, dry_run: bool = True) -> DataFrame:
    """Adds the channels of each alert's priority and the dispatch flags."""
    channels = ladder(
        [
            (F.col("priority") == priority, F.array(*[F.lit(c) for c in names]))
            for priority, names in CHANNELS.items()
        ],
        F.array(*[F.lit(c) for c in DEFAULT_CHANNELS]),
    )
    return alerts.withColumns(
        {"channels": channels, "dispatched": F.lit(not dry_run), "dry_run": F.lit(dry_run)}
    )


def alert_outbox(routed: DataFrame) -> DataFrame:
    """One row per alert and channel, ready for whatever sends them."""
    return routed.withColumn("channel", F.explode("channels")).drop("channels", "data")
