"""Restock orders and what goes to the suppliers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.functions.calendar import as_date
from aisleworks.functions.replenishment import urgency_rank
from aisleworks.functions.rounding import MONEY, grouped_integer, round_half_even
from aisleworks.operators.decisions import with_restock_quantity

TOP_N = 50
MESSAGE_LINES = 10

# --- fixed values: the wording of a purchase-order message --------------------
ORDER_TITLE = "🏪 {sender} — Purchase Order Request"
ORDER_DATE, ORDER_DATE_FORMAT = "📅 Date: ", "dd MMM yyyy"
ORDER_SUPPLIER, NO_SUPPLIER = "📦 Supplier: ", "None"
ORDER_CONFIRM = "⏰ Please confirm by: "
ORDER_DETAILS = "ORDER DETAILS:"
LINE_NUMBER, LINE_STORE, LINE_QUANTITY, LINE_UNITS, LINE_URGENCY = ". ", " | Store: ", " | Qty: ", " units", " | Urgency: "
ORDER_MORE = "... and %d more items."
ORDER_VALUE = "💰 Estimated Order Value: ₹"
ORDER_CLOSING = "Please reply to confirm or call us."
# ----------------------------------------------------------------------------

ORDER_COLUMNS = [
    "product_id", "product_name", "category", "store_id", "store_name", "supplier_id", "supplier_name",
    "supplier_phone", "current_stock", "reorder_level", "restock_qty", "order_deadline", "lead_time_days",
    "forecast_7d_qty", "estimated_order_value", "urgency", "calculation_method",
]


def restock_orders(
    candidates: DataFrame,
    forecast: DataFrame | Callable[[DataFrame], DataFrame],
    top_n: int = TOP_N,
    stores: list | None = None,
    as_of: dt.date | str | None = None,
) -> DataFrame:
    """Each store's most pressing candidates as order lines.

    ``forecast`` holds (product_id, store_id, forecast_7d_qty), one row per key, or is a function that gives
    those rows for the (product_id, store_id) keys of the chosen lines, so that no other key is scored.
    ``order_seq`` numbers a store's lines from the most pressing one.
    """
    if stores is not None:
        candidates = candidates.where(F.col("store_id").isin(list(stores)))
    pressing = Window.partitionBy("store_id").orderBy(
        F.desc_nulls_first("restock_gap"), "raw_days_until_stockout", "inventory_id"
    )
    chosen = candidates.withColumn("order_seq", F.row_number().over(pressing)).where(
        F.col("order_seq") <= top_n
    )
    if not isinstance(forecast, DataFrame):
        forecast = forecast(chosen.select("product_id", "store_id").distinct())
    demand = forecast.select("product_id", "store_id", F.col("forecast_7d_qty").cast("double"))
    lines = chosen.join(demand, ["product_id", "store_id"], "left").withColumn(
        "forecast_7d_qty", F.coalesce("forecast_7d_qty", F.lit(0.0))
    )
    unit_cost = F.coalesce(F.col("unit_cost").cast("double"), F.lit(0.0))
    return (
        with_restock_quantity(lines, as_of=as_of)
        .withColumn("estimated_order_value", round_half_even(F.col("restock_qty") * unit_cost, 2))
        .withColumnsRenamed(
            {
                "category_name": "category",
                "contact_phone": "supplier_phone",
                "closing_stock": "current_stock",
                "method": "calculation_method",
            }
        )
        .select(*ORDER_COLUMNS, "order_seq")
    )


def order_position() -> list[Column]:
    """Urgency first, then store and the store's own sequence: a total order."""
    return [urgency_rank(F.col("urgency")).alias("urgency_rank"), F.col("store_id"), F.col("order_seq")]


def _value() -> Column:
    return F.sum(F.col("estimated_order_value").cast(MONEY)).cast("double")


def _critical() -> Column:
    return F.count_if(F.col("urgency").contains("CRITICAL"))


def restock_run_summary(orders: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Per store: orders, critical ones and value; scanned stores without an order show zeros."""
    summary = orders.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("orders_created"),
        _critical().alias("critical_count"),
        _value().alias("total_order_value"),
    )
    if scanned is None:
        return summary
    filled = scanned.select("store_id").join(summary, "store_id", "left")
    return filled.fillna({"orders_created": 0, "critical_count": 0, "total_order_value": 0.0})


def restock_run_totals(orders: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """One row for the whole run."""
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        _critical().alias("critical_orders"),
        F.count_if(F.col("urgency").contains("HIGH")).alias("high_orders"),
        F.coalesce(_value(), F.lit(0.0)).alias("total_order_value"),
    ).select(as_date(as_of).alias("run_date"), "*")


def supplier_orders(orders: DataFrame) -> DataFrame:
    """One row per supplier: totals over every line and the earliest deadline.

    The lines themselves stay relational in ``supplier_order_lines``, so a supplier with
    a third of all orders never becomes one giant row.
    """
    first = F.struct(*order_position())
    return orders.groupBy("supplier_id").agg(
        F.min_by("supplier_name", first).alias("supplier_name"),
        F.min_by("supplier_phone", first).alias("supplier_phone"),
        F.count(F.lit(1)).alias("total_items"),
        _value().alias("total_value"),
        F.min("order_deadline").alias("earliest_deadline"),
    )


def printed_lines(orders: DataFrame, shown: int = MESSAGE_LINES) -> DataFrame:
    """The first lines of each supplier's order, as a message prints them; the rest it only counts."""
    place = F.row_number().over(Window.partitionBy("supplier_id").orderBy(*order_position()))
    line = F.struct("line_no", "product_name", "store_id", "restock_qty", "urgency")
    return (
        orders.withColumn("line_no", place)
        .where(F.col("line_no") <= shown)
        .groupBy(F.col("supplier_id").alias("_supplier"))
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
    )


def supplier_order_lines(orders: DataFrame) -> DataFrame:
    """Every order line next to its supplier's totals."""
    heads = orders.groupBy(F.col("supplier_id").alias("_supplier")).agg(
        F.count(F.lit(1)).alias("supplier_items"),
        _value().alias("supplier_value"),
        F.min("order_deadline").alias("earliest_deadline"),
    )
    return orders.join(heads, F.col("supplier_id").eqNullSafe(F.col("_supplier"))).drop("_supplier")


def supplier_messages(
    orders: DataFrame,
    as_of: dt.date | str | None = None,
    sender: str = "RETAIL",
    signature: str = "— Retail Purchasing",
    dry_run: bool = True,
) -> DataFrame:
    """Purchase-order text per supplier: head, the first lines, the rest as a count, the total."""
    def printed(line: Column) -> Column:
        return F.concat(
            line["line_no"].cast("string"), F.lit(LINE_NUMBER), line["product_name"],
            F.lit(LINE_STORE), line["store_id"].cast("string"),
            F.lit(LINE_QUANTITY), line["restock_qty"].cast("bigint").cast("string"), F.lit(LINE_UNITS),
            F.lit(LINE_URGENCY), F.coalesce(line["urgency"], F.lit("")),
        )

    hidden = F.col("total_items") - MESSAGE_LINES
    text = F.concat_ws(
        "\n",
        F.lit(ORDER_TITLE.format(sender=sender)),
        F.concat(F.lit(ORDER_DATE), F.date_format(as_date(as_of), ORDER_DATE_FORMAT)),
        F.concat(F.lit(ORDER_SUPPLIER), F.coalesce("supplier_name", F.lit(NO_SUPPLIER))),
        F.concat(F.lit(ORDER_CONFIRM), F.col("earliest_deadline").cast("string")),
        F.lit(""),
        F.lit(ORDER_DETAILS),
        F.array_join(F.transform("lines", printed), "\n"),
        # concat_ws skips a NULL line.
        F.when(hidden > 0, F.format_string(ORDER_MORE, hidden)),
        F.lit(""),
        F.concat(F.lit(ORDER_VALUE), grouped_integer(F.col("total_value"))),
        F.lit(""),
        F.lit(ORDER_CLOSING),
        F.lit(signature),
    )
    heads = supplier_orders(orders)
    shown = printed_lines(orders)
    return heads.join(shown, F.col("supplier_id").eqNullSafe(F.col("_supplier"))).select(
        "supplier_id",
        "supplier_name",
        "supplier_phone",
        "total_items",
        "total_value",
        "earliest_deadline",
        text.alias("order_message"),
        F.lit(not dry_run).alias("sent"),
        F.lit(dry_run).alias("dry_run"),
    )
