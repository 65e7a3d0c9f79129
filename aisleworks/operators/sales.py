"""The completed-sale relation and the grains every report starts from.

Facts are aggregated to the grain of their foreign keys *before* they meet a
dimension. A product or store that holds a third of all sales then collapses
inside the map tasks, and the joins only ever see one row per key combination,
whichever join strategy the dimension's size leads to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks import schemas
from aisleworks.functions.rounding import MONEY

#: Folder column of facts that lie in a folder a month.
MONTH = schemas.PARTITIONED["transaction"][0]


def completed_sales(tx: DataFrame) -> DataFrame:
    """Sales that were completed and not returned; rows with an unknown flag or status are out."""
    return tx.where(~F.col("is_return") & (F.col("transaction_status") == "Completed"))


def in_stores(tx: DataFrame, stores: list | None) -> DataFrame:
    return tx if stores is None else tx.where(F.col("store_id").isin(list(stores)))


def revenue() -> Column:
    return F.sum(F.col("final_sale_value").cast(MONEY)).alias("revenue")


def units() -> Column:
    return F.sum(F.col("quantity_sold").cast("bigint")).alias("units")


def latest_sale_date(tx: DataFrame, date: DataFrame) -> DataFrame:
    """One row: the last calendar day that has a completed sale."""
    sold_on = completed_sales(tx).select("date_id").distinct()
    return sold_on.join(date.select("date_id", "full_date"), "date_id").agg(
        F.max("full_date").alias("latest_date")
    )


def sales_since(tx: DataFrame, date: DataFrame, cutoff: Column) -> DataFrame:
    """Completed sales on or after ``cutoff``, with ``full_date``.

    The lowest date id of the window is implied by the join; stated as a filter it
    reaches the fact scan, where it prunes files and row groups. Facts dealt to folders
    by month are also pruned by folder, once the subquery has run and before any file is opened.
    """
    window = date.where(F.col("full_date") >= cutoff).select("date_id", "full_date")
    first_id = window.agg(F.min("date_id")).scalar()
    sold = completed_sales(tx).where(F.col("date_id") >= first_id)
    if MONTH in tx.columns:
        sold = sold.where(F.col(MONTH) >= window.agg(F.floor(F.min("date_id") / 100).cast("int")).scalar())
    return sold.join(window, "date_id")


def recent_sales(tx: DataFrame, date: DataFrame, days: int) -> DataFrame:
    """Completed sales of the last ``days`` days before, and on, the latest sale date."""
    return sales_since(tx, date, F.date_sub(latest_sale_date(tx, date).scalar(), days))


def product_category(product: DataFrame, category: DataFrame) -> DataFrame:
    """product_id -> category_name; products without a category row are out."""
    return product.select("product_id", "category_id").join(
        category.select("category_id", "category_name"), "category_id"
    ).select("product_id", "category_name")


def daily_by_category(
    tx: DataFrame, date: DataFrame, product: DataFrame, category: DataFrame, days: int
) -> DataFrame:
    """(category_name, full_date) totals of the recent window."""
    by_product = recent_sales(tx, date, days).groupBy("product_id", "full_date").agg(revenue(), units())
    return (
        by_product.join(product_category(product, category), "product_id")
        .groupBy("category_name", "full_date")
        .agg(F.sum("revenue").alias("daily_revenue"), F.sum("units").alias("daily_units"))
    )


def daily_by_store(tx: DataFrame, date: DataFrame, store: DataFrame, days: int) -> DataFrame:
    """(store_name, full_date) totals of the recent window."""
    by_store = recent_sales(tx, date, days).groupBy("store_id", "full_date").agg(revenue())
    return (
        by_store.join(store.select("store_id", "store_name"), "store_id")
        .groupBy("store_name", "full_date")
        .agg(F.sum("revenue").alias("daily_revenue"))
    )


def last_day(daily: DataFrame) -> Column:
    """Latest date of a daily relation, as a scalar subquery.

    The maximum is taken over whole rows, led by the date: a subquery that needs
    every column has the same exchanges as the query around it, so Spark runs
    them once for both instead of scanning the sales again for the date alone.
    """
    measures = [c for c in daily.columns if c.startswith("daily_")]
    latest_row = F.max(F.struct("full_date", *measures))
    return daily.agg(latest_row["full_date"]).scalar()


def orphan_sales(tx: DataFrame, date: DataFrame, product: DataFrame, store: DataFrame) -> DataFrame:
    """Completed sales the inner joins would lose, per missing dimension, in one pass over the facts."""
    dimensions = {"date_id": date, "product_id": product, "store_id": store}
    marked = completed_sales(tx).groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    for key, dimension in dimensions.items():
        known = dimension.select(F.col(key).alias(f"_{key}")).distinct()
        marked = marked.join(known, F.col(key) == F.col(f"_{key}"), "left")
    lost = [F.coalesce(F.sum(F.when(F.col(f"_{key}").isNull(), F.col("n"))), F.lit(0)).alias(key) for key in dimensions]
    return marked.agg(*lost).unpivot([], list(dimensions), "missing_key", "orphan_sales")
