"""What stores, seasons and customer types buy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.functions.rounding import average, round_half_up
from aisleworks.operators import sales

# --- fixed values -----------------------------------------------------------
CUSTOMER_TYPES = ["NEW", "REPEAT", "INACTIVE"]
TOP_CATEGORIES = 5
# ----------------------------------------------------------------------------


def store_category_preferences(
    tx: DataFrame, store: DataFrame, product: DataFrame, category: DataFrame, stores: list | None = None
) -> DataFrame:
    """Each store's leading categories with their share of the store's whole revenue.

    The share's denominator includes sales of products without a product or
    category row, so those stay in a marked group until the totals are taken:
    one pass over the fact instead of two.
    """
    by_product = (
        sales.in_stores(sales.completed_sales(tx), stores).groupBy("store_id", "product_id").agg(sales.revenue())
    )
    known = sales.product_category(product, category).withColumn("known", F.lit(True))
    by_category = (
        by_product.join(known, "product_id", "left")
        .groupBy("store_id", "known", "category_name")
        .agg(F.sum("revenue").alias("category_revenue"))
    )
    whole_store = Window.partitionBy("store_id")
    shares = (
        by_category.withColumn("store_total", F.sum("category_revenue").over(whole_store))
        .where("known")
        .join(store.select("store_id", "store_name", "city"), "store_id")
    )
    ranked = shares.withColumn(
        "rank", F.rank().over(Window.partitionBy("store_name").orderBy(F.desc_nulls_first("category_revenue")))
    )
    share = F.try_divide(F.col("category_revenue").cast("double"), F.col("store_total").cast("double"))
    return ranked.where(F.col("rank") <= TOP_CATEGORIES).select(
        "store_name",
        "city",
        "store_id",
        "category_name",
        "category_revenue",
        round_half_up(share * 100.0, 2).alias("revenue_share_pct"),
        "rank",
    )


def seasonal_category_mix(
    tx: DataFrame, date: DataFrame, product: DataFrame, category: DataFrame
) -> DataFrame:
    by_product = (
        sales.completed_sales(tx)
        .groupBy("date_id", "product_id")
        .agg(sales.revenue(), sales.units())
        .join(date.select("date_id", "season"), "date_id")
        .groupBy("season", "product_id")
        .agg(F.sum("revenue").alias("revenue"), F.sum("units").alias("units"))
    )
    mix = (
        by_product.join(sales.product_category(product, category), "product_id")
        .groupBy("season", "category_name")
        .agg(F.sum("units").alias("total_units"), F.sum("revenue").alias("total_revenue"))
    )
    by_revenue = Window.partitionBy("season").orderBy(F.desc_nulls_first("total_revenue"))
    return mix.withColumn("rank_in_season", F.rank().over(by_revenue))


def payment_preference(tx: DataFrame, store: DataFrame, stores: list | None = None) -> DataFrame:
    counted = (
        sales.in_stores(sales.completed_sales(tx), stores)
        .where(F.col("payment_mode").isNotNull())
        .groupBy("store_id", "payment_mode")
        .agg(F.count(F.lit(1)).alias("txn_count"))
        .join(store.select("store_id", "store_name"), "store_id")
    )
    store_total = F.sum("txn_count").over(Window.partitionBy("store_name"))
    return counted.select(
        "store_name",
        "store_id",
        "payment_mode",
        "txn_count",
        round_half_up(F.col("txn_count") * 100.0 / store_total, 2).alias("pct"),
    )


def customer_type_breakdown(
    tx: DataFrame,
    store: DataFrame,
    customer: DataFrame,
    stores: list | None = None,
    types: list[str] | None = None,
) -> DataFrame:
    """Customers, visits and spend per store and customer type."""
    # One row per store and customer, so distinct customers are a plain count afterwards.
    by_customer = (
        sales.in_stores(sales.completed_sales(tx), stores)
        .where(F.col("customer_id").isNotNull())
        .groupBy("store_id", "customer_id")
        .agg(sales.revenue(), F.count("final_sale_value").alias("priced"), F.count("transaction_id").alias("txns"))
    )
    typed = customer.where(F.col("customer_type").isin(types or CUSTOMER_TYPES)).select(
        "customer_id", "customer_type"
    )
    grouped = (
        by_customer.join(typed, "customer_id")
        .groupBy("store_id", "customer_type")
        .agg(
            F.count("customer_id").alias("unique_customers"),
            F.sum("txns").alias("total_transactions"),
            F.sum("revenue").alias("total_spend"),
            average(F.sum("revenue"), F.sum("priced")).alias("basket"),
        )
    )
    return grouped.join(store.select("store_id", "store_name"), "store_id").select(
        "store_name",
        "store_id",
        "customer_type",
        "unique_customers",
        "total_transactions",
        "total_spend",
        round_half_up(F.col("basket"), 2).alias("avg_basket"),
    )
