"""Feature table of the demand forecast and its projection into the future."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.functions.calendar import (
    DAY_CODES,
    SEASON_CODES,
    as_date,
    coded,
    iso_weekday,
    season_code_of_month,
)
from aisleworks.operators import sales

KEY = ["product_id", "store_id"]
TARGET = "quantity_sold"

# --- fixed values: model inputs in their order ------------------------------
FEATURES = [
    "day_of_week", "is_weekend", "season_code", "month_number",
    "is_festival", "is_public_holiday", "is_marriage_season",
    "temperature_c", "rainfall_mm",
    "lag_7d_qty", "lag_14d_qty", "lag_30d_qty",
    "rolling_7d_avg", "rolling_30d_avg",
]
DEFAULT_WEATHER = "Unknown"
DEFAULT_TEMPERATURE = 20.0
DEFAULT_RAINFALL = 0.0
# ----------------------------------------------------------------------------

_LAGS = {"lag_7d_qty": 7, "lag_14d_qty": 14, "lag_30d_qty": 30}
_ROLLING = {"rolling_7d_avg": 7, "rolling_30d_avg": 30}
_FACTORS = [
    "is_festival", "is_public_holiday", "weather_type",
    "temperature_c", "rainfall_mm", "is_marriage_season",
]


def feature_columns() -> list[str]:
    return list(FEATURES)


def _history(order: list) -> Window:
    return Window.partitionBy(*KEY).orderBy(*order)


def selling_days(
    tx: DataFrame,
    date: DataFrame,
    product: DataFrame,
    category: DataFrame,
    store: DataFrame,
    external: DataFrame,
) -> DataFrame:
    """One row per product, store and selling day, with that day's calendar and external factors."""
    grain = (
        sales.completed_sales(tx)
        .groupBy(*KEY, "date_id")
        .agg(sales.units().alias(TARGET), sales.revenue().alias("total_revenue"))
    )
    calendar = date.select("date_id", "full_date", "day_name", "is_weekend", "season", "month_number")
    goods = product.select("product_id", "product_name", "category_id").join(
        category.select("category_id", "category_name"), "category_id"
    ).drop("category_id")
    regions = store.select("store_id", "region")
    # Equal factor rows of one day and region repeat the day's sales in a single group.
    factors = (
        external.where(F.col("region").isNotNull())
        .groupBy(F.col("record_date").alias("full_date"), "region", *_FACTORS)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    copies = F.coalesce("copies", F.lit(1))
    return (
        grain.join(calendar, "date_id")
        .join(goods, "product_id")
        .join(regions, "store_id")
        .join(factors, ["full_date", "region"], "left")
        .select(
            "full_date",
            "product_id",
            "product_name",
            "category_name",
            "store_id",
            (F.col(TARGET) * copies).alias(TARGET),
            (F.col("total_revenue") * copies).cast("decimal(28,2)").alias("total_revenue"),
            "day_name",
            F.col("is_weekend").cast("int").alias("is_weekend"),
            "season",
            "month_number",
            F.coalesce("is_festival", F.lit(False)).cast("int").alias("is_festival"),
            F.coalesce("is_public_holiday", F.lit(False)).cast("int").alias("is_public_holiday"),
            F.coalesce("weather_type", F.lit(DEFAULT_WEATHER)).alias("weather_type"),
            F.coalesce("temperature_c", F.lit(DEFAULT_TEMPERATURE)).alias("temperature_c"),
            F.coalesce("rainfall_mm", F.lit(DEFAULT_RAINFALL)).alias("rainfall_mm"),
            F.coalesce("is_marriage_season", F.lit(False)).cast("int").alias("is_marriage_season"),
        )
    )


#: What lags and rolling means look back over: a key's earlier rows, or calendar days, on which nothing may have been sold.
ROWS, DAYS = "rows", "days"


def with_history(rows: DataFrame, by: str = ROWS) -> DataFrame:
    """Selling days with their lags and rolling means.

    By rows, lag 7 is the seventh selling day back. By days, it is what was sold seven days earlier, none if nothing was, and
    a mean is of the days in the range on which something was sold.
    """
    # The factor columns only settle the order of rows that share a day, so reruns agree.
    past = _history(["full_date", *_FACTORS])
    quantity = F.col(TARGET).cast("double")
    zero = F.lit(0.0)
    if by == ROWS:
        lags = {name: F.lag(quantity, n).over(past) for name, n in _LAGS.items()}
        means = {name: F.avg(quantity).over(past.rowsBetween(-n, -1)) for name, n in _ROLLING.items()}
    elif by == DAYS:
        near = _history([F.unix_date("full_date")])
        lags = {name: F.sum(quantity).over(near.rangeBetween(-n, -n)) for name, n in _LAGS.items()}
        means = {name: F.avg(quantity).over(near.rangeBetween(-n, -1)) for name, n in _ROLLING.items()}
    else:
        raise ValueError(f"by must be {ROWS} or {DAYS}")
    return rows.withColumns({name: F.coalesce(value, zero) for name, value in {**lags, **means}.items()}).withColumns(
        {
            "day_of_week": coded(F.col("day_name"), DAY_CODES),
            "season_code": coded(F.col("season"), SEASON_CODES),
        }
    )


def feature_table(
    tx: DataFrame,
    date: DataFrame,
    product: DataFrame,
    category: DataFrame,
    store: DataFrame,
    external: DataFrame,
    by: str = ROWS,
) -> DataFrame:
    """One row per product, store and selling day, with lags and rolling means over rows or calendar days."""
    return with_history(selling_days(tx, date, product, category, store, external), by)


def features_after(features: DataFrame, days: DataFrame, changed: DataFrame) -> DataFrame:
    """A row-based feature table brought up to date with changed days, instead of built anew.

    ``days`` holds the changed days' ids in ``full_date``, all of them; ``changed`` the selling days that those dates now
    have, late sales and returns included. Of a key, rows from its first changed day on are computed again, with the 30 rows
    before that day as their past; keys without a change, and rows before it, are taken as they are.
    """
    day_of = days.select("full_date").distinct()
    plain = [c for c in changed.columns if c in features.columns]
    # a key is concerned by what it sells on those days now and by what it sold on them before
    sold = changed.select(*KEY, "full_date").unionByName(features.join(day_of, "full_date", "left_semi").select(*KEY, "full_date"))
    first = sold.groupBy(*KEY).agg(F.min("full_date").alias("_first"))
    known = features.join(first, KEY, "left")
    before = F.col("_first").isNull() | (F.col("full_date") < F.col("_first"))
    recent = _history([F.desc(c) for c in ["full_date", *_FACTORS]])
    context = known.where(F.col("_first").isNotNull() & before).withColumn("_age", F.row_number().over(recent))
    context = context.where(F.col("_age") <= max(*_LAGS.values(), *_ROLLING.values())).select(*plain)
    later = known.where(F.col("_first").isNotNull() & ~before).join(day_of, "full_date", "left_anti").select(*plain)
    again = with_history(context.unionByName(later).unionByName(changed.select(*plain))).join(first, KEY)
    again = again.where(F.col("full_date") >= F.col("_first")).select(features.columns)
    return known.where(before).select(features.columns).unionByName(again)


def feature_vector(features: DataFrame, output: str = "features") -> DataFrame:
    """The model inputs assembled in their fixed order; rows with a missing input are skipped."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol=output, handleInvalid="skip")
    return assembler.transform(features)


def future_features(
    features: DataFrame, as_of: dt.date | str | None = None, days_ahead: int = 7
) -> DataFrame:
    """Inputs for the next days of every product and store, in one job.

    Calendar inputs follow the future date, festival flags and rain are off, and
    temperature, lags and rolling means stay at the key's last selling day.
    """
    newest_first = _history([F.desc(c) for c in ["full_date", *_FACTORS]])
    last = (
        features.withColumn("_age", F.row_number().over(newest_first))
        .where(F.col("_age") == 1)
        .select(*KEY, "product_name", "category_name", "temperature_c", *_LAGS, *_ROLLING)
    )
    ahead = last.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(days_ahead)))).withColumn(
        "forecast_date", F.date_add(as_date(as_of), F.col("_step"))
    )
    day, month = F.col("forecast_date"), F.month("forecast_date")
    future = ahead.withColumns(
        {
            "day_of_week": iso_weekday(day),
            "is_weekend": (iso_weekday(day) >= 6).cast("int"),
            "season_code": season_code_of_month(month),
            "month_number": month,
            "is_festival": F.lit(0),
            "is_public_holiday": F.lit(0),
            "is_marriage_season": F.lit(0),
            "rainfall_mm": F.lit(0.0),
        }
    )
    return future.select(*KEY, "product_name", "category_name", "forecast_date", *FEATURES)
