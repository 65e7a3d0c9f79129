"""Every registered query: the operator over the driver tables, and its SQL where SQL can state it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aisleworks.functions.pricing import clearance_price, expiry_discount
from aisleworks.operators import (
    alerts,
    cleaning,
    decisions,
    features,
    festivals,
    forecast,
    orders,
    sales,
    spikes,
    taste,
    trends,
)
from aisleworks import schemas
from aisleworks.plans.presentation import presented
from aisleworks.session import materialize, release, shared_folder
from aisleworks.sources import outbox, rollup, snapshots
from aisleworks.sources.exports import MALFORMED, parse_lines
from aisleworks.sources.keyed_files import SLICE_ROWS, KeyedTable
from driverbind.exports import RAGGED_HEADER, export_frame, ragged_lines
from driverbind.roles import AS_OF, FESTIVAL_AS_OF, STOCK_AS_OF, Roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FEATURE_HISTORY = ["lag_7d_qty", "lag_14d_qty", "lag_30d_qty", "rolling_7d_avg", "rolling_30d_avg"]


def comparable(df: DataFrame) -> DataFrame:
    """Types that read the same from Spark and DuckDB: decimals as doubles, days and times as text."""
    shown = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind in ("date", "timestamp_ntz"):
            column = column.cast("string")
        shown.append(column.alias(name))
    return df.select(*shown)


def query(function: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(function(Roles(spark, folder)))

    QUERIES[function.__name__] = run
    return function


# --- analytics ------------------------------------------------------------


@query
def category_trends(r: Roles):
    return trends.category_trends(r.transaction(), r.date(), r.product(), r.category())


def _kept_facts(r: Roles) -> DataFrame:
    """The daily grain of a fact table that was merged into twice, in the shape of facts.

    A first load has every line as not returned and lacks some; a second batch brings those lines and the returns. Lines of
    one number are told apart by what else they hold, equal ones summed.
    """
    told = ["transaction_id", "date_id", "store_id", "product_id", "payment_mode", "transaction_status", "is_return"]
    units, value = F.sum("quantity_sold").cast("int"), F.sum("final_sale_value").cast("decimal(18,2)")

    def lines(part: Column):
        found = r.transaction().where(part).groupBy(*told).agg(units.alias("quantity_sold"), value.alias("final_sale_value"))
        return found.withColumn("transaction_id", F.concat_ws("-", *told))

    parts = max(1, -(-r.raw("lineitem").count() // SLICE_ROWS))
    tx = materialize([lines(F.pmod(F.hash("transaction_id"), F.lit(parts)) == part) for part in range(parts)], "lines")
    name, kind = schemas.PARTITIONED["transaction"]
    facts = KeyedTable(r.spark, _scratch(r, "facts"), tx.schema, ("transaction_id",), (name, kind))
    kept = rollup.rollup_table(r.spark, _scratch(r, "rollup"), tx)
    missing = F.col("payment_mode") == "1-URGENT"
    first = tx.where(~missing).withColumn("is_return", F.lit(False))
    second = tx.where(missing | F.col("is_return"))
    for batch in (first, second):
        days = materialize(rollup.changed_days(facts, batch), "changed-days")
        snapshots.overwrite_touched(facts, batch, F.col("final_sale_value"), snapshots.Rule())
        rollup.refresh(kept, r.spark.read.schema(tx.schema).parquet(facts.path), days)
        release(days)
    release(tx)
    facts.folder.delete("")  # the reports read the grain alone
    return rollup.as_facts(kept.read(kept.data_files()))


@query
def category_trends_kept(r: Roles):
    """The report from a daily grain that merges kept up to date; the facts are not read."""
    return trends.category_trends(_kept_facts(r), r.date(), r.product(), r.category())


@query
def store_trends_kept(r: Roles):
    return trends.store_trends(_kept_facts(r), r.date(), r.store())


@query
def store_trends(r: Roles):
    return trends.store_trends(r.transaction(), r.date(), r.store())


@query
def demand_spikes(r: Roles):
    return spikes.demand_spikes(r.transaction(), r.date(), r.product(), r.category(), z_threshold=1.0)


@query
def category_demand_status(r: Roles):
    return spikes.category_demand_status(r.transaction(), r.date(), r.product(), r.category())


@query
def weather_demand(r: Roles):
    return spikes.weather_demand(r.transaction(), r.date(), r.external())


@query
def upcoming_festivals(r: Roles):
    return festivals.upcoming_festivals(r.festival(), as_of=FESTIVAL_AS_OF, days_ahead=60)


@query
def festival_product_recs(r: Roles):
    return festivals.festival_product_recs(
        r.festival_products(), r.product(), r.category(), r.inventory(), r.transaction(), r.date(), as_of=AS_OF
    )


@query
def festival_day_revenue(r: Roles):
    return festivals.festival_day_revenue(r.transaction(), r.date(), r.external())


@query
def festival_uplift(r: Roles):
    return festivals.festival_uplift(r.transaction(), r.date(), r.external())


@query
def store_category_preferences(r: Roles):
    return taste.store_category_preferences(r.transaction(), r.store(), r.product(), r.category())


@query
def seasonal_category_mix(r: Roles):
    return taste.seasonal_category_mix(r.transaction(), r.date(), r.product(), r.category())


@query
def payment_preference(r: Roles):
    return taste.payment_preference(r.transaction(), r.store())


@query
def customer_type_breakdown(r: Roles):
    return taste.customer_type_breakdown(r.transaction(), r.store(), r.customer())


@query
def orphan_sales(r: Roles):
    """Against the calendar's working days, the parts that have stock, and the stores in use."""
    working_days = r.date().where(~F.col("is_weekend"))
    return sales.orphan_sales(r.transaction(), working_days, r.inventory(), r.store())


# --- forecasting ----------------------------------------------------------


@lru_cache(maxsize=8)
def _features(r: Roles) -> DataFrame:
    return features.feature_table(**r.forecast_tables())


@query
def feature_table(r: Roles):
    return _features(r)


@query
def feature_table_by_days(r: Roles):
    """Lags and means over calendar days in place of selling days."""
    found = features.feature_table(**r.forecast_tables(), by=features.DAYS)
    return found.select("product_id", "store_id", "full_date", *FEATURE_HISTORY)


@query
def feature_table_grown(r: Roles):
    """The row-based table built for early days, then brought up to date with later ones and with late sales of old days."""
    others = r.forecast_tables()
    tx, date = others.pop("tx"), others["date"]
    late = F.col("payment_mode") == "5-LOW"  # some sales of every day arrive last
    cut = date.agg(F.percentile_approx("date_id", 0.9)).scalar()
    early = F.col("date_id") <= cut
    grown = features.feature_table(tx.where(early & ~late), **others)
    for seen, days in ((tx.where(~late), ~early & ~late), (tx, late)):
        changed = tx.where(days).select("date_id").distinct().join(date.select("date_id", "full_date"), "date_id")
        on_days = features.selling_days(seen, **others).join(changed.select("full_date").distinct(), "full_date", "left_semi")
        grown = features.features_after(materialize(grown, "features"), changed, on_days)
    return grown


@query
def feature_vector(r: Roles):
    """The assembled vector, read back as its length and a position-weighted sum."""
    values = vector_to_array("features")
    weighted = F.aggregate(
        F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda total, x: total + x
    )
    return features.feature_vector(_features(r)).select(
        "product_id", "store_id", "full_date", F.size(values).alias("inputs"),
        F.round(weighted, 4).alias("weighted_sum"),
    )


@query
def forecast_metrics(r: Roles):
    """Errors of the rolling mean as a forecast of the held-out days."""
    _, held_out = forecast.split_by_date(_features(r))
    return forecast.forecast_metrics(held_out, predicted="rolling_7d_avg")


@query
def future_features(r: Roles):
    return features.future_features(_features(r), as_of=AS_OF)


def _stand_in_daily(r: Roles, of: DataFrame | None = None) -> DataFrame:
    """Forecast lines, of the keys asked for, from a formula SQL can repeat in place of a model."""
    table = _features(r) if of is None else _features(r).join(of, features.KEY, "left_semi")
    future = features.future_features(table, as_of=AS_OF)
    formula = F.col("rolling_7d_avg") * 1.05 + F.col("day_of_week") * 0.3 - 20.0
    return forecast.daily_forecast(future, formula)


@query
def daily_forecast(r: Roles):
    return _stand_in_daily(r)


@query
def forecast_totals(r: Roles):
    totals = forecast.forecast_totals(_stand_in_daily(r))
    return totals.withColumn(
        "daily_forecast",
        F.array_join(F.transform("daily_forecast", lambda d: d["predicted_qty"].cast("decimal(18,1)").cast("string")), "|"),
    )


@query
def top_demand(r: Roles):
    """Best sellers per store with the formula forecast."""
    best = forecast.leaders(_features(r), top_n=3)
    return forecast.top_demand_forecast(best, forecast.forecast_totals(_stand_in_daily(r, best)))


#: Trees and depth of the registered model queries; the defaults of ``train_forecast`` are the production values.
FOREST: dict[str, int] = {}


def _trained(r: Roles) -> forecast.Trained:
    return forecast.train_forecast(_features(r), **FOREST)


def _learned_from(r: Roles) -> tuple[DataFrame, forecast.Trained]:
    """The feature table, written for all that reads it, and what training on it gave."""
    table = materialize(_features(r), "features")
    return table, forecast.train_forecast(table, **FOREST)


@query
def train_forecast(r: Roles):
    """What training has seen, and facts that any trained model must meet."""
    m = F.col
    finite = ~F.isnan("mae") & ~F.isnan("rmse") & (F.greatest("mae", "rmse") < float("inf"))
    return _trained(r).metrics.select(
        "train_rows", "test_rows", "mean_actual_qty",
        (finite & (m("mae") >= 0) & (m("mape_pct") >= 0)).alias("errors_finite"),
        (m("mae") <= m("rmse")).alias("mae_within_rmse"),
    )


@query
def feature_importance(r: Roles):
    """Names of the inputs and facts about their weights."""
    weights = forecast.feature_importance(r.spark, _trained(r).model)
    whole = F.abs(F.sum("importance").over(Window.partitionBy()) - 1.0) <= 0.001
    return weights.select("feature", (F.col("importance") >= 0).alias("not_negative"), whole.alias("sums_to_one"))


@query
def predict_demand(r: Roles):
    """Forecast lines with facts about their quantities: a forest can't leave the range it was trained on."""
    table, trained = _learned_from(r)
    past, _ = forecast.split_by_date(table)
    daily = forecast.predict_demand(trained.model, features.future_features(table, as_of=AS_OF))
    largest = past.agg(F.max("quantity_sold")).scalar()
    within = (F.col("predicted_qty") >= 0) & (F.col("predicted_qty") <= largest)
    return daily.withColumn("within_range", within).drop("predicted_qty")


@query
def top_demand_forecast(r: Roles):
    """Each store's best sellers with their model forecast; only their days are scored."""
    table, trained = _learned_from(r)
    best = forecast.leaders(table, top_n=10)
    future = features.future_features(table.join(best, features.KEY, "left_semi"), as_of=AS_OF)
    daily = forecast.predict_demand(trained.model, future)
    totals = forecast.top_demand_forecast(best, forecast.forecast_totals(daily))
    days = daily.groupBy(*features.KEY).agg(F.sum(F.col("predicted_qty").cast("decimal(18,1)")).alias("days_qty"))
    same = F.abs(F.col("total_7d_forecast") - F.col("days_qty").cast("double")) < 0.05
    return totals.join(days, features.KEY).withColumn("total_of_days", same).drop("total_7d_forecast", "days_qty")


# --- decisions ------------------------------------------------------------


def _candidates(r: Roles) -> DataFrame:
    return decisions.restock_candidates(
        r.inventory(), r.product(), r.category(), r.store(), r.supplier(), as_of=STOCK_AS_OF
    )


@query
def restock_candidates(r: Roles):
    return _candidates(r)


@query
def restock_quantity(r: Roles):
    """Quantity decision for every inventory row with the stand-in forecast."""
    items = r.inventory().join(r.stand_in_forecast(), ["product_id", "store_id"], "left")
    return decisions.with_restock_quantity(items, as_of=STOCK_AS_OF).select(
        "inventory_id", "restock_qty", "order_deadline", "lead_time_days", "daily_demand_est", "method"
    )


@query
def stockout_alerts(r: Roles):
    return decisions.stockout_alerts(r.inventory(), r.product(), r.category(), r.store(), r.supplier())


@query
def expiry_discount_tiers(r: Roles):
    days = F.datediff("expiry_date", F.lit(STOCK_AS_OF).cast("date"))
    dated = r.inventory().where(F.col("expiry_date").isNotNull()).select(
        "inventory_id", days.alias("days_to_expiry")
    )
    return dated.withColumns(expiry_discount(F.col("days_to_expiry")))


@query
def clearance_prices(r: Roles):
    priced = r.product().select(
        "product_id", "selling_price", "cost_price", (F.col("product_id") % 11 * 5).cast("int").alias("discount_pct")
    )
    return priced.withColumns(
        clearance_price(F.col("selling_price"), F.col("cost_price"), F.col("discount_pct"))
    )


def _expiring(r: Roles) -> DataFrame:
    return decisions.expiry_alerts(r.inventory(), r.product(), r.category(), r.store(), as_of=STOCK_AS_OF)


@query
def expiry_alerts(r: Roles):
    return _expiring(r)


@query
def expiry_alerts_in_order(r: Roles):
    """The report with its row positions."""
    return presented("expiry_alerts", _expiring(r))


@query
def category_trends_in_order(r: Roles):
    return presented("category_trends", trends.category_trends(r.transaction(), r.date(), r.product(), r.category()))


@query
def low_margin_products(r: Roles):
    return decisions.low_margin_products(r.product(), r.category(), r.supplier())


# --- orders and alerts ----------------------------------------------------


def _orders(r: Roles) -> DataFrame:
    return orders.restock_orders(_candidates(r), r.stand_in_forecast(), top_n=50, as_of=STOCK_AS_OF)


@query
def restock_orders(r: Roles):
    return _orders(r)


@query
def restock_run_summary(r: Roles):
    return orders.restock_run_summary(_orders(r), r.store())


@query
def restock_run_totals(r: Roles):
    return orders.restock_run_totals(_orders(r), as_of=STOCK_AS_OF)


def _listing(name: str, item: str) -> Column:
    return F.array_join(F.transform(name, lambda x: x[item].cast("string")), "|")


@query
def restock_alerts(r: Roles):
    built = alerts.restock_alerts(_orders(r), as_of=STOCK_AS_OF)
    return built.withColumn("data", _listing("data", "product_id"))


@query
def expiry_alert_rollup(r: Roles):
    built = alerts.expiry_alert_rollup(_expiring(r), as_of=STOCK_AS_OF)
    return built.withColumn("data", _listing("data", "product_id"))


@query
def route_alerts(r: Roles):
    built = alerts.route_alerts(alerts.restock_alerts(_orders(r), as_of=STOCK_AS_OF))
    return built.withColumn("channels", F.array_join("channels", ",")).drop("data")


@query
def alert_outbox(r: Roles):
    return alerts.alert_outbox(alerts.route_alerts(alerts.expiry_alert_rollup(_expiring(r), as_of=STOCK_AS_OF)))


@query
def posted_alerts(r: Roles):
    """The outbox after two runs of a day, of which the second adds nothing, and the delivery of what went by telegram."""
    path = _scratch(r, "outbox")
    routed = alerts.route_alerts(alerts.expiry_alert_rollup(_expiring(r), as_of=STOCK_AS_OF), dry_run=False)
    for _ in range(2):
        outbox.post(routed, path)
    at = F.lit("2026-01-01 08:00:00").cast("timestamp_ntz").alias("attempted_at")
    tried = outbox.due(r.spark, path).where("channel IN ('telegram', 'whatsapp')")
    tried = materialize(tried.select("alert_key", (F.col("channel") == "telegram").alias("delivered"), at), "outcomes")
    for _ in range(2):  # an outcome reported again is not another attempt
        outbox.record_deliveries(tried, path)
    release(tried)
    return outbox.read_outbox(r.spark, path)


@query
def supplier_orders(r: Roles):
    return orders.supplier_orders(_orders(r))


@query
def supplier_order_lines(r: Roles):
    return orders.supplier_order_lines(_orders(r))


@query
def supplier_messages(r: Roles):
    return orders.supplier_messages(_orders(r), as_of=STOCK_AS_OF)


# --- ingestion ------------------------------------------------------------


def _cleaning(table: str) -> None:
    def run(r: Roles):
        return cleaning.JOBS[table](export_frame(r.spark, r.folder, table)).valid

    run.__name__ = f"clean_{table}"
    query(run)


for _table in cleaning.JOBS:
    _cleaning(_table)


@query
def category_with_parents(r: Roles):
    return cleaning.with_parent_categories(cleaning.clean_category(export_frame(r.spark, r.folder, "category")).valid)


@query
def festival_products(r: Roles):
    return cleaning.festival_products(export_frame(r.spark, r.folder, "festival"))


@query
def rejected_rows(r: Roles):
    """How many export rows each job leaves out, by reason."""
    counted = None
    for table, job in cleaning.JOBS.items():
        rejects = job(export_frame(r.spark, r.folder, table)).rejects
        part = rejects.groupBy(F.lit(table).alias("table_name"), cleaning.REASON).agg(F.count(F.lit(1)).alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    return counted


@query
def ragged_rows(r: Roles):
    """Brand lines of which some have too many fields or too few: typed ones, and rejects with their line."""
    cleaned = cleaning.clean_brand(parse_lines(ragged_lines(r.spark, r.folder), RAGGED_HEADER))
    nothing = F.lit(None).cast("string")
    typed = cleaned.valid.select(F.col("brand_id").cast("string"), "brand_name", nothing.alias(cleaning.REASON), nothing.alias("line"))
    return typed.unionByName(cleaned.rejects.select("brand_id", "brand_name", cleaning.REASON, F.col(MALFORMED).alias("line")))


def _scratch(r: Roles, label: str) -> str:
    return f"{shared_folder(r.spark)}/{label}-{uuid.uuid4().hex}"


def _customers(r: Roles) -> tuple[DataFrame, DataFrame]:
    """The customer table and a batch of ids seen in orders, of which those of open orders are new."""
    current = r.raw("customer").select("c_custkey", F.col("c_name").alias("name"))
    key = F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 1000000000).otherwise(0)
    batch = r.raw("orders").select(
        key.alias("c_custkey"), F.concat(F.lit("order "), "o_orderkey").alias("name"), "o_orderkey"
    )
    return current, batch


@query
def insert_if_absent(r: Roles):
    """Customers seen in orders join the customer table; orders still open bring new ids."""
    return snapshots.insert_if_absent(*_customers(r), ["c_custkey"], order="o_orderkey")


@query
def insert_in_place(r: Roles):
    """The same in files, the batch in two parts and the second part twice."""
    current, batch = _customers(r)
    table = KeyedTable(r.spark, _scratch(r, "customers"), current.schema, ("c_custkey",))
    median = batch.agg(F.percentile_approx("o_orderkey", 0.5)).scalar()
    early, late = batch.where(F.col("o_orderkey") <= median), batch.where(F.col("o_orderkey") > median)
    for part in (current.withColumn("o_orderkey", F.lit(0)), early, late, late):
        snapshots.append_new(table, part, "o_orderkey")
    return table.read(table.data_files())


ENTRY_RULE = snapshots.Rule(["created_at"], "updated_at")


def _entries(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Orders as entries, and a batch of their line totals with returned lines as entries of their own."""
    day = F.col("o_orderdate").cast("date")
    current = r.raw("orders").select(
        F.col("o_orderkey").alias("entry"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        day.alias("created_at"),
        day.alias("updated_at"),
    )
    key = F.when(F.col("l_returnflag") == "R", -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    latest = F.max("l_shipdate").cast("date")
    batch = r.raw("lineitem").groupBy(key.alias("entry")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"),
        F.max(F.when(F.col("l_linestatus") == "F", "F")).alias("status"),
        latest.alias("created_at"),
        latest.alias("updated_at"),
    )
    return current, batch


@query
def upsert(r: Roles):
    """Line totals overwrite their orders' amounts; returned lines come in as entries of their own."""
    now = F.lit("2026-01-01").cast("date")
    return snapshots.upsert(*_entries(r), ["entry"], F.col("amount"), ENTRY_RULE.keep, ENTRY_RULE.touched, now)


def _entry_table(r: Roles, current: DataFrame) -> KeyedTable:
    year = ("entry_year", "YEAR(created_at)")
    table = KeyedTable(r.spark, _scratch(r, "entries"), current.schema, ("entry",), year)
    table.append(current)
    return table


@query
def upsert_in_place(r: Roles):
    """The same in files that lie in a folder a year, the batch twice."""
    current, batch = _entries(r)
    table, batch = _entry_table(r, current), materialize(batch, "batch")
    for _ in range(2):
        seen = batch.where("entry >= 0")  # then entries of their own, which a second time would touch
        snapshots.overwrite_touched(table, seen, F.col("amount"), ENTRY_RULE, F.lit("2026-01-01").cast("date"))
    snapshots.overwrite_touched(table, batch.where("entry < 0"), F.col("amount"), ENTRY_RULE, F.lit("2026-01-01").cast("date"))
    return table.read(table.data_files())


@query
def upsert_by_deltas(r: Roles):
    """The same with the batch set aside in three parts: two folded in, the third merged by the reader."""
    current, batch = _entries(r)
    table, batch = _entry_table(r, current), materialize(batch, "batch")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    own, large = F.col("entry") < 0, F.col("amount") > 100_000
    for number, part in enumerate([own, ~own & large, ~own & ~large]):
        snapshots.add_delta(table, batch.where(part), F.col("amount"), number, now)
        if number == 1:
            snapshots.compact(table, ENTRY_RULE)
    return snapshots.read_merged(table, ENTRY_RULE)
