"""Physical plans: what must and must not be in them, and the report surface."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from aisleworks.operators import trends
from aisleworks.plans import agents
from aisleworks.plans.presentation import present
from aisleworks.plans.reports import Reports
from aisleworks.sources.tables import Tables
from driverbind.catalog import QUERIES
from tests.conftest import day, rows

FOLDER = "/root/testdata/sf0.001"
TRAINED = {"train_forecast", "feature_importance", "predict_demand", "top_demand_forecast"}


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]:
        assert operator not in plan


@pytest.mark.parametrize("name", ["restock_orders", "top_demand", "supplier_orders", "insert_if_absent"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark, shop, tmp_path):
    shop.sale(50)
    shop.tx.write.parquet(str(tmp_path / "tx"))
    tx = spark.read.parquet(str(tmp_path / "tx"))
    plan = plan_of(trends.store_trends(tx, shop.date(), shop.store()))
    scan = next(line for line in plan.split("\n") if "PushedFilters" in line and "final" not in line)
    for pushed in ["EqualTo(transaction_status,Completed)", "Not(EqualTo(is_return,true))", "GreaterThanOrEqual(date_id,ScalarSubquery"]:
        assert pushed in plan, scan
    assert "payment_mode" not in plan and "customer_id" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reports_and_runs(spark, shop):
    shop.sale(50).sale(49, "P2").sale(30, "P3")
    stock = shop.inventory([("I1", "P1", "S1", 5, 40, 5, 5, 3, "2", 3, False), ("I2", "P2", "S2", 0, 9, 1, 1, 2, "1", 9, True)])
    ext = shop.external([(50, "East", "Rainy", 20.0, 1.0, True)])
    people = spark.createDataFrame([("C1", "NEW")], "customer_id string, customer_type string")
    tables = Tables(transaction=shop.tx, date=shop.date(), product=shop.product(), category=shop.category(),
                    store=shop.store(), supplier=shop.supplier(), inventory=stock, external_factors=ext, customer=people)
    reports = Reports(tables, as_of=day(0))
    for name in ["category_trends", "store_trends", "category_demand_status", "weather_demand", "festival_day_revenue",
                 "festival_uplift", "store_category_preferences", "seasonal_category_mix", "payment_preference",
                 "customer_type_breakdown", "restock_candidates", "stockout_alerts", "expiry_alerts"]:
        assert rows(getattr(reports, name)())
    reports.demand_spikes().collect(), reports.low_margin_products().collect()
    for call in [lambda: reports.demand_spikes(0.5), lambda: reports.upcoming_festivals(91), lambda: reports.expiry_alerts(0)]:
        with pytest.raises(ValueError):
            call()

    forecast = spark.createDataFrame([("P1", "S1", 7.0)], "product_id string, store_id string, forecast_7d_qty double")
    notice = agents.restock_notify(tables, forecast, as_of=day(0), sender="SHOP")
    assert notice.run.totals.first()["total_orders"] == 2
    assert [a["priority"] for a in rows(notice.alerts)] == ["CRITICAL"]
    assert rows(notice.supplier_orders)[0]["order_message"].startswith("🏪 SHOP")
    one_store = agents.restock_run(tables, forecast, stores=["S2"], as_of=day(0))
    assert [r["store_id"] for r in rows(one_store.summary)] == ["S2"]
    items, routed = agents.expiry_notify(tables, as_of=day(0))
    assert len(rows(items)) == 1 and rows(routed)[0]["channels"] == ["whatsapp", "telegram"]


def test_descending_reports_put_missing_first(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (2.0, "c")], "z_score double, category_name string")
    assert [r["category_name"] for r in rows(present("demand_spikes", df))] == ["b", "c", "a"]
