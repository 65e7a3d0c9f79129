import math
import random

from pyspark.sql import functions as F

from aisleworks.operators import features, forecast
from aisleworks.plans.forecasting import Forecasting
from aisleworks.sources.tables import Tables
from tests.conftest import by, day, rows


def series(shop, days=60, products=("P1", "P2")):
    rng = random.Random(5)
    for p, product in enumerate(products):
        for n in range(days):
            if (n + p) % 9:  # calendar gaps
                level = 40 if day(n).weekday() >= 5 else 10
                shop.sale(n, product, qty=level + rng.randint(0, 2))
    return shop


def table(shop):
    ext = shop.external([(3, "East", "Rainy", 31.0, 4.0, True), (4, "West", "Sunny", 1.0, 1.0, True)])
    return features.feature_table(shop.tx, shop.date(), shop.product(), shop.category(), shop.store(), ext)


def test_lags_count_selling_days(shop):
    got = sorted((r for r in rows(table(series(shop))) if r["product_id"] == "P1"), key=lambda r: r["full_date"])
    q = [r["quantity_sold"] for r in got]
    assert len(q) > 31
    for i, r in enumerate(got):
        assert [r["lag_7d_qty"], r["lag_14d_qty"], r["lag_30d_qty"]] == [q[i - n] if i >= n else 0 for n in (7, 14, 30)]
        for n, name in ((7, "rolling_7d_avg"), (30, "rolling_30d_avg")):
            past = q[max(0, i - n):i]
            assert math.isclose(r[name], sum(past) / len(past) if past else 0.0)


def test_external_factors_match_region(shop):
    shop.sale(3).sale(4)
    got = by(table(shop), "full_date")
    assert (got[day(3)]["weather_type"], got[day(3)]["is_festival"], got[day(3)]["temperature_c"]) == ("Rainy", 1, 31.0)
    assert (got[day(4)]["weather_type"], got[day(4)]["is_festival"], got[day(4)]["temperature_c"]) == ("Unknown", 0, 20.0)
    assert got[day(3)]["day_of_week"] == day(3).isoweekday() and got[day(4)]["season_code"] == 1


def test_equal_factor_rows_repeat_the_sales(shop):
    shop.sale(3, qty=2)
    ext = shop.external([(3, "East", "Rainy", 31.0, 4.0, True)] * 2 + [(3, "East", "Sunny", 31.0, 4.0, True)])
    got = rows(features.feature_table(shop.tx, shop.date(), shop.product(), shop.category(), shop.store(), ext))
    assert {r["weather_type"]: r["quantity_sold"] for r in got} == {"Rainy": 4, "Sunny": 2}


def test_future_is_frozen_at_the_last_row(shop):
    built = table(series(shop))
    last = max((r for r in rows(built) if r["product_id"] == "P2"), key=lambda r: r["full_date"])
    ahead = [r for r in rows(features.future_features(built, day(100), 3)) if r["product_id"] == "P2"]
    assert sorted(r["forecast_date"] for r in ahead) == [day(101), day(102), day(103)]
    for r in ahead:
        assert r["rolling_7d_avg"] == last["rolling_7d_avg"] and r["lag_30d_qty"] == last["lag_30d_qty"]
        assert (r["rainfall_mm"], r["is_festival"]) == (0.0, 0)
        assert r["day_of_week"] == r["forecast_date"].isoweekday()
        assert r["is_weekend"] == int(r["forecast_date"].weekday() >= 5)


def test_too_little_data(shop, spark):
    few = table(series(shop, days=20, products=("P1",)))
    assert forecast.train_forecast(few).error == forecast.TOO_FEW_ROWS
    holes = table(series(shop, days=60)).withColumn("temperature_c", F.when(F.col("lag_30d_qty") > 1e9, 1.0))
    assert forecast.train_forecast(holes).error == forecast.TOO_FEW_CLEAN_ROWS


def test_train_predict_save_and_rank(spark, shop, tmp_path):
    series(shop)
    ext = shop.external([(3, "East", "Rainy", 31.0, 4.0, True)])
    tables = Tables(transaction=shop.tx, date=shop.date(), product=shop.product(), category=shop.category(),
                    store=shop.store(), external_factors=ext)
    plan = Forecasting(tables, str(tmp_path / "m"), as_of=day(60))
    assert plan.model_info(spark).count() == 0
    trained = plan.train(numTrees=20)
    metrics = rows(trained.metrics)[0]
    _, test = forecast.split_by_date(plan.features())
    mean = plan.features().agg(F.avg("quantity_sold")).first()[0]
    naive = rows(forecast.forecast_metrics(test.withColumn("prediction", F.lit(mean))))[0]
    assert metrics["mae"] < naive["mae"] / 2 and metrics["test_rows"] == test.count()
    info = rows(plan.model_info(spark))[0]
    assert info["mae"] == metrics["mae"] and len(info["features_used"]) == 14
    weights = [w["importance"] for w in info["feature_importance"]]
    assert weights == sorted(weights, reverse=True) and abs(sum(weights) - 1) < 0.01

    daily = rows(plan.daily(7))
    assert len(daily) == 14 and all(r["predicted_qty"] >= 0 for r in daily)
    assert all(r["is_weekend"] == (r["date"].weekday() >= 5) for r in daily)
    total = by(plan.demand(7), "product_id")["P1"]
    assert total["days_ahead"] == 7 and [d["date"] for d in total["daily_forecast"]] == [day(60 + n) for n in range(1, 8)]
    assert math.isclose(total["total_predicted_qty"], sum(d["predicted_qty"] for d in total["daily_forecast"]))
    assert len(rows(plan.top_demand(top_n=1))) == 1
    assert plan.weekly_quantity().columns == ["product_id", "store_id", "forecast_7d_qty"]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 2.0), (10, 8.0), (4, -3.0)], "quantity_sold int, prediction double")
    got = rows(forecast.forecast_metrics(df))[0]
    assert got == {"mae": 2.667, "rmse": 2.828, "mape_pct": 106.67, "mean_actual_qty": 4.667, "test_rows": 3}


def test_top_demand_breaks_ties_by_product(spark):
    history = spark.createDataFrame([("B", "S1", 5), ("A", "S1", 5), ("C", "S1", 1)],
                                    "product_id string, store_id string, quantity_sold bigint")
    totals = spark.createDataFrame([(p, "S1", p, "c", 1.0) for p in "ABC"],
                                   "product_id string, store_id string, product_name string, category string, "
                                   "total_predicted_qty double")
    assert [r["product_id"] for r in rows(forecast.top_demand_forecast(forecast.leaders(history, top_n=1), totals))] == ["A"]
