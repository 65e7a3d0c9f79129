import pytest
from pyspark.sql import functions as F

from aisleworks.functions.ladders import trend_label
from aisleworks.operators import festivals, sales, spikes, taste, trends
from tests.conftest import by, day, rows


def test_trend_label_bounds(spark):
    cases = {25.0: "SPIKE", 24.99: "RISING", 10.0: "RISING", 9.99: "STABLE", -10.0: "STABLE", -10.01: "FALLING",
             -25.0: "FALLING", -25.01: "CRASH"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r[0]: r[1] for r in df.select("x", trend_label(F.col("x"))).collect()} == cases


def trend(shop):
    return by(trends.category_trends(shop.tx, shop.date(), shop.product(), shop.category()), "category_name")


def test_category_trend(shop):
    shop.sale(50, "P1", value="100").sale(45, "P1", value="50").sale(42, "P1", value="60", qty=3)
    shop.sale(20, "P1", value="1000").sale(19, "P1", value="9999")  # 30 days back counts, 31 does not
    shop.sale(50, "P1", value="5", status="Cancelled").sale(50, "P1", value="5", returned=True)
    shop.sale(50, "P1", value="5", status=None).sale(400, "P1", value="5")  # unknown date
    shop.sale(44, "P2", value="0.01")  # only last week: no change
    got = trend(shop)
    one = got["Cat 1"]
    assert (one["last_7d_avg_revenue"], one["prev_7d_avg_revenue"], one["change_pct"]) == (75.0, 60.0, 25.0)
    assert (one["trend_label"], float(one["total_30d_revenue"]), one["total_30d_units"]) == ("SPIKE", 1210.0, 6)
    assert one["recommended_action"].startswith("Increase stock")
    assert (got["Cat 2"]["change_pct"], got["Cat 2"]["trend_label"]) == (0.0, "STABLE")


def test_last_day_ignores_sales_without_a_category(shop):
    shop.sale(50, "P8", value="1").sale(49, "P1", value="100").sale(42, "P1", value="50")  # P8 has no category
    assert trend(shop)["Cat 1"]["change_pct"] == 100.0


def test_store_trend_and_orphans(shop):
    shop.sale(50, store="S1", value="10").sale(40, store="S1", value="20").sale(50, store="XX", value="99")
    shop.sale(500)
    got = by(trends.store_trends(shop.tx, shop.date(), shop.store()), "store_name")
    assert list(got) == ["Store 1"] and got["Store 1"]["change_pct"] == -50.0
    lost = {r["missing_key"]: r["orphan_sales"]
            for r in rows(sales.orphan_sales(shop.tx, shop.date(), shop.product(), shop.store()))}
    assert lost == {"date_id": 1, "product_id": 0, "store_id": 1}


def test_spikes_and_status(shop):
    for n in range(40, 50):
        shop.sale(n, "P1", qty=10 if n % 2 else 12).sale(n, "P2", qty=5)
    shop.sale(50, "P1", qty=40).sale(19, "P1", qty=1)  # 31 days back is inside the window
    shop.sale(50, "P3", qty=4)  # one selling day
    args = shop.tx, shop.date(), shop.product(), shop.category()
    found = by(spikes.demand_spikes(*args), "category_name")
    assert list(found) == ["Cat 1"] and found["Cat 1"]["status"] == "SPIKE"
    assert found["Cat 1"]["mean_units"] == 12.58
    status = by(spikes.category_demand_status(*args), "category_name")
    assert status["Cat 2"]["latest_units"] is None and status["Cat 2"]["status"] == "DROP"  # idle last day
    assert status["Cat 2"]["z_score"] == -500.0
    assert status["Cat 3"]["stddev_units"] is None and status["Cat 3"]["z_score"] == 0.0


def test_threshold_is_strict(shop):
    shop.sale(48, "P1", qty=1).sale(49, "P1", qty=2).sale(50, "P1", qty=3)  # z exactly 1
    args = shop.tx, shop.date(), shop.product(), shop.category()
    assert rows(spikes.demand_spikes(*args, z_threshold=1.0)) == []
    assert len(rows(spikes.demand_spikes(*args, z_threshold=0.99))) == 1


def test_weather_and_uplift(shop):
    shop.sale(1, value="10").sale(1, value="30").sale(2, value="20").sale(3, value="7")
    ext = shop.external([(1, "East", "Rainy", 20.0, 1.0, True), (2, "East", "Rainy", 30.0, None, False)])
    got = by(spikes.weather_demand(shop.tx, shop.date(), ext), "weather_type")
    rainy = got["Rainy"]
    assert (rainy["days_count"], rainy["total_transactions"], rainy["avg_basket"]) == (2, 3, 20.0)
    assert (rainy["avg_temp_c"], rainy["avg_rainfall_mm"]) == (23.3, 1.0)  # weighted by sales
    assert got["No External Data"]["avg_temp_c"] is None
    uplift = rows(festivals.festival_uplift(shop.tx, shop.date(), ext))[0]
    assert uplift == {"festival_uplift_pct": 100.0, "festival_avg_daily": 40.0, "normal_avg_daily": 20.0}


def test_uplift_with_only_one_kind_of_day(shop):
    shop.sale(1, value="10")
    festive = shop.external([(1, "East", "Rainy", 20.0, 1.0, True)])
    assert rows(festivals.festival_uplift(shop.tx, shop.date(), festive))[0]["festival_uplift_pct"] == 1000.0
    normal = shop.external([(1, "East", "Rainy", 20.0, 1.0, False)])
    assert rows(festivals.festival_uplift(shop.tx, shop.date(), normal))[0]["festival_uplift_pct"] == -100.0


def test_upcoming_festival_window(spark):
    df = spark.createDataFrame([(f"FES{n}", day(n)) for n in (-1, 0, 30, 31)],
                               "festival_id string, festival_start_date date")
    for name in ["festival_name", "religion", "festival_end_date", "festival_period_days", "is_national_holiday",
                 "historically_consistent_uplift", "demand_level", "expected_demand_multiplier"]:
        df = df.withColumn(name, F.lit(None).cast("string"))
    got = by(festivals.upcoming_festivals(df, as_of=day(0)), "festival_id")
    assert {k: v["days_until"] for k, v in got.items()} == {"FES0": 0, "FES30": 30}


def test_festival_products(spark, shop):
    shop.sale(20, "P1", qty=3).sale(21, "P1", qty=4).sale(1, "P2", qty=50)
    listed = spark.createDataFrame([("FES1", 1, "P1"), ("FES1", 2, "P2"), ("FES2", 1, "P1")],
                                   "festival_id string, rank int, product_id string")
    stock = shop.inventory([("I1", "P1", "S1", 5, 9, 2, 1, 3, "1", None, False),
                            ("I2", "P1", "S2", 6, 9, 3, 1, 3, "1", None, False)])
    got = festivals.festival_product_recs(
        listed, shop.product(), shop.category(), stock, shop.tx, shop.date(), as_of=day(50), festival_id="FES1")
    first, second = sorted(rows(got), key=lambda r: r["rank"])
    assert (first["daily_avg_units"], first["recommended_extra_stock"], first["avg_closing_stock"]) == (3.5, 7.0, 6.0)
    assert first["stock_note"] == "Low stock — order urgently"
    assert (second["daily_avg_units"], second["avg_closing_stock"]) == (0.0, None)
    assert second["stock_note"] == "Stock sufficient"


def test_store_preferences_keep_ties_and_count_orphans(shop):
    for n in range(1, 5):
        shop.sale(1, f"P{n}", value=str(100 - n))
    shop.sale(1, "P5", value="10").sale(1, "P6", value="10").sale(1, "P7", value="1")
    shop.sale(1, "P8", value="589")  # no category, but part of the store's total
    shop.sale(1, "P1", store="S2", value="5")
    got = rows(taste.store_category_preferences(shop.tx, shop.store(), shop.product(), shop.category(), ["S1"]))
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5, 5]
    assert next(r for r in got if r["rank"] == 1)["revenue_share_pct"] == 9.9


def test_payment_and_customers(spark, shop):
    shop.sale(1).sale(1, mode="Cash", customer="C2").sale(2, mode=None, customer=None).sale(2, customer="C3")
    shop.sale(3, customer="C1", value="5")
    pay = by(taste.payment_preference(shop.tx, shop.store()), "payment_mode")
    assert {k: (v["txn_count"], v["pct"]) for k, v in pay.items()} == {"UPI": (3, 75.0), "Cash": (1, 25.0)}
    people = spark.createDataFrame([("C1", "NEW"), ("C2", "NEW"), ("C3", "VIP")],
                                   "customer_id string, customer_type string")
    kinds = rows(taste.customer_type_breakdown(shop.tx, shop.store(), people))
    assert len(kinds) == 1
    assert (kinds[0]["unique_customers"], kinds[0]["total_transactions"], float(kinds[0]["total_spend"]),
            kinds[0]["avg_basket"]) == (2, 3, 25.0, 8.33)


def test_seasonal_rank(shop):
    shop.sale(1, "P1", value="5").sale(3, "P1", value="6").sale(1, "P2", value="11").sale(2, "P1", value="1")
    got = {(r["season"], r["category_name"]): r["rank_in_season"]
           for r in rows(taste.seasonal_category_mix(shop.tx, shop.date(), shop.product(), shop.category()))}
    assert got == {("Summer", "Cat 1"): 1, ("Summer", "Cat 2"): 1, ("Winter", "Cat 1"): 1}


@pytest.mark.parametrize("share", [0.34])
def test_hot_product_and_store_stay_whole(spark, shop, share):
    """A third of all sales on one product: totals stay exact."""
    n = 3000
    tx = spark.range(n).select(
        F.col("id").cast("string").alias("transaction_id"), (F.lit(100) + F.col("id") % 40).cast("int").alias("date_id"),
        F.when(F.col("id") < n * share, "S1").otherwise("S2").alias("store_id"), F.lit("C1").alias("customer_id"),
        F.when(F.col("id") < n * share, "P1").otherwise(F.concat(F.lit("P"), F.col("id") % 7 + 1)).alias("product_id"),
        F.lit(1).alias("quantity_sold"), F.lit("1.00").cast("decimal(18,2)").alias("final_sale_value"),
        F.lit("UPI").alias("payment_mode"), F.lit("Completed").alias("transaction_status"),
        F.lit(False).alias("is_return"))
    mix = taste.seasonal_category_mix(tx, shop.date(), shop.product(), shop.category())
    assert mix.agg(F.sum("total_units")).first()[0] == n
