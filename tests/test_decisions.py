import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aisleworks.functions.pricing import clearance_price, expiry_discount
from aisleworks.operators import alerts, decisions, orders
from tests.conftest import by, day, rows

TODAY = day(0)


def item(i, closing, reorder, safety=5, consumed=1, lead=3, product="P1", store="S1", cost="2.50", expires=None):
    return (i, product, store, closing, reorder, safety, consumed, lead, cost, expires, False)


def candidates(shop, *items, **options):
    return decisions.restock_candidates(
        shop.inventory(list(items)), shop.product(), shop.category(), shop.store(), shop.supplier(),
        as_of=TODAY, **options)


def test_urgency_ladder(shop):
    got = by(candidates(
        shop,
        item("crit", 6, 20, consumed=2), item("high", 12, 20, consumed=2), item("medium", 14, 20, consumed=2),
        item("low", 14, 19, consumed=2), item("equal", 20, 20), item("over", 21, 20), item("negative", -1, 20),
        item("zero", 0, 20), item("never", 5, 20, consumed=0), item("nolead", 13, 20, consumed=1, lead=None),
        item("zerolead", 7, 20, consumed=1, lead=0),
    ), "inventory_id")
    assert set(got) == {"crit", "high", "medium", "low", "equal", "zero", "never", "nolead", "zerolead"}
    word = {k: v["urgency"].split()[1] for k, v in got.items()}
    assert (word["crit"], word["high"], word["medium"], word["low"]) == ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    assert word["zero"] == "MEDIUM" and got["zero"]["days_until_stockout"] == 999.0
    assert got["zero"]["raw_days_until_stockout"] == 0.0
    assert got["never"]["days_until_stockout"] == 999.0
    assert got["nolead"]["lead_time_days"] == 6  # the supplier's
    assert got["zerolead"]["lead_time_days"] == 0 and word["zerolead"] == "CRITICAL"  # judged with 7
    assert got["crit"]["order_deadline"] == TODAY + dt.timedelta(days=1)
    assert got["zerolead"]["order_deadline"] == TODAY + dt.timedelta(days=5)
    assert float(got["crit"]["current_stock_value"]) == 15.0


def test_zero_stock_flag(shop):
    row = rows(candidates(shop, item("zero", 0, 20), zero_stock_critical=True))[0]
    assert row["urgency"].startswith("🔴 CRITICAL") and row["days_until_stockout"] == 0.0


@pytest.mark.parametrize("closing,safety,reorder,lead,forecast,quantity,method", [
    (10, 5, 20, 3, 0.0, 15.0, "gap-based"),
    (0, 0, 1, 7, 2.5, 2.0, "forecast-based"),  # 2.5 rounds to even
    (0, 0, 1, 7, 3.5, 4.0, "forecast-based"),
    (10, 5, 40, 7, 7.0, 30.0, "forecast-based"),  # never below the gap
    (50, 5, 40, 7, 0.0, 0.0, "gap-based"),
])
def test_restock_quantity(spark, closing, safety, reorder, lead, forecast, quantity, method):
    df = spark.createDataFrame(
        [(closing, safety, reorder, lead, forecast)],
        "closing_stock int, safety_stock int, reorder_level int, lead_time_days int, forecast_7d_qty double")
    row = rows(decisions.with_restock_quantity(df, as_of=TODAY))[0]
    assert (row["restock_qty"], row["method"]) == (quantity, method)
    assert row["daily_demand_est"] == round(forecast / 7, 2)


def test_expiry_tiers(spark):
    want = {-1: (50, "IMMEDIATE"), 0: (50, "IMMEDIATE"), 5: (45, "IMMEDIATE"), 7: (45, "IMMEDIATE"), 8: (30, "HIGH"),
            15: (30, "HIGH"), 16: (25, "MEDIUM"), 30: (25, "MEDIUM"), 31: (15, "MEDIUM"), 60: (15, "MEDIUM"),
            61: (7, "MEDIUM"), 90: (7, "MEDIUM"), 91: (0, "NONE")}
    df = spark.createDataFrame([(d,) for d in want], "d int").withColumns(expiry_discount(F.col("d")))
    got = by(df, "d")
    assert {d: (r["discount_pct"], r["urgency"]) for d, r in got.items()} == want
    assert got[5]["action"] == "Apply 45% discount immediately. Sell within 5 days."
    assert got[5]["discount_range"] == "40–50%" and got[0]["discount_range"] is None
    assert got[91]["label"] == "✅ FRESH"


def test_clearance_matches_float_arithmetic(spark):
    cases = [(s / 100, c / 100, p) for s in (990, 1005, 12345) for c in (500, 980) for p in (0, 7, 30, 45, 50)]
    df = spark.createDataFrame(cases, "s double, c double, p int").select(
        "*", *[v.alias(k) for k, v in clearance_price(F.col("s"), F.col("c"), F.col("p")).items()])
    for row in rows(df):
        s, c, p = row["s"], row["c"], row["p"]
        discounted, floor = s * (1 - p / 100), c * 1.01
        final = max(discounted, floor)
        assert row["clearance_price"] == round(final, 2)
        assert row["actual_discount_pct"] == round((1 - final / s) * 100, 2)
        assert row["margin_after_pct"] == round((final - c) / final * 100, 2)
        assert row["floor_applied"] == (final > discounted)


def test_zero_price_gives_null(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10)], "s double, c double, p int")
    row = df.select(*[v.alias(k) for k, v in clearance_price(F.col("s"), F.col("c"), F.col("p")).items()]).first()
    assert row["actual_discount_pct"] is None and row["margin_after_pct"] is None


def test_expiry_and_stockout(shop):
    stock = shop.inventory([
        item("a", 4, 9, expires=0), item("b", 4, 9, expires=90), item("c", 4, 9, expires=91),
        item("d", 0, 9, expires=3), item("e", 4, 9, expires=-1), item("f", 4, 9), item("g", 4, 9, store="S9", expires=3)])
    due = by(decisions.expiry_alerts(stock, shop.product(), shop.category(), shop.store(), as_of=TODAY), "inventory_id")
    assert set(due) == {"a", "b"}
    assert float(due["a"]["value_at_risk"]) == 10.0 and due["a"]["discount_pct"] == 50
    out = rows(decisions.stockout_alerts(stock, shop.product(), shop.category(), shop.store(), shop.supplier()))
    assert [r["closing_stock"] for r in out] == [0] and out[0]["lead_time_days"] == 3


def test_low_margin(shop):
    def p(name, sell, cost):
        return (name, name, 1, "SUP1", "1", sell, cost)
    goods = shop.product([p("loss", "10.00", "20.69"), p("none", "10.00", "10.00"), p("m499", "100.00", "95.01"),
                          p("m5", "100.00", "95.00"), p("m999", "100.00", "90.01"), p("m10", "100.00", "90.00"),
                          p("free", "0.00", "5.00")])
    got = by(decisions.low_margin_products(goods, shop.category(), shop.supplier()), "product_id")
    assert {k: (v["margin_pct"], v["margin_label"].split()[1]) for k, v in got.items()} == {
        "loss": (-106.9, "SELLING"), "none": (0.0, "NEAR"), "m499": (4.99, "NEAR"), "m5": (5.0, "LOW"),
        "m999": (9.99, "LOW")}
    assert got["loss"]["recommended_action"].startswith("Raise price")


def test_latest_snapshot(spark):
    df = spark.createDataFrame([("a", "P1", "S1", 1), ("b", "P1", "S1", 2), ("c", "P1", "S2", 1)],
                               "inventory_id string, product_id string, store_id string, date_id int")
    assert sorted(r["inventory_id"] for r in rows(decisions.latest_inventory(df))) == ["b", "c"]


def make_orders(shop, spark, n_critical=7, n_high=0, n_low=5, top_n=50):
    stock = [item(f"c{n:02}", 5, 40 + n, consumed=5) for n in range(n_critical)]
    stock += [item(f"h{n:02}", 10, 30 + n, consumed=2) for n in range(n_high)]
    stock += [item(f"l{n:02}", 30, 33, consumed=1, store="S2") for n in range(n_low)]
    forecast = spark.createDataFrame([("P1", "S1", 70.0)], "product_id string, store_id string, forecast_7d_qty double")
    return orders.restock_orders(candidates(shop, *stock), forecast, top_n=top_n, as_of=TODAY)


def test_orders_per_store(spark, shop):
    made = make_orders(shop, spark, top_n=3)
    got = rows(made)
    assert sorted((r["store_id"], r["order_seq"]) for r in got) == [(s, n) for s in ("S1", "S2") for n in (1, 2, 3)]
    first = next(r for r in got if r["store_id"] == "S1" and r["order_seq"] == 1)
    assert first["reorder_level"] == 46 and first["forecast_7d_qty"] == 70.0  # biggest gap first
    assert (first["restock_qty"], first["estimated_order_value"]) == (41.0, 102.5)
    other = next(r for r in got if r["store_id"] == "S2")
    assert other["forecast_7d_qty"] == 0.0 and other["calculation_method"] == "gap-based"


def test_run_summary(spark, shop):
    made = make_orders(shop, spark)
    scanned = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "store_id string")
    got = by(orders.restock_run_summary(made, scanned), "store_id")
    assert (got["S1"]["orders_created"], got["S1"]["critical_count"]) == (7, 7)
    assert (got["S3"]["orders_created"], got["S3"]["total_order_value"]) == (0, 0.0)
    total = rows(orders.restock_run_totals(made, TODAY))[0]
    assert (total["total_orders"], total["critical_orders"], total["high_orders"]) == (12, 7, 0)


def test_restock_alerts(spark, shop):
    made = make_orders(shop, spark)
    got = rows(alerts.restock_alerts(made, TODAY))
    assert len(got) == 1  # no HIGH order, no alert for it; S2 has no critical one
    assert got[0]["title"] == "🔴 CRITICAL: 7 products stockout risk at S1"
    assert "Top item: Product 1 (stock: 5, order 41.0 units from Supplier 1 by 2026-01-02)." in got[0]["message"]
    assert [o["reorder_level"] for o in got[0]["data"]] == [46, 45, 44, 43, 42]


def test_high_alert_covers_all_and_shows_ten(spark, shop):
    made = make_orders(shop, spark, n_critical=0, n_high=12)
    got = rows(alerts.route_alerts(alerts.restock_alerts(made, TODAY)))
    assert [a["priority"] for a in got] == ["HIGH"]
    total = sum(Decimal(str(r["estimated_order_value"])) for r in rows(made) if "HIGH" in r["urgency"])
    assert got[0]["message"].endswith(f"₹{total:,.0f}.") and got[0]["title"].startswith("🟠 HIGH: 12 ")
    assert len(got[0]["data"]) == 10 and got[0]["channels"] == ["telegram", "email"]
    assert (got[0]["dispatched"], got[0]["dry_run"]) == (False, True)


def test_unknown_priority_goes_to_the_dashboard(spark):
    df = spark.createDataFrame([("LOW",), ("odd",), ("MEDIUM",), ("CRITICAL",)], "priority string").withColumn("data", F.lit(1))
    routed = alerts.route_alerts(df, dry_run=False)
    assert {r["priority"]: r["channels"] for r in rows(routed)} == {
        "LOW": ["dashboard"], "odd": ["dashboard"], "MEDIUM": ["email"], "CRITICAL": ["whatsapp", "telegram"]}
    assert alerts.alert_outbox(routed).count() == 5


def test_expiry_rollup(shop):
    stock = shop.inventory([item(f"i{n:02}", 4, 9, expires=n) for n in (0, 1, 2, 3, 4, 5, 7, 8, 15, 16)])
    due = decisions.expiry_alerts(stock, shop.product(), shop.category(), shop.store(), as_of=TODAY)
    got = by(alerts.expiry_alert_rollup(due, TODAY), "priority")
    assert got["CRITICAL"]["title"] == "🔴 EXPIRY: 7 products expire within 7 days!"
    assert got["CRITICAL"]["message"].startswith("₹70 at risk.")
    assert [i["days_to_expiry"] for i in got["CRITICAL"]["data"]] == [0, 1, 2, 3, 4]
    assert len(got["HIGH"]["data"]) == 2


def test_supplier_documents(spark, shop):
    made = make_orders(shop, spark)
    head = rows(orders.supplier_orders(made))
    assert len(head) == 1 and head[0]["total_items"] == 12 and "lines" not in head[0]
    shown = rows(orders.printed_lines(made))[0]["lines"]
    assert [x["line_no"] for x in shown] == list(range(1, 11))
    assert all("CRITICAL" in x["urgency"] for x in shown[:7])
    assert orders.supplier_order_lines(made).count() == 12
    text = rows(orders.supplier_messages(made, TODAY, sender="SHOP", signature="— Shop"))[0]["order_message"].split("\n")
    assert text[0] == "🏪 SHOP — Purchase Order Request" and text[1] == "📅 Date: 01 Jan 2026"
    assert text[4] == "" and text[5] == "ORDER DETAILS:" and text[-1] == "— Shop"
    assert text[6].startswith("1. Product 1 | Store: S1 | Qty: 41 units | Urgency: 🔴 CRITICAL")
    assert "... and 2 more items." in text
    assert text[17:19] == ["", f"💰 Estimated Order Value: ₹{head[0]['total_value']:,.0f}"]
