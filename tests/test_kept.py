"""Tables kept up to date by increments: the daily grain and the feature table."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aisleworks.operators import features, sales, trends
from aisleworks.sources import rollup, snapshots
from aisleworks.sources.keyed_files import KeyedTable
from aisleworks.sources.rollup import as_facts, changed_days, daily_grain, refresh, rollup_table
from tests.conftest import Shop, day, rows

TX = (
    "transaction_id string, date_id int, store_id string, customer_id string, product_id string, quantity_sold int, "
    "final_sale_value decimal(18,2), payment_mode string, transaction_status string, is_return boolean"
)


def sold(spark, found):
    """(id, date id, product, units, returned) rows."""
    return spark.createDataFrame(
        [(i, d, "S1", "C1", p, n, Decimal(n) * 3, "UPI", "Completed", r) for i, d, p, n, r in found], TX
    )


def months(spark):
    """Three months of days with ids of eight digits, of which the folders take the month."""
    dates = [(20260000 + day(n).month * 100 + day(n).day, day(n), day(n).strftime("%A"), day(n).month, False, "Winter") for n in range(90)]
    return spark.createDataFrame(dates, "date_id int, full_date date, day_name string, month_number int, is_weekend boolean, season string")


def tables(spark, tmp_path, schema):
    facts = KeyedTable(spark, str(tmp_path / "facts"), schema, ("transaction_id",), (sales.MONTH, "CAST(FLOOR(date_id / 100) AS INT)"))
    return facts, rollup_table(spark, str(tmp_path / "rollup"))


def merge(spark, facts, kept, batch):
    days = spark.createDataFrame(changed_days(facts, batch).collect(), "date_id int")
    snapshots.overwrite_touched(facts, batch, F.col("quantity_sold"), snapshots.Rule())
    refresh(kept, spark.read.schema(facts.schema).parquet(facts.path), days)


def scanned_folders(df):
    """Paths under the scans of the executed plan."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            roots = node.relation().location().rootPaths()
            found.append((roots.apply(0).toString(), node.metrics().apply("numFiles").value()))
        for inner in ([node.plan()] if kind.endswith("QueryStageExec") else [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else []):
            walk(inner)
        for many in (node.children(), node.subqueries()):
            for i in range(many.size()):
                walk(many.apply(i))

    walk(text)
    return found


def test_grain_follows_late_sales_returns_and_moves(spark, tmp_path):
    first = sold(spark, [(f"T{n}", 20260101 + n % 28 + n % 3 * 100, f"P{n % 4}", n % 5 + 1, False) for n in range(120)])
    facts, kept = tables(spark, tmp_path, first.schema)
    merge(spark, facts, kept, first)
    changes = [
        [("T7", 20260108, "P3", 3, True), ("T8", 20260301, "P0", 9, False)],  # a return, and a sale that moves to another month
        [("T900", 20260102, "P1", 50, False), ("T901", 20260102, "P1", 7, False)],  # late sales
        [("T900", 20260102, "P1", 50, False), ("T901", 20260102, "P1", 7, False)],  # and again
    ]
    for change in changes:
        merge(spark, facts, kept, sold(spark, change))
        now = spark.read.schema(facts.schema).parquet(facts.path)
        order = [*rollup.GRAIN]
        assert rows(kept.read(kept.data_files()).orderBy(*order)) == rows(daily_grain(now).select(kept.columns).orderBy(*order))
    before = set(kept.data_files())
    merge(spark, facts, kept, sold(spark, [("T902", 20260130, "P1", 1, False)]))
    assert {name.split("/")[0] for name in before ^ set(kept.data_files())} == {"sale_month=202601"}


def test_reports_read_the_grain_and_no_fact(spark, tmp_path):
    shop = Shop(spark)
    found = sold(spark, [(f"T{n}", 20260101 + n % 28 + n % 3 * 100, f"P{n % 4 + 1}", n % 5 + 1, n % 11 == 0) for n in range(200)])
    facts, kept = tables(spark, tmp_path, found.schema)
    merge(spark, facts, kept, found)
    dates = months(spark)
    stored = as_facts(spark.read.schema(kept.schema).parquet(kept.path))
    report = trends.category_trends(stored, dates, shop.product(), shop.category())
    direct = trends.category_trends(found, dates, shop.product(), shop.category())
    assert rows(report.orderBy("category_name")) == rows(direct.orderBy("category_name"))
    assert all("/facts" not in path for path, _ in scanned_folders(report))


def test_recent_sales_open_the_months_they_need(spark, tmp_path):
    shop = Shop(spark)
    found = sold(spark, [(f"T{n:04d}", 20260101 + n % 28 + n % 3 * 100, "P1", 1, False) for n in range(90)])
    facts, _ = tables(spark, tmp_path, found.schema)
    snapshots.overwrite_touched(facts, found, F.col("quantity_sold"), snapshots.Rule())
    dates = months(spark)
    stored = spark.read.schema(facts.schema).parquet(facts.path)
    recent = sales.sales_since(stored, dates, F.lit(day(59)).cast("date")).select("transaction_id", "full_date")
    files = {int(name.split("/")[0].split("=")[1]) for name in facts.data_files()}
    assert files == {202601, 202602, 202603}
    assert [n for path, n in scanned_folders(recent) if path.endswith("/facts")] == [1]
    plain = sales.sales_since(found, dates, F.lit(day(59)).cast("date")).select("transaction_id", "full_date")
    assert sorted(map(tuple, recent.collect())) == sorted(map(tuple, plain.collect()))
    assert trends.store_trends(stored, dates, shop.store()).count() == 1


def grown_rows(table):
    shown = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in table.dtypes]
    return sorted(map(tuple, table.select(*shown).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_features_after_increments_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    shop = Shop(spark)
    found = [(f"T{n}", 100 + rng.randrange(60), f"P{rng.randrange(1, 4)}", rng.randrange(1, 9), False) for n in range(400)]
    others = (shop.date(), shop.product(), shop.category(), shop.store(), shop.external([(n, "East", "Sun", 30.0, 0.0, n % 9 == 0) for n in range(0, 60, 2)]))
    batches = [
        [r for r in found if r[1] < 140],
        [r for r in found if 140 <= r[1] < 150],
        [r for r in found if r[1] >= 150],
        [("T5000", 125, "P1", 70, False), ("T5001", 101, "P3", 11, False)],  # late days
        [(found[0][0], *found[0][1:4], True), ("T5002", 159, "P2", 5, False)],  # a return takes a sale out
    ]
    seen: dict[str, tuple] = {}
    table = None
    for batch in batches:
        days = {seen[r[0]][1] for r in batch if r[0] in seen} | {r[1] for r in batch}
        seen |= {r[0]: r for r in batch}
        tx = sold(spark, list(seen.values()))
        if table is None:
            table = features.feature_table(tx, *others)
            continue
        changed = spark.createDataFrame([(day(d - 100),) for d in days], "full_date date")
        now = features.selling_days(tx.where(F.col("date_id").isin(list(days))), *others)
        table = features.features_after(table, changed, now)
        table = spark.createDataFrame(table.collect(), table.schema)  # stored between increments
        assert grown_rows(table) == grown_rows(features.feature_table(tx, *others).select(table.columns))


def test_calendar_lags_count_days_without_sales(spark):
    shop = Shop(spark)
    for on, qty in ((0, 4), (7, 5), (8, 6), (30, 9)):
        shop.sale(on, qty=qty)
    table = features.feature_table(shop.tx, shop.date(), shop.product(), shop.category(), shop.store(), shop.external([]), by=features.DAYS)
    got = {r["full_date"]: r for r in table.collect()}
    assert got[day(7)]["lag_7d_qty"] == 4 and got[day(8)]["lag_7d_qty"] == 0 and got[day(8)]["rolling_7d_avg"] == 5
    assert got[day(30)]["lag_30d_qty"] == 4 and got[day(30)]["rolling_30d_avg"] == 5 and got[day(30)]["rolling_7d_avg"] == 0
    with pytest.raises(ValueError):
        features.with_history(table, "weeks")
