import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from aisleworks.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DAY0 = dt.date(2026, 1, 1)


def day(n: int) -> dt.date:
    return DAY0 + dt.timedelta(days=n)


class Shop:
    """Small retail tables built row by row."""

    def __init__(self, spark):
        self.spark = spark
        self.sales = []

    def sale(self, on: int, product="P1", store="S1", qty=1, value="10.00", customer="C1", mode="UPI",
             status="Completed", returned=False):
        self.sales.append(
            (f"T{len(self.sales)}", 100 + on, store, customer, product, qty, Decimal(value), mode, status, returned)
        )
        return self

    @property
    def tx(self):
        return self.spark.createDataFrame(
            self.sales,
            "transaction_id string, date_id int, store_id string, customer_id string, product_id string, "
            "quantity_sold int, final_sale_value decimal(18,2), payment_mode string, transaction_status string, "
            "is_return boolean",
        )

    def date(self, days: int = 60):
        names = ["Winter", "Summer"]
        rows = [
            (100 + n, day(n), day(n).strftime("%A"), day(n).month, day(n).weekday() >= 5, names[n % 2])
            for n in range(days)
        ]
        return self.spark.createDataFrame(
            rows, "date_id int, full_date date, day_name string, month_number int, is_weekend boolean, season string"
        )

    def product(self, rows=None):
        rows = rows or [(f"P{n}", f"Product {n}", n, "SUP1", "12.00", "10.00", "8.00") for n in range(1, 9)]
        rows = [(*r[:4], *[None if v is None else Decimal(v) for v in r[4:]]) for r in rows]
        return self.spark.createDataFrame(
            rows,
            "product_id string, product_name string, category_id int, supplier_id string, mrp decimal(18,2), "
            "selling_price decimal(18,2), cost_price decimal(18,2)",
        )

    def category(self, n: int = 7):
        return self.spark.createDataFrame(
            [(i, f"Cat {i}") for i in range(1, n + 1)], "category_id int, category_name string"
        )

    def store(self):
        return self.spark.createDataFrame(
            [("S1", "Store 1", "Town", "East"), ("S2", "Store 2", "City", "West")],
            "store_id string, store_name string, city string, region string",
        )

    def supplier(self):
        return self.spark.createDataFrame(
            [("SUP1", "Supplier 1", "98", 6), ("SUP2", "Supplier 2", "99", None)],
            "supplier_id string, supplier_name string, contact_phone string, lead_time_days int",
        )

    def external(self, rows):
        """rows: (day, region, weather, temperature, rain, festival)"""
        data = [(100 + n, day(n), region, w, t, r, f, False, False) for n, region, w, t, r, f in rows]
        return self.spark.createDataFrame(
            data,
            "factor_id int, record_date date, region string, weather_type string, temperature_c double, "
            "rainfall_mm double, is_festival boolean, is_public_holiday boolean, is_marriage_season boolean",
        )

    def inventory(self, rows):
        """rows: (id, product, store, closing, reorder, safety, consumed, lead, cost, expires in days, stockout)"""
        data = [
            (i, p, s, 1, c, r, sf, r, u, lead, Decimal(cost), None if e is None else day(e), out)
            for i, p, s, c, r, sf, u, lead, cost, e, out in rows
        ]
        return self.spark.createDataFrame(
            data,
            "inventory_id string, product_id string, store_id string, date_id int, closing_stock int, "
            "reorder_level int, safety_stock int, reorder_point int, units_consumed int, lead_time_days int, "
            "unit_cost decimal(18,2), expiry_date date, is_stockout boolean",
        )


@pytest.fixture
def shop(spark):
    return Shop(spark)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, key):
    return {r[key]: r for r in rows(df)}
