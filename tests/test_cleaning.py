import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aisleworks.functions import clean as c
from aisleworks.operators import cleaning
from tests.conftest import by, rows

CASES = [
    (c.number, {"5": 5.0, " 1e2 ": 100.0, ".5": 0.5, "5d": None, "0x1p3": None, "Infinity": None, "NaN": None, "": None}),
    (c.whole_int, {"5": 5, "5.0": 5, "5.5": None, "x": None, None: None}),
    (c.int_or_zero, {"3.7": 3, "-3.7": -3, "abc": 0, "": 0, None: 0}),
    (c.strict_int, {"5": 5, " 5 ": 5, "5.0": None, "3.7": None, "abc": None}),
    (c.rounded_int, {"1.5": 2, "2.5": 2, "3.49": 3, "x": None}),
    (c.truncated_int, {"7.9": 7, "x": None}),
    (c.money, {"0.125": Decimal("0.12"), "0.135": Decimal("0.14"), "1e2": Decimal("100.00"), "": Decimal("0.00"),
               None: Decimal("0.00"), "abc": None, "-0.005": Decimal("0.00")}),
    (c.flag, {"TRUE": True, " yes ": True, "1": True, "0": False, "maybe": False, None: False}),
    (c.true_false_or_null, {"true": True, "FALSE": False, "1": None, None: None}),
    (c.flag_or_null, {"1": True, "No": False, "maybe": None, "NaN": None}),
    (c.iso_date, {"2025-02-03": dt.date(2025, 2, 3), "2025-02-03 04:05:06": dt.date(2025, 2, 3), "2025-13-40": None,
                  "03-02-2025": None}),
    (c.day_first_date, {"05-02-2025": dt.date(2025, 2, 5), "2025-02-05": None, "45-01-2026": None}),
    (c.day_first_timestamp, {"05-02-2025 10:30": dt.datetime(2025, 2, 5, 10, 30), "05-02-2025": None}),
    (c.barcode, {"6.94802E+12": "6948020000000", "12.9": "12", "code": None, None: None}),
    (c.phone, {"98765.0": "98765", " 98 ": "98"}),
    (c.trimmed, {" a ": "a", "nan": None, "NULL": None, None: None}),
]


@pytest.mark.parametrize("rule,cases", CASES, ids=[rule.__name__ for rule, _ in CASES])
def test_column_cleaner(spark, rule, cases):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(rule(F.col("x"))).collect()]
    assert got == list(cases.values())


def test_lists_pair_to_the_shorter(spark):
    df = spark.createDataFrame(
        [("FES1", "A1, B2 ,C3", "Ata, Besan"), ("FES2", "A1,,B2, ", "Ata,Besan,Chai"), ("FES3", None, "Ata"),
         (" FES4", "A1", "Ata"), ("Legend", "A1", "Ata")],
        "festival_id string, top_product_ids string, top_product_names string",
    )
    got = sorted((r["festival_id"], r["rank"], r["product_id"], r["product_name"])
                 for r in rows(cleaning.festival_products(df)))
    assert got == [("FES1", 1, "A1", "Ata"), ("FES1", 2, "B2", "Besan"),
                   ("FES2", 1, "A1", "Ata"), ("FES2", 2, "B2", "Besan")]


def test_transaction_rejects_and_defaults(spark):
    raw = spark.createDataFrame(
        [("T1 ", "5.9", "10.125", "CUST1", None), ("PK: x", "1", "1", "", "UPI"), (None, "1", "1", "", "UPI"),
         ("T2", "1", "abc", "", "UPI"), ("T3", None, None, "nan", " UPI ")],
        "transaction_id string, quantity_sold string, final_sale_value string, customer_id string, payment_mode string",
    )
    valid, rejects = cleaning.clean_transaction(raw)
    good = by(valid, "transaction_id")
    assert set(good) == {"T1", "T3"}
    assert (good["T1"]["quantity_sold"], good["T1"]["final_sale_value"]) == (5, Decimal("10.12"))
    assert (good["T3"]["quantity_sold"], good["T3"]["final_sale_value"]) == (0, Decimal("0.00"))
    assert good["T3"]["customer_id"] is None and good["T3"]["payment_mode"] == "UPI"
    assert good["T1"]["payment_mode"] is None and good["T1"]["is_return"] is False
    assert sorted(r["reject_reason"] for r in rows(rejects)) == [
        "final_sale_value is malformed", "key is missing", "row is a legend"]


def test_every_row_is_either_valid_or_rejected(spark):
    raw = spark.createDataFrame(
        [("CUST1", "NEW"), ("CUST2", " NEW"), ("CUSTx", "NEW"), (None, "VIP"), ("CUST5", None)],
        "customer_id string, customer_type string",
    )
    valid, rejects = cleaning.clean_customer(raw)
    assert valid.count() == 1 and rejects.count() == 4


def test_parents_come_first_and_win(spark):
    raw = spark.createDataFrame(
        [("1", "Tea", "33"), ("32", "Other", None), ("2", "Soap", "35.5")],
        "Category_ID string, CATEGORY_NAME string, parent_category_id string",
    )
    valid, rejects = cleaning.clean_category(raw)
    names = {r["category_id"]: r["category_name"] for r in rows(cleaning.with_parent_categories(valid))}
    assert names[1] == "Tea" and names[32] == "Grocery & Staples" and len(names) == 7
    assert [r["reject_reason"] for r in rows(rejects)] == ["parent is a fraction"]


def test_supplier_city_and_state_swap(spark):
    raw = spark.createDataFrame([("S1", "Odisha", "Cuttack", "987.0")],
                                "supplier_id string, city string, state string, contact_phone string")
    row = rows(cleaning.clean_supplier(raw).valid)[0]
    assert (row["city"], row["state"], row["contact_phone"]) == ("Cuttack", "Odisha", "987")
