"""One cleaning job per exported table: raw all-text rows in, typed rows and rejects out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks import schemas
from aisleworks.functions import clean as c
from aisleworks.sources.exports import MALFORMED

REASON = "reject_reason"

# --- fixed values: parent categories that exist before any export ------------
PARENT_CATEGORIES = [
    (32, "Grocery & Staples"),
    (33, "Snacks & Beverages"),
    (34, "Dairy & Beverages"),
    (35, "Home & Cleaning"),
    (36, "Personal Care"),
    (37, "Religious & Others"),
]
PARENT_CREATED = "2026-02-27 00:00:00"
CUSTOMER_TYPES = ["NEW", "REPEAT", "INACTIVE"]
CUSTOMER_PREFIX = "CUST"
# ----------------------------------------------------------------------------


@dataclass
class Cleaned:
    """Judged rows: the reason a row is left out (none for valid ones), its raw and its typed values.

    ``rows`` can be written once and read for both outcomes: ``over`` gives the same view of the written rows.
    """

    rows: DataFrame

    @property
    def valid(self) -> DataFrame:
        """Typed rows in table order."""
        return self.rows.where(F.col(REASON).isNull()).select("typed.*")

    @property
    def rejects(self) -> DataFrame:
        """The raw rows left out, with the reason."""
        return self.rows.where(F.col(REASON).isNotNull()).select("raw.*", REASON)

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.valid, self.rejects))

    def over(self, written: DataFrame) -> Cleaned:
        return Cleaned(written)


class _Raw:
    """Raw columns by name; an absent column reads as NULL."""

    def __init__(self, df: DataFrame):
        self._present = set(df.columns)

    def __getitem__(self, name: str) -> Column:
        if name not in self._present:
            return F.lit(None).cast("string")
        return F.col(name)


def _judge(rules: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Whether a row keeps every rule, and the first it breaks; an undecided (NULL) rule counts as broken."""
    keeps, reason = F.lit(True), F.lit(None).cast("string")
    for name, passes in reversed(rules):
        passes = F.coalesce(passes, F.lit(False))
        keeps, reason = passes & keeps, F.when(passes, reason).otherwise(F.lit(name))
    return keeps, reason


def _run(
    raw: DataFrame,
    table: str,
    rules: list[tuple[str, Column]],
    values: dict[str, Column],
    carry: list[str] | None,
) -> Cleaned:
    """``carry`` names raw columns, such as the ingest order, that valid rows take along."""
    if MALFORMED in raw.columns:
        rules = [("row does not have the header's fields", F.col(MALFORMED).isNull()), *rules]
    keeps, reason = _judge(rules)
    null = F.lit(None)
    typed = [
        values.get(field.name, null).cast(field.dataType).alias(field.name)
        for field in schemas.struct(table)
    ]
    return Cleaned(
        raw.select(
            F.when(~keeps, reason).alias(REASON),
            F.struct(*[F.col(f"`{name}`") for name in raw.columns]).alias("raw"),
            F.struct(*typed, *[F.col(name) for name in carry or []]).alias("typed"),
        )
    )


def _filled(text: Column) -> Column:
    return c.trimmed(text) != ""


def clean_brand(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    key = c.whole_int(r["brand_id"])
    return _run(raw, "brand", [("key is not a whole number", key.isNotNull())], {
        "brand_id": key,
        "brand_name": c.trimmed(r["brand_name"]),
        "brand_country": c.trimmed(r["brand_country"]),
        "is_active": c.true_false_or_null(r["is_active"]),
        "created_at": c.iso_timestamp(r["created_at"]),
    }, carry)


def clean_category(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    """Header case is ignored. Parents are not added here, see ``with_parent_categories``."""
    raw = raw.toDF(*[name.lower() for name in raw.columns])
    r = _Raw(raw)
    key, parent = c.whole_int(r["category_id"]), c.whole_int(r["parent_category_id"])
    rules = [
        ("key is not a whole number", key.isNotNull()),
        # A parent that is no number at all just means "none"; a fraction is an error.
        ("parent is a fraction", parent.isNotNull() | c.number(r["parent_category_id"]).isNull()),
    ]
    return _run(raw, "category", rules, {
        "category_id": key,
        "category_name": c.trimmed(r["category_name"]),
        "parent_category_id": parent,
        "is_active": c.flag(r["is_active"]),
        "created_at": c.iso_timestamp(r["created_at"]),
        "updated_at": c.iso_timestamp(r["updated_at"]),
    }, carry)


def with_parent_categories(children: DataFrame) -> DataFrame:
    """The fixed parents followed by the exported children; a parent wins its id."""
    spark = children.sparkSession
    created = F.lit(PARENT_CREATED).cast("timestamp_ntz")
    # Columns carried from the export have no value for a parent.
    carried = [f for f in children.schema if f.name not in schemas.columns("category")]
    parents = spark.createDataFrame(PARENT_CATEGORIES, "category_id int, category_name string").select(
        "category_id",
        "category_name",
        F.lit(None).cast("int").alias("parent_category_id"),
        F.lit(True).alias("is_active"),
        created.alias("created_at"),
        created.alias("updated_at"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in carried],
    )
    taken = [category_id for category_id, _ in PARENT_CATEGORIES]
    return parents.unionByName(children.where(~F.col("category_id").isin(taken)))


def clean_supplier(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    created = c.iso_timestamp(r["created_at"])
    return _run(raw, "supplier", [("key is blank", _filled(r["supplier_id"]))], {
        "supplier_id": c.trimmed(r["supplier_id"]),
        "supplier_name": c.trimmed(r["supplier_name"]),
        "contact_phone": c.phone(r["contact_phone"]),
        # The export labels these two the wrong way round.
        "city": c.trimmed(r["state"]),
        "state": c.trimmed(r["city"]),
        "lead_time_days": c.truncated_int(r["lead_time_days"]),
        "is_active": c.flag(r["is_active"]),
        "created_at": created,
        "updated_at": created,
    }, carry)


def clean_store(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    created = c.iso_timestamp(r["created_at"])
    texts = ["store_id", "store_name", "store_type", "city", "state", "region", "zone", "country"]
    return _run(raw, "store", [("key is blank", _filled(r["store_id"]))], {
        **{name: c.trimmed(r[name]) for name in texts},
        "is_active": c.flag(r["is_active"]),
        "created_at": created,
        "updated_at": created,
    }, carry)


def clean_customer(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    digits = F.replace(r["customer_id"], F.lit(CUSTOMER_PREFIX), F.lit(""))
    rules = [
        ("key is not a numbered customer", c.number(digits).isNotNull()),
        ("customer type is unknown", r["customer_type"].isin(CUSTOMER_TYPES)),
    ]
    return _run(raw, "customer", rules, {
        "customer_id": c.trimmed(r["customer_id"]),
        "phone_hash": c.trimmed(r["phone_hash"]),
        "customer_type": c.trimmed(r["customer_type"]),
        "first_transaction_date": c.iso_date(r["first_transaction_date"]),
        "is_active": c.flag_or_null(r["is_active"]),
        "created_at": c.iso_timestamp(r["created_at"]),
    }, carry)


def clean_date(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    date_id, full_date, day = c.whole_int(r["date_id"]), c.iso_date(r["full_date"]), c.whole_int(r["day"])
    rules = [
        ("full_date is not a date", full_date.isNotNull()),
        ("date_id is not a whole number", date_id.isNotNull()),
        ("day is a fraction", day.isNotNull() | c.number(r["day"]).isNull()),
    ]
    return _run(raw, "date", rules, {
        "date_id": date_id,
        "full_date": full_date,
        "day": day,
        **{name: c.rounded_int(r[name]) for name in ["month_number", "quarter", "year", "week_number"]},
        **{name: c.flag(r[name]) for name in ["is_weekend", "is_month_start", "is_month_end"]},
        **{name: c.trimmed(r[name]) for name in ["season", "day_name", "month_name"]},
    }, carry)


def clean_festival(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    texts = [
        "festival_id", "event_id", "event_name", "festival_name", "religion", "state", "region",
        "demand_level", "demand_category",
    ]
    return _run(raw, "festival", [("key is not a festival id", r["festival_id"].rlike(c.FESTIVAL_KEY))], {
        **{name: c.trimmed(r[name]) for name in texts},
        **{name: c.truncated_int(r[name]) for name in ["religion_id", "festival_period_days"]},
        **{name: c.iso_date(r[name]) for name in ["festival_start_date", "festival_end_date"]},
        **{name: c.flag(r[name]) for name in ["is_national_holiday", "historically_consistent_uplift"]},
        **{name: c.iso_timestamp(r[name]) for name in ["created_at", "updated_at"]},
        "expected_demand_multiplier": c.number(r["expected_demand_multiplier"]),
    }, carry)


def festival_products(raw: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The festival export's two comma lists as ranked (festival, product) rows."""
    r = _Raw(raw)
    ids, names = c.list_items(r["top_product_ids"]), c.list_items(r["top_product_names"])
    whole = raw.where(F.col(MALFORMED).isNull()) if MALFORMED in raw.columns else raw
    lists = whole.where(r["festival_id"].rlike(c.FESTIVAL_KEY)).select(
        F.trim("festival_id").alias("festival_id"), ids.alias("left"), names.alias("right"), *(carry or [])
    )
    pairs = lists.select("festival_id", *(carry or []), F.posexplode(c.paired(F.col("left"), F.col("right"))).alias("pos", "pair"))
    return pairs.select(
        "festival_id",
        F.col("pair.left").alias("product_id"),
        F.col("pair.right").alias("product_name"),
        (F.col("pos") + 1).alias("rank"),
        *(carry or []),
    )


def clean_external_factors(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    created, key = c.iso_timestamp(r["created_at"]), c.truncated_int(r["date_id"])
    flags = [
        "is_school_holiday", "is_school_reopening", "is_festival", "is_weekend", "is_public_holiday",
        "is_marriage_season", "is_harvest_season", "is_exam_season",
    ]
    return _run(raw, "external_factors", [("key is not a number", key.isNotNull())], {
        "factor_id": key,
        "record_date": c.iso_date(r["full_date"]),
        **{name: c.trimmed(r[name]) for name in ["region", "weather_type"]},
        **{name: c.number(r[name]) for name in ["temperature_c", "rainfall_mm", "humidity_pct"]},
        **{name: c.flag(r[name]) for name in flags},
        "created_at": created,
        "updated_at": created,
    }, carry)


def clean_product(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    code = c.barcode(r["barcode"])
    rules = [
        ("key is blank", _filled(r["product_id"])),
        ("barcode is not a number", code.isNotNull() | c.na_to_null(r["barcode"]).isNull()),
    ]
    texts = ["product_id", "sku_code", "product_name", "pack_size_unit", "supplier_id"]
    return _run(raw, "product", rules, {
        **{name: c.trimmed(r[name]) for name in texts},
        "barcode": code,
        **{name: c.strict_int(r[name]) for name in ["category_id", "brand_id"]},
        **{name: c.price(r[name]) for name in ["mrp", "cost_price", "selling_price"]},
        **{name: c.number(r[name]) for name in ["pack_size_value", "tax_rate_pct"]},
        **{name: c.day_first_date(r[name]) for name in ["manufacturing_date", "expiry_date"]},
        **{name: c.day_first_timestamp(r[name]) for name in ["created_at", "updated_at"]},
        "is_active": c.flag(r["is_active"]),
    }, carry)


def _no_footer(key: Column) -> list[tuple[str, Column]]:
    return [
        ("key is missing", c.na_to_null(key).isNotNull()),
        ("row is a legend", ~key.rlike(c.FOOTER_KEY)),
    ]


def clean_inventory(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    created = c.iso_timestamp(r["created_at"])
    integers = [
        "date_id", "opening_stock", "closing_stock", "units_consumed", "safety_stock", "reorder_level",
        "reorder_point", "lead_time_days", "shrinkage_units",
    ]
    return _run(raw, "inventory", _no_footer(r["inventory_id"]), {
        "inventory_id": c.trimmed(r["inventory_id"]),
        # Loaded as exported, without trimming.
        **{name: c.na_to_null(r[name]) for name in ["batch_number", "product_id", "store_id"]},
        **{name: c.int_or_zero(r[name]) for name in integers},
        "unit_cost": c.price(r["unit_cost"]),
        "expiry_date": c.iso_date(r["expiry_date"]),
        "is_stockout": c.flag(r["is_stockout"]),
        "created_at": created,
        "updated_at": created,
    }, carry)


def clean_transaction(raw: DataFrame, carry: list[str] | None = None) -> Cleaned:
    r = _Raw(raw)
    created = c.iso_timestamp(r["created_at"])
    amounts = ["mrp_per_unit", "unit_selling_price", "discount_amount", "tax_amount", "final_sale_value"]
    texts = [
        "transaction_id", "invoice_number", "store_id", "product_id", "payment_mode", "transaction_status",
    ]
    rules = _no_footer(r["transaction_id"]) + [
        (f"{name} is malformed", c.money(r[name]).isNotNull()) for name in amounts
    ]
    return _run(raw, "transaction", rules, {
        **{name: c.trimmed(r[name]) for name in texts},
        **{name: c.int_or_zero(r[name]) for name in ["date_id", "quantity_sold"]},
        **{name: c.money(r[name]) for name in amounts},
        "customer_id": c.na_to_null(r["customer_id"]),
        "is_return": c.flag(r["is_return"]),
        "created_at": created,
        "updated_at": created,
    }, carry)


JOBS = {
    "brand": clean_brand,
    "category": clean_category,
    "supplier": clean_supplier,
    "store": clean_store,
    "customer": clean_customer,
    "date": clean_date,
    "festival": clean_festival,
    "external_factors": clean_external_factors,
    "product": clean_product,
    "inventory": clean_inventory,
    "transaction": clean_transaction,
}
