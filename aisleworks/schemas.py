"""Clean table schemas of the star schema, with the key each table merges on."""

from __future__ import annotations

from pyspark.sql import types as T

BRAND = "brand_id int, brand_name string, brand_country string, is_active boolean, created_at timestamp_ntz"

CATEGORY = (
    "category_id int, category_name string, parent_category_id int, is_active boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)

SUPPLIER = (
    "supplier_id string, supplier_name string, contact_phone string, contact_email string, city string, "
    "state string, lead_time_days int, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
)

STORE = (
    "store_id string, store_name string, store_code string, store_type string, address string, city string, "
    "state string, pincode string, region string, zone string, country string, is_active boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)

CUSTOMER = (
    "customer_id string, phone_hash string, customer_type string, first_transaction_date date, "
    "is_active boolean, created_at timestamp_ntz"
)

DATE = (
    "date_id int, full_date date, day int, day_name string, month_number int, month_name string, quarter int, "
    "year int, week_number int, is_weekend boolean, is_month_start boolean, is_month_end boolean, season string"
)

FESTIVAL = (
    "festival_id string, event_id string, event_name string, festival_name string, religion_id int, "
    "religion string, state string, region string, festival_start_date date, festival_end_date date, "
    "festival_period_days int, is_national_holiday boolean, historically_consistent_uplift boolean, "
    "demand_level string, demand_category string, expected_demand_multiplier double, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)

FESTIVAL_PRODUCTS = "festival_id string, product_id string, product_name string, rank int"

EXTERNAL_FACTORS = (
    "factor_id int, record_date date, region string, temperature_c double, rainfall_mm double, "
    "humidity_pct double, weather_type string, is_school_holiday boolean, is_school_reopening boolean, "
    "is_festival boolean, is_weekend boolean, is_public_holiday boolean, is_marriage_season boolean, "
    "is_harvest_season boolean, is_exam_season boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
)

PRODUCT = (
    "product_id string, sku_code string, barcode string, product_name string, category_id int, brand_id int, "
    "supplier_id string, pack_size_value double, pack_size_unit string, mrp decimal(18,2), "
    "cost_price decimal(18,2), selling_price decimal(18,2), tax_rate_pct double, manufacturing_date date, "
    "expiry_date date, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
)

INVENTORY = (
    "inventory_id string, batch_number string, product_id string, store_id string, date_id int, "
    "opening_stock int, closing_stock int, units_consumed int, safety_stock int, reorder_level int, "
    "reorder_point int, lead_time_days int, shrinkage_units int, unit_cost decimal(18,2), expiry_date date, "
    "is_stockout boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
)

TRANSACTION = (
    "transaction_id string, invoice_number string, date_id int, store_id string, customer_id string, "
    "product_id string, quantity_sold int, mrp_per_unit decimal(18,2), unit_selling_price decimal(18,2), "
    "discount_amount decimal(18,2), tax_amount decimal(18,2), final_sale_value decimal(18,2), "
    "payment_mode string, transaction_status string, is_return boolean, created_at timestamp_ntz, "
    "updated_at timestamp_ntz"
)

SCHEMAS: dict[str, str] = {
    "brand": BRAND,
    "category": CATEGORY,
    "supplier": SUPPLIER,
    "store": STORE,
    "customer": CUSTOMER,
    "date": DATE,
    "festival": FESTIVAL,
    "festival_products": FESTIVAL_PRODUCTS,
    "external_factors": EXTERNAL_FACTORS,
    "product": PRODUCT,
    "inventory": INVENTORY,
    "transaction": TRANSACTION,
}

KEYS: dict[str, list[str]] = {
    "brand": ["brand_id"],
    "category": ["category_id"],
    "supplier": ["supplier_id"],
    "store": ["store_id"],
    "customer": ["customer_id"],
    "date": ["full_date"],
    "festival": ["festival_id"],
    "festival_products": ["festival_id", "product_id"],
    "external_factors": ["factor_id"],
    "product": ["product_id"],
    "inventory": ["inventory_id"],
    "transaction": ["transaction_id"],
}

#: Tables whose existing rows a new batch overwrites, and the columns it may not touch.
OVERWRITTEN: dict[str, list[str]] = {"date": ["date_id"], "transaction": ["created_at"]}

#: Folder column of tables whose files are dealt to folders, and the expression that gives it.
PARTITIONED: dict[str, tuple[str, str]] = {"transaction": ("sale_month", "CAST(FLOOR(date_id / 100) AS INT)")}


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def columns(table: str) -> list[str]:
    return struct(table).fieldNames()
