"""Helper SQL: the retail roles and rounding rules in DuckDB."""

from __future__ import annotations

import re

from driverbind.roles import AS_OF, FESTIVAL_AS_OF, STOCK_AS_OF  # noqa: F401  (used by the queries)


def half_up(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def half_even(x: str, n: int) -> str:
    """Exact half-even: C formatting of the double."""
    return f"CAST(printf('%.{n}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def grouped(x: str) -> str:
    return f"format('{{:,}}', CAST({half_even(x, 0)} AS BIGINT))"


ROLES: dict[str, str] = {
    "date_dim": """
        SELECT year(d)*10000 + month(d)*100 + day(d) AS date_id, d AS full_date, dayname(d) AS day_name,
               month(d) AS month_number, isodow(d) >= 6 AS is_weekend,
               CASE WHEN month(d) IN (12,1,2) THEN 'Winter' WHEN month(d) BETWEEN 3 AND 5 THEN 'Summer'
                    WHEN month(d) BETWEEN 6 AND 9 THEN 'Monsoon' ELSE 'Autumn' END AS season
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "ext": """
        SELECT date_id AS factor_id, full_date AS record_date, r_name AS region,
               15.0::DOUBLE + month(full_date) AS temperature_c,
               CASE WHEN month(full_date) BETWEEN 6 AND 9 THEN CAST(day(full_date) % 7 AS DOUBLE) ELSE 0.0::DOUBLE END AS rainfall_mm,
               ['Sunny','Cloudy','Rainy','Foggy'][month(full_date) % 4 + 1] AS weather_type,
               day(full_date) % 9 = 0 AS is_festival, day(full_date) % 15 = 0 AS is_public_holiday,
               month(full_date) IN (2,5,11,12) AS is_marriage_season
        FROM date_dim JOIN region ON r_regionkey = day(full_date) % 5
        WHERE day(full_date) % 10 <> 0""",
    "product_dim": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_id,
               p_partkey % (SELECT COUNT(*) FROM supplier) AS supplier_id,
               retail AS mrp, CAST(ROUND(retail * 0.95, 2) AS DECIMAL(18,2)) AS selling_price,
               CAST(ROUND(CAST(retail * CAST(80 + p_partkey % 30 AS DECIMAL(4,0)) AS DECIMAL(28,4)) * 0.01, 2) AS DECIMAL(18,2)) AS cost_price
        FROM (SELECT *, CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS retail FROM part)""",
    "category_dim": "SELECT DISTINCT p_type AS category_id, p_type AS category_name FROM part",
    "store_dim": """
        SELECT n_nationkey AS store_id, n_name AS store_name, r_name AS city, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "customer_dim": """
        SELECT c_custkey AS customer_id,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'NEW' WHEN 'FURNITURE' THEN 'REPEAT'
                    WHEN 'BUILDING' THEN 'INACTIVE' ELSE c_mktsegment END AS customer_type
        FROM customer""",
    "supplier_dim": """
        SELECT s_suppkey AS supplier_id, s_name AS supplier_name,
               '98' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS contact_phone,
               CAST(5 + s_suppkey % 8 AS INTEGER) AS lead_time_days
        FROM supplier""",
    "tx": """
        SELECT l_orderkey || '-' || l_linenumber AS transaction_id,
               year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate) AS date_id,
               s_nationkey AS store_id, o_custkey AS customer_id, l_partkey AS product_id,
               CAST(l_quantity AS INTEGER) AS quantity_sold,
               CAST(ROUND(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS final_sale_value,
               o_orderpriority AS payment_mode,
               CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE o_orderstatus END AS transaction_status,
               l_returnflag = 'R' AS is_return
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "sale": "SELECT * FROM tx WHERE is_return = FALSE AND transaction_status = 'Completed'",
    "inv": f"""
        SELECT p_partkey || '-' || n AS inventory_id, p_partkey AS product_id, n AS store_id, 20010802 AS date_id,
               CAST((p_partkey*7 + n*13) % 120 AS INTEGER) AS closing_stock,
               CAST(40 + p_size AS INTEGER) AS reorder_level, CAST(30 + p_size AS INTEGER) AS reorder_point,
               CAST(10 + p_size % 20 AS INTEGER) AS safety_stock, CAST((p_partkey + n) % 9 AS INTEGER) AS units_consumed,
               CASE WHEN p_partkey % 5 <> 0 THEN CAST(3 + p_partkey % 10 AS INTEGER) END AS lead_time_days,
               CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,4)) * 0.8, 2) AS DECIMAL(18,2)) AS unit_cost,
               CASE WHEN p_partkey % 11 <> 0
                    THEN DATE '{STOCK_AS_OF}' + CAST((p_partkey*3 + n*5) % 120 - 10 AS INTEGER) END AS expiry_date,
               p_partkey % 97 = 0 AS is_stockout
        FROM (SELECT DISTINCT l_partkey, s_nationkey AS n FROM lineitem, supplier WHERE l_suppkey = s_suppkey)
        JOIN part ON p_partkey = l_partkey""",
    "fest": """
        SELECT k, 'FES' || lpad(CAST(k AS VARCHAR), 3, '0') AS festival_id, 'Festival ' || k AS festival_name,
               ['North','South','East'][k % 3 + 1] AS religion,
               CAST(m + 14 AS DATE) AS festival_start_date, CAST(m + CAST(k % 3 + 14 AS INTEGER) AS DATE) AS festival_end_date,
               k % 3 + 1 AS festival_period_days, k % 4 = 0 AS is_national_holiday,
               k % 2 = 0 AS historically_consistent_uplift,
               CASE WHEN k % 2 = 0 THEN 'High' ELSE 'Medium' END AS demand_level,
               1.0::DOUBLE + (k % 5) * 0.25::DOUBLE AS expected_demand_multiplier
        FROM (SELECT m, CAST(row_number() OVER (ORDER BY m) AS INTEGER) AS k
              FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders))""",
    "fest_prod": """
        SELECT festival_id, (k*7 + r) % (SELECT COUNT(*) FROM part) AS product_id, r AS rank
        FROM fest, (SELECT unnest([1,2,3]) AS r)""",
    "fc": """
        SELECT product_id, store_id, SUM(quantity_sold) * 7.0::DOUBLE / (COUNT(*) * 10) AS forecast_7d_qty
        FROM tx GROUP BY product_id, store_id""",
}


def with_roles(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefixes the roles (and ``extra`` CTEs) that ``sql`` needs, in dependency order."""
    known = {**ROLES, **(extra or {})}
    order = list(known)

    def uses(text: str) -> set[str]:
        return {name for name in order if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*\()", text, re.I)}

    needed, todo = set(), uses(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= uses(known[name]) - {name}
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in order if name in needed)
    return f"WITH {ctes}\n{sql.strip()}" if ctes else sql.strip()
