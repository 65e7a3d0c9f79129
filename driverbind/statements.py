"""DuckDB SQL for every query that SQL can state, over the driver's views."""

from __future__ import annotations

from driverbind.exports import EXPORTS, RAGGED_LINE, export_sql
from driverbind.oracle import grouped, half_even, half_up, with_roles
from driverbind.roles import AS_OF, FESTIVAL_AS_OF, STOCK_AS_OF

STATEMENTS: dict[str, str] = {}

EXTRA: dict[str, str] = {}


def statement(name: str, sql: str) -> None:
    STATEMENTS[name] = with_roles(sql, EXTRA)


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def mean(total: str, n: str) -> str:
    return f"({dbl(total)} / NULLIF({n}, 0))"


# --- analytics ------------------------------------------------------------


def _recent(days: int) -> str:
    return f"""
        SELECT s.*, d.full_date FROM sale s JOIN date_dim d ON s.date_id = d.date_id
        WHERE d.full_date >= CAST((SELECT MAX(d2.full_date) FROM sale s2 JOIN date_dim d2 ON s2.date_id = d2.date_id)
                                  - INTERVAL {days} DAY AS DATE)"""


EXTRA["recent30"] = _recent(30)
EXTRA["recent31"] = _recent(31)
for _days in (30, 31):
    EXTRA[f"cat_daily{_days}"] = f"""
        SELECT c.category_name AS name, r.full_date, SUM(r.final_sale_value) AS rev, SUM(r.quantity_sold) AS units
        FROM recent{_days} r JOIN product_dim p ON r.product_id = p.product_id
        JOIN category_dim c ON p.category_id = c.category_id GROUP BY ALL"""
EXTRA["store_daily"] = """
    SELECT s.store_name AS name, r.full_date, SUM(r.final_sale_value) AS rev
    FROM recent30 r JOIN store_dim s ON r.store_id = s.store_id GROUP BY ALL"""


def _trend(daily: str, more: str = "") -> str:
    ld = f"(SELECT MAX(full_date) FROM {daily})"
    this, before = f"full_date > {ld} - 7", f"full_date <= {ld} - 7 AND full_date > {ld} - 14"
    avg = lambda c: mean(f"SUM(rev) FILTER ({c})", f"COUNT(*) FILTER ({c})")
    return f"""
        SELECT *, COALESCE({half_up("(last_avg - prev_avg) / GREATEST(prev_avg, 1.0::DOUBLE) * 100", 2)}, 0.0) AS change_pct
        FROM (SELECT name, {avg(this)} AS last_avg, {avg(before)} AS prev_avg {more} FROM {daily} GROUP BY name)"""


EXTRA["cat_trend"] = _trend("cat_daily30", ", SUM(rev) AS total_rev, SUM(units) AS total_units")
EXTRA["store_trend"] = _trend("store_daily")
LABEL = """CASE WHEN change_pct >= 25 THEN 'SPIKE' WHEN change_pct >= 10 THEN 'RISING'
    WHEN change_pct >= -10 THEN 'STABLE' WHEN change_pct >= -25 THEN 'FALLING' ELSE 'CRASH' END"""

TREND_OF_CATEGORY = f"""
    SELECT name AS category_name, {half_up("last_avg", 2)} AS last_7d_avg_revenue,
           {half_up("prev_avg", 2)} AS prev_7d_avg_revenue, change_pct, {LABEL} AS trend_label,
           {dbl("total_rev")} AS total_30d_revenue, CAST(total_units AS BIGINT) AS total_30d_units,
           CASE WHEN change_pct >= 10 THEN 'Increase stock. Check for upcoming festivals.'
                WHEN change_pct >= -10 THEN 'No immediate action needed.'
                ELSE 'Review pricing. Check competitor activity.' END AS recommended_action
    FROM cat_trend"""

TREND_OF_STORE = f"""
    SELECT name AS store_name, {half_up("last_avg", 2)} AS last_7d_avg, {half_up("prev_avg", 2)} AS prev_7d_avg,
           change_pct, {LABEL} AS trend_label FROM store_trend"""
statement("category_trends_in_order", f"""
    SELECT *, row_number() OVER (ORDER BY change_pct DESC NULLS FIRST, category_name NULLS LAST) AS position
    FROM ({TREND_OF_CATEGORY})""")
for _name in ("", "_kept"):
    statement(f"category_trends{_name}", TREND_OF_CATEGORY)
    statement(f"store_trends{_name}", TREND_OF_STORE)

EXTRA["unit_stats"] = f"""
    SELECT name, {mean("SUM(units)", "COUNT(units)")} AS m, STDDEV_SAMP(CAST(units AS DOUBLE)) AS sd,
           CAST(MAX(CASE WHEN full_date = (SELECT MAX(full_date) FROM cat_daily31) THEN units END) AS BIGINT) AS latest
    FROM cat_daily31 GROUP BY name"""
STATS = f"""name AS category_name, {half_up("m", 2)} AS mean_units, {half_up("sd", 2)} AS stddev_units,
    {dbl("latest")} AS latest_units"""

statement("demand_spikes", f"""
    SELECT category_name, mean_units, stddev_units, latest_units, z_score,
           CASE WHEN z_score > 1.0 THEN 'SPIKE' ELSE 'DROP' END AS status,
           CASE WHEN z_score > 1.0 THEN 'Check festival calendar. Consider emergency restock.'
                ELSE 'Investigate cause. Check stockouts or competitor pricing.' END AS recommended_action
    FROM (SELECT {STATS}, COALESCE({half_up("(latest - m) / GREATEST(sd, 0.01::DOUBLE)", 2)}, 0.0) AS z_score
          FROM unit_stats)
    WHERE z_score > 1.0 OR z_score < -1.0""")

statement("category_demand_status", f"""
    SELECT *, CASE WHEN z_score > 2.0 THEN 'SPIKE' WHEN z_score < -2.0 THEN 'DROP' ELSE 'NORMAL' END AS status
    FROM (SELECT *, {half_even("(COALESCE(latest_units, 0.0) - COALESCE(mean_units, 0.0)) / GREATEST(CASE WHEN stddev_units IS NULL OR stddev_units = 0 THEN 0.01::DOUBLE ELSE stddev_units END, 0.01::DOUBLE)", 2)} AS z_score
          FROM (SELECT {STATS} FROM unit_stats))""")

# Sales are summed per day first; a day then counts once for each of its weather rows.
EXTRA["per_day"] = """
    SELECT full_date, COUNT(*) AS n, SUM(final_sale_value) AS money
    FROM sale SEMI JOIN date_dim USING (date_id) JOIN (SELECT date_id, full_date FROM date_dim) USING (date_id)
    GROUP BY full_date"""
EXTRA["day_weather"] = """
    SELECT per_day.*, weather_type, temperature_c, rainfall_mm, is_festival
    FROM per_day LEFT JOIN ext ON record_date = full_date"""

statement("weather_demand", f"""
    SELECT ifnull(weather_type, 'No External Data') AS weather_type, COUNT(DISTINCT full_date) AS days_count,
           CAST(SUM(n) AS BIGINT) AS total_transactions, {half_up(f'{dbl("SUM(money)")} / SUM(n)', 2)} AS avg_basket,
           {dbl("SUM(money)")} AS total_revenue,
           {half_up("SUM(temperature_c * n) / SUM(n) FILTER (temperature_c IS NOT NULL)", 1)} AS avg_temp_c,
           {half_up("SUM(rainfall_mm * n) / SUM(n) FILTER (rainfall_mm IS NOT NULL)", 2)} AS avg_rainfall_mm
    FROM day_weather GROUP BY ifnull(weather_type, 'No External Data')""")

statement("upcoming_festivals", f"""
    SELECT festival_id, festival_name, religion, CAST(festival_start_date AS VARCHAR) AS festival_start_date,
           CAST(festival_end_date AS VARCHAR) AS festival_end_date, festival_period_days, is_national_holiday,
           historically_consistent_uplift, demand_level, expected_demand_multiplier,
           CAST(festival_start_date - DATE '{FESTIVAL_AS_OF}' AS INTEGER) AS days_until
    FROM fest WHERE festival_start_date BETWEEN DATE '{FESTIVAL_AS_OF}' AND DATE '{FESTIVAL_AS_OF}' + 60""")

EXTRA["stock_means"] = f"""
    SELECT product_id, {half_up("AVG(closing_stock)", 0)} AS avg_closing_stock,
           {half_up("AVG(safety_stock)", 0)} AS avg_safety_stock FROM inv GROUP BY product_id"""
EXTRA["units_lately"] = f"""
    SELECT product_id, {dbl("SUM(quantity_sold)")} / COUNT(DISTINCT date_id) AS per_day
    FROM sale WHERE date_id IN (SELECT date_id FROM date_dim WHERE full_date + 30 >= DATE '{AS_OF}') GROUP BY product_id"""
statement("festival_product_recs", f"""
    SELECT festival_id, rank, product_id, product_name, category_id AS category_name, {dbl("mrp")} AS mrp,
           {dbl("selling_price")} AS selling_price, avg_closing_stock, avg_safety_stock, daily_avg_units, extra AS recommended_extra_stock,
           if(ifnull(avg_closing_stock, 0) < extra, 'Low stock — order urgently', 'Stock sufficient') AS stock_note
    FROM (SELECT *, {half_up("ifnull(per_day, 0)", 2)} AS daily_avg_units,
                 {half_even(f'{half_up("ifnull(per_day, 0)", 2)} * 2', 0)} AS extra
          FROM fest_prod JOIN product_dim USING (product_id)
          LEFT JOIN stock_means USING (product_id) LEFT JOIN units_lately USING (product_id))""")

EXTRA["fest_days"] = f"""
    SELECT is_festival, COUNT(DISTINCT full_date) AS days_count, SUM(money) AS rev,
           {half_up(f'{dbl("SUM(money)")} / COUNT(DISTINCT full_date)', 2)} AS avg_daily_revenue,
           CAST(SUM(n) AS BIGINT) AS total_transactions
    FROM day_weather GROUP BY is_festival"""

statement("festival_day_revenue", f"""
    SELECT CASE WHEN is_festival THEN 'Festival Day' WHEN NOT is_festival THEN 'Normal Day'
                ELSE 'No External Data' END AS day_type,
           is_festival, days_count, {dbl("rev")} AS total_revenue, avg_daily_revenue, total_transactions
    FROM fest_days""")

statement("festival_uplift", f"""
    SELECT {half_even("(f - n) / GREATEST(n, 1.0::DOUBLE) * 100", 2)} AS festival_uplift_pct,
           f AS festival_avg_daily, n AS normal_avg_daily
    FROM (SELECT COALESCE(MAX(avg_daily_revenue) FILTER (is_festival), 0.0) AS f,
                 COALESCE(MAX(avg_daily_revenue) FILTER (NOT is_festival), 0.0) AS n FROM fest_days)""")

# Money per store and category, then shares and places by comparing those few rows with each other.
EXTRA["store_money"] = """
    SELECT store_id, category_id, SUM(final_sale_value) AS money
    FROM sale JOIN product_dim USING (product_id) GROUP BY store_id, category_id"""
statement("store_category_preferences", f"""
    SELECT store_name, city, m.store_id, m.category_id AS category_name, {dbl("m.money")} AS category_revenue,
           {half_up(f'{dbl("m.money")} / (SELECT {dbl("SUM(a.money)")} FROM store_money a WHERE a.store_id = m.store_id) * 100', 2)}
               AS revenue_share_pct,
           (SELECT COUNT(*) + 1 FROM store_money b WHERE b.store_id = m.store_id AND b.money > m.money) AS rank
    FROM store_money m JOIN store_dim USING (store_id)
    WHERE (SELECT COUNT(*) FROM store_money b WHERE b.store_id = m.store_id AND b.money > m.money) < 5""")

EXTRA["season_money"] = """
    SELECT season, category_id, SUM(units) AS units, SUM(money) AS money
    FROM (SELECT date_id, category_id, SUM(quantity_sold) AS units, SUM(final_sale_value) AS money
          FROM sale JOIN product_dim USING (product_id) GROUP BY ALL)
    JOIN date_dim USING (date_id) GROUP BY ALL"""
statement("seasonal_category_mix", f"""
    SELECT season, m.category_id AS category_name, CAST(m.units AS BIGINT) AS total_units, {dbl("m.money")} AS total_revenue,
           1 + len(list_filter(list(m2.money), lambda x: x > m.money)) AS rank_in_season
    FROM season_money m JOIN season_money m2 USING (season) GROUP BY season, m.category_id, m.units, m.money""")

EXTRA["paid"] = """
    SELECT store_id, payment_mode, COUNT(*) AS txn_count FROM sale WHERE payment_mode IS NOT NULL GROUP BY ALL"""
EXTRA["paid_whole"] = "SELECT store_id, SUM(txn_count) AS n FROM paid GROUP BY store_id"
statement("payment_preference", f"""
    SELECT store_name, store_id, payment_mode, txn_count, {half_up("txn_count * 100.0::DOUBLE / n", 2)} AS pct
    FROM paid JOIN paid_whole USING (store_id) JOIN store_dim USING (store_id)""")

EXTRA["shoppers"] = """
    SELECT store_id, customer_id, COUNT(*) AS visits, SUM(final_sale_value) AS spend FROM sale GROUP BY ALL"""
statement("customer_type_breakdown", f"""
    SELECT store_name, store_id, customer_type, COUNT(*) AS unique_customers, CAST(SUM(visits) AS BIGINT) AS total_transactions,
           {dbl("SUM(spend)")} AS total_spend, {half_up(f'{dbl("SUM(spend)")} / SUM(visits)', 2)} AS avg_basket
    FROM shoppers JOIN customer_dim USING (customer_id) JOIN store_dim USING (store_id)
    WHERE customer_type NOT IN ('AUTOMOBILE', 'HOUSEHOLD') GROUP BY store_name, store_id, customer_type""")

statement("orphan_sales", """
    SELECT 'date_id' AS missing_key, COUNT(*) AS orphan_sales FROM sale
    WHERE date_id NOT IN (SELECT date_id FROM date_dim WHERE NOT is_weekend)
    UNION ALL SELECT 'product_id', COUNT(*) FROM sale WHERE product_id NOT IN (SELECT product_id FROM inv)
    UNION ALL SELECT 'store_id', COUNT(*) FROM sale WHERE store_id NOT IN (SELECT store_id FROM store_dim)""")

# --- forecasting ----------------------------------------------------------

# What a part sold in a store on a day, before any dimension is known.
EXTRA["day_sales"] = """
    SELECT product_id AS part, store_id AS shop, date_id AS on_day, SUM(quantity_sold) AS pieces, SUM(final_sale_value) AS takings
    FROM sale GROUP BY ALL"""

# Conditions of a day in a region, equal rows folded into one with their number.
EXTRA["conditions"] = """
    SELECT record_date AS d, region AS zone, weather_type AS sky, temperature_c AS warmth, rainfall_mm AS rain,
           is_festival AS feast, is_public_holiday AS holiday, is_marriage_season AS weddings, COUNT(*) AS times
    FROM ext WHERE region IS NOT NULL GROUP BY ALL"""

SEASONS = "['Winter', 'Summer', 'Monsoon', 'Autumn']"
EXTRA["feat_days"] = f"""
    WITH calendar AS (
        SELECT date_id AS on_day, full_date, day_name, season, month_number, is_weekend::INTEGER AS is_weekend,
               isodow(full_date)::INTEGER AS day_of_week, coalesce(list_position({SEASONS}, season), 0)::INTEGER AS season_code
        FROM date_dim),
    goods AS (SELECT product_id AS part, product_name, category_name FROM product_dim NATURAL JOIN (SELECT category_id, category_name FROM category_dim))
    SELECT part AS product_id, shop AS store_id, product_name, category_name, full_date, day_name, season, month_number, is_weekend,
           day_of_week, season_code, (pieces * coalesce(times, 1))::BIGINT AS quantity_sold,
           (pieces * coalesce(times, 1))::DOUBLE AS q, (takings * coalesce(times, 1))::DOUBLE AS total_revenue,
           coalesce(feast, FALSE)::INTEGER AS is_festival, coalesce(holiday, FALSE)::INTEGER AS is_public_holiday,
           coalesce(weddings, FALSE)::INTEGER AS is_marriage_season, coalesce(sky, 'Unknown') AS weather_type,
           coalesce(warmth, 20.0) AS temperature_c, coalesce(rain, 0.0) AS rainfall_mm
    FROM day_sales JOIN calendar USING (on_day) JOIN goods USING (part) JOIN store_dim ON store_dim.store_id = shop
    LEFT JOIN conditions ON d = full_date AND zone = store_dim.region"""


def _looking_back(lag: str, mean: str) -> str:
    lags = [f"coalesce({lag.format(n=n)}, 0.0) AS lag_{n}d_qty" for n in (7, 14, 30)]
    means = [f"coalesce({mean.format(n=n)}, 0.0) AS rolling_{n}d_avg" for n in (7, 30)]
    return ", ".join(lags + means)


OWN = "PARTITION BY product_id, store_id ORDER BY full_date"
EXTRA["feat"] = f"""
    SELECT *, {_looking_back(f"lag(q, {{n}}) OVER ({OWN})", f"avg(q) OVER ({OWN} ROWS BETWEEN {{n}} PRECEDING AND 1 PRECEDING)")}
    FROM feat_days"""

NEAR = OWN + " RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL {to} DAY PRECEDING"
statement("feature_table_by_days", f"""
    SELECT product_id, store_id, full_date::VARCHAR AS full_date,
           {_looking_back(f"sum(q) OVER ({NEAR.replace('{to}', '{n}')})", f"avg(q) OVER ({NEAR.replace('{to}', '1')})")}
    FROM feat_days""")
for _name in ("feature_table", "feature_table_grown"):
    statement(_name, "SELECT * EXCLUDE (q) REPLACE (CAST(full_date AS VARCHAR) AS full_date) FROM feat")

FEATURE_ORDER = [
    "day_of_week", "is_weekend", "season_code", "month_number", "is_festival", "is_public_holiday",
    "is_marriage_season", "temperature_c", "rainfall_mm", "lag_7d_qty", "lag_14d_qty", "lag_30d_qty",
    "rolling_7d_avg", "rolling_30d_avg",
]
WEIGHTED = " + ".join(f"{i} * CAST({name} AS DOUBLE)" for i, name in enumerate(FEATURE_ORDER, 1))

statement("feature_vector", f"""
    SELECT product_id, store_id, CAST(full_date AS VARCHAR) AS full_date, 14 AS inputs,
           ROUND({WEIGHTED}, 4) AS weighted_sum FROM feat""")

statement("forecast_metrics", f"""
    SELECT {half_even("AVG(ABS(q - p))", 3)} AS mae, {half_even("SQRT(AVG((q - p) * (q - p)))", 3)} AS rmse,
           {half_even("AVG(ABS((q - p) / GREATEST(q, 1.0::DOUBLE))) * 100", 2)} AS mape_pct,
           {half_even("AVG(q)", 3)} AS mean_actual_qty, COUNT(*) AS test_rows
    FROM (SELECT q, GREATEST(rolling_7d_avg, 0.0::DOUBLE) AS p FROM feat
          WHERE full_date > (SELECT MAX(full_date) FROM feat) - 14)""")

EXTRA["future"] = f"""
    SELECT product_id, store_id, product_name, category_name, day AS forecast_date,
           CAST(isodow(day) AS INTEGER) AS day_of_week, CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend,
           CASE WHEN month(day) IN (12,1,2) THEN 1 WHEN month(day) BETWEEN 3 AND 5 THEN 2
                WHEN month(day) BETWEEN 6 AND 9 THEN 3 ELSE 4 END AS season_code,
           CAST(month(day) AS INTEGER) AS month_number, 0 AS is_festival, 0 AS is_public_holiday,
           0 AS is_marriage_season, temperature_c, 0.0::DOUBLE AS rainfall_mm,
           lag_7d_qty, lag_14d_qty, lag_30d_qty, rolling_7d_avg, rolling_30d_avg
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY full_date DESC) AS age FROM feat),
         (SELECT DATE '{AS_OF}' + CAST(unnest(range(1, 8)) AS INTEGER) AS day)
    WHERE age = 1"""

statement("future_features", "SELECT * REPLACE (CAST(forecast_date AS VARCHAR) AS forecast_date) FROM future")

EXTRA["daily_fc"] = f"""
    SELECT product_id, store_id, product_name, category_name AS category, forecast_date AS date,
           dayname(forecast_date) AS day_name,
           GREATEST({half_even("rolling_7d_avg * 1.05::DOUBLE + day_of_week * 0.3::DOUBLE - 20.0::DOUBLE", 1)}, 0.0::DOUBLE) + 0.0::DOUBLE AS predicted_qty,
           is_weekend = 1 AS is_weekend
    FROM future"""
EXTRA["total_fc"] = """
    SELECT product_id, store_id, product_name, category, COUNT(*) AS days_ahead,
           CAST(SUM(CAST(predicted_qty AS DECIMAL(18,1))) AS DOUBLE) AS total_predicted_qty,
           string_agg(CAST(CAST(predicted_qty AS DECIMAL(18,1)) AS VARCHAR), '|' ORDER BY date) AS daily_forecast
    FROM daily_fc GROUP BY product_id, store_id, product_name, category"""

statement("daily_forecast", "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM daily_fc")
statement("forecast_totals", "SELECT * FROM total_fc")
statement("top_demand", """
    SELECT store_id, product_id, product_name, category, total_predicted_qty AS total_7d_forecast
    FROM total_fc JOIN (
        SELECT product_id, store_id, row_number() OVER (PARTITION BY store_id ORDER BY SUM(quantity_sold) DESC, product_id) AS place
        FROM feat GROUP BY product_id, store_id) USING (product_id, store_id)
    WHERE place <= 3""")

# What does not depend on the forest, and facts that every forest must meet.
EXTRA["held"] = "SELECT q FROM feat WHERE full_date > (SELECT MAX(full_date) FROM feat) - 14"
EXTRA["past"] = "SELECT q FROM feat WHERE full_date <= (SELECT MAX(full_date) FROM feat) - 14"
statement("train_forecast", f"""
    SELECT (SELECT COUNT(*) FROM past) AS train_rows, COUNT(*) AS test_rows, {half_even("AVG(q)", 3)} AS mean_actual_qty,
           TRUE AS errors_finite, TRUE AS mae_within_rmse FROM held""")
statement("feature_importance", f"""
    SELECT unnest({FEATURE_ORDER}) AS feature, TRUE AS not_negative, TRUE AS sums_to_one""")
statement("predict_demand", """
    SELECT product_id, store_id, product_name, category, CAST(date AS VARCHAR) AS date, day_name, is_weekend,
           TRUE AS within_range FROM daily_fc""")
statement("top_demand_forecast", """
    SELECT store_id, product_id, product_name, category_name AS category, TRUE AS total_of_days
    FROM (SELECT product_id, store_id, product_name, category_name,
                 row_number() OVER (PARTITION BY store_id ORDER BY SUM(quantity_sold) DESC, product_id) AS place
          FROM feat GROUP BY product_id, store_id, product_name, category_name)
    WHERE place <= 10""")

# --- decisions ------------------------------------------------------------

EXTRA["goods"] = """
    SELECT p.*, c.category_name FROM product_dim p JOIN category_dim c ON p.category_id = c.category_id"""
EXTRA["shelf"] = """
    SELECT inv.*, product_name, category_id AS category_name, supplier_id, store_name
    FROM inv JOIN product_dim USING (product_id) JOIN store_dim USING (store_id)"""
EXTRA["delivery"] = """
    SELECT supplier_id, supplier_name, contact_phone, lead_time_days AS usual_lead FROM supplier_dim"""
EXTRA["cand_base"] = f"""
    SELECT inventory_id, product_id, product_name, category_name, store_id, store_name, closing_stock, reorder_level,
           safety_stock, reorder_point, ifnull(ifnull(lead_time_days, usual_lead), 7) AS lead_time_days, unit_cost, supplier_id,
           supplier_name, contact_phone, {dbl("reorder_level")} - closing_stock AS restock_gap,
           {dbl("unit_cost * closing_stock")} AS current_stock_value,
           ifnull({half_up(f'{dbl("closing_stock")} / nullif(greatest(units_consumed, 0), 0)', 1)}, 999.0::DOUBLE) AS raw_days_until_stockout
    FROM shelf JOIN delivery USING (supplier_id) WHERE closing_stock BETWEEN 0 AND reorder_level"""
EXTRA["cand"] = f"""
    SELECT *, DATE '{STOCK_AS_OF}' + CAST(GREATEST(1, lead - 2) AS INTEGER) AS order_deadline,
           CASE WHEN days_until_stockout <= lead THEN '🔴 CRITICAL — Stock out before delivery'
                WHEN days_until_stockout <= lead * 2 THEN '🟠 HIGH — Order within 2 days'
                WHEN restock_gap > safety_stock THEN '🟡 MEDIUM — Order this week'
                ELSE '🟢 LOW — Monitor' END AS urgency
    FROM (SELECT *, CASE WHEN raw_days_until_stockout = 0 THEN 999.0::DOUBLE ELSE raw_days_until_stockout END AS days_until_stockout,
                 CASE WHEN lead_time_days = 0 THEN 7 ELSE lead_time_days END AS lead
          FROM cand_base)"""

statement("restock_candidates", f"""
    SELECT * EXCLUDE (lead) REPLACE (CAST(order_deadline AS VARCHAR) AS order_deadline, {dbl("unit_cost")} AS unit_cost)
    FROM cand""")


def _quantity(closing: str, safety: str, reorder: str, lead: str, f: str) -> str:
    c, s, r = dbl(closing), dbl(safety), dbl(reorder)
    raw = f"CASE WHEN {f} <= 0 THEN ({r} - {c}) + {s} ELSE GREATEST({f} / 7.0::DOUBLE * {lead} + {s} - {c}, {r} - {c}) END"
    return f"(GREATEST(0.0::DOUBLE, {half_even(raw, 0)}) + 0.0::DOUBLE)"


statement("restock_quantity", f"""
    SELECT inventory_id, {_quantity("closing_stock", "safety_stock", "reorder_level", "lead", "f")} AS restock_qty,
           CAST(DATE '{STOCK_AS_OF}' + CAST(GREATEST(1, lead - 2) AS INTEGER) AS VARCHAR) AS order_deadline,
           lead AS lead_time_days, {half_even("f / 7.0::DOUBLE", 2)} AS daily_demand_est,
           CASE WHEN f > 0 THEN 'forecast-based' ELSE 'gap-based' END AS method
    FROM (SELECT i.*, COALESCE(fc.forecast_7d_qty, 0.0::DOUBLE) AS f, COALESCE(i.lead_time_days, 7) AS lead
          FROM inv i LEFT JOIN fc ON i.product_id = fc.product_id AND i.store_id = fc.store_id)""")

statement("stockout_alerts", """
    SELECT product_id, product_name, category_name, store_id, store_name, closing_stock, safety_stock,
           ifnull(ifnull(lead_time_days, usual_lead), 7) AS lead_time_days, supplier_name, contact_phone
    FROM shelf JOIN delivery USING (supplier_id) WHERE is_stockout
    UNION ALL
    SELECT product_id, product_name, category_name, store_id, store_name, closing_stock, safety_stock,
           ifnull(ifnull(lead_time_days, usual_lead), 7), supplier_name, contact_phone
    FROM shelf JOIN delivery USING (supplier_id) WHERE closing_stock = 0 AND NOT is_stockout""")


def _tiers(d: str) -> str:
    def pick(expired, tiers, fresh):
        limits = [7, 15, 30, 60, 90]
        body = " ".join(f"WHEN {d} <= {n} THEN {v}" for n, v in zip(limits, tiers))
        return f"CASE WHEN {d} <= 0 THEN {expired} {body} ELSE {fresh} END"

    pct = [45, 30, 25, 15, 7]
    act = [f"'Apply {p}% discount immediately. Sell within ' || {d} || ' days.'" for p in pct]
    return f"""{pick(50, pct, 0)} AS discount_pct,
        {pick("NULL", ["'40–50%'", "'25–35%'", "'20–30%'", "'10–20%'", "'5–10%'"], "NULL")} AS discount_range,
        {pick("'🔴 EXPIRED / CLEARANCE'", ["'🔴 CRITICAL'", "'🟠 HIGH'", "'🟡 MEDIUM-HIGH'", "'🟢 MEDIUM'", "'🔵 LOW'"], "'✅ FRESH'")} AS label,
        {pick("'Pull from shelf immediately. Donate or discard.'", act, "'No discount needed.'")} AS action,
        CASE WHEN {d} <= 7 THEN 'IMMEDIATE' WHEN {d} <= 15 THEN 'HIGH' WHEN {d} <= 90 THEN 'MEDIUM' ELSE 'NONE' END AS urgency"""


def _clearance(source: str) -> str:
    s, c = dbl("selling_price"), dbl("cost_price")
    return f"""
        SELECT * EXCLUDE (disc, fin, cost_price), {half_even(s, 2)} AS original_price, {half_even("fin", 2)} AS clearance_price,
               {half_even(c, 2)} AS cost_price, {half_even(f"(1.0::DOUBLE - fin / NULLIF({s}, 0)) * 100.0::DOUBLE", 2)} AS actual_discount_pct,
               {half_even(f"(fin - {c}) / NULLIF(fin, 0) * 100.0::DOUBLE", 2)} AS margin_after_pct, fin > disc AS floor_applied
        FROM (SELECT *, {s} * (1.0::DOUBLE - discount_pct / 100.0::DOUBLE) AS disc,
                     GREATEST({s} * (1.0::DOUBLE - discount_pct / 100.0::DOUBLE), {c} * 1.01::DOUBLE) AS fin
              FROM ({source}))"""


DAYS_LEFT = f"CAST(i.expiry_date - DATE '{STOCK_AS_OF}' AS INTEGER)"

statement("expiry_discount_tiers", f"""
    SELECT inventory_id, days_to_expiry, {_tiers("days_to_expiry")}
    FROM (SELECT inventory_id, {DAYS_LEFT} AS days_to_expiry FROM inv i WHERE expiry_date IS NOT NULL)""")

statement("clearance_prices", f"""
    SELECT * REPLACE ({dbl("selling_price")} AS selling_price)
    FROM ({_clearance('SELECT product_id, selling_price, cost_price, CAST(product_id % 11 * 5 AS INTEGER) AS discount_pct FROM product_dim')})""")

EXTRA["expiring"] = _clearance(f"""
    SELECT *, {_tiers("days_to_expiry")}
    FROM (SELECT i.inventory_id, i.product_id, g.product_name, g.category_name, i.store_id, s.store_name, i.closing_stock,
                 i.unit_cost, g.selling_price, g.cost_price, g.mrp, i.expiry_date, {DAYS_LEFT} AS days_to_expiry,
                 CAST(ROUND(i.closing_stock * i.unit_cost, 2) AS DECIMAL(18,2)) AS value_at_risk
          FROM inv i JOIN goods g ON i.product_id = g.product_id JOIN store_dim s ON i.store_id = s.store_id
          WHERE i.expiry_date IS NOT NULL AND i.closing_stock > 0 AND {DAYS_LEFT} BETWEEN 0 AND 90)""")

EXPIRING = f"""
    SELECT * REPLACE (CAST(expiry_date AS VARCHAR) AS expiry_date, {dbl("value_at_risk")} AS value_at_risk,
                      {dbl("unit_cost")} AS unit_cost, {dbl("selling_price")} AS selling_price, {dbl("mrp")} AS mrp)
    FROM expiring"""
statement("expiry_alerts", EXPIRING)
statement("expiry_alerts_in_order", f"""
    SELECT *, row_number() OVER (ORDER BY days_to_expiry, inventory_id) AS position FROM ({EXPIRING})""")

EXTRA["margins"] = f"""
    SELECT *, {dbl("gain")} / {dbl("selling_price")} * 100.0::DOUBLE AS pct
    FROM (SELECT *, selling_price - cost_price AS gain FROM product_dim WHERE selling_price <> 0)"""
EXTRA["thin"] = "SELECT *, CAST(pct AS DECIMAL(38,10)) AS snapped FROM margins WHERE CAST(pct AS DECIMAL(38,10)) < 10"
statement("low_margin_products", f"""
    SELECT product_id, product_name, category_id AS category_name, {dbl("cost_price")} AS cost_price,
           {dbl("selling_price")} AS selling_price, {dbl("mrp")} AS mrp, supplier_name, supplier_id,
           {half_up("pct", 2)} AS margin_pct,
           if(gain < 0, '🔴 SELLING BELOW COST', if(snapped < 5, '🟠 NEAR ZERO MARGIN', '🟡 LOW MARGIN')) AS margin_label,
           if({half_up("pct", 2)} < 0, 'Raise price to at least cost + 5% OR renegotiate supplier cost',
              'Review pricing — margin too thin for sustainable business') AS recommended_action
    FROM thin JOIN delivery USING (supplier_id)""")

# --- orders and alerts ----------------------------------------------------

EXTRA["ord_base"] = f"""
    SELECT c.*, CASE WHEN c.lead_time_days = 0 THEN 7 ELSE c.lead_time_days END AS l, COALESCE(fc.forecast_7d_qty, 0.0::DOUBLE) AS f
    FROM (SELECT *, row_number() OVER (PARTITION BY store_id
                 ORDER BY restock_gap DESC, raw_days_until_stockout, inventory_id) AS order_seq FROM cand) c
    LEFT JOIN fc ON c.product_id = fc.product_id AND c.store_id = fc.store_id
    WHERE order_seq <= 50"""
EXTRA["ord"] = f"""
    SELECT *, {half_even(f'restock_qty * {dbl("unit_cost")}', 2)} AS estimated_order_value,
           CASE WHEN contains(urgency, 'CRITICAL') THEN 0 WHEN contains(urgency, 'HIGH') THEN 1 ELSE 2 END AS urgency_rank
    FROM (SELECT product_id, product_name, category_name AS category, store_id, store_name, supplier_id, supplier_name,
                 contact_phone AS supplier_phone, closing_stock AS current_stock, reorder_level,
                 {_quantity("closing_stock", "safety_stock", "reorder_level", "l", "f")} AS restock_qty, order_deadline,
                 l AS lead_time_days, f AS forecast_7d_qty, unit_cost, urgency,
                 CASE WHEN f > 0 THEN 'forecast-based' ELSE 'gap-based' END AS calculation_method, order_seq
          FROM ord_base)"""
ORDER_LIST = """o.product_id, o.product_name, o.category, o.store_id, o.store_name, o.supplier_id, o.supplier_name,
    o.supplier_phone, o.current_stock, o.reorder_level, o.restock_qty, o.lead_time_days, o.forecast_7d_qty,
    o.estimated_order_value, o.urgency, o.calculation_method"""
statement("restock_orders", f"""
    SELECT {ORDER_LIST}, CAST(o.order_deadline AS VARCHAR) AS order_deadline, order_seq FROM ord o""")

CENTS = "SUM(CAST(estimated_order_value AS DECIMAL(18,2)))"
statement("restock_run_summary", f"""
    SELECT s.store_id, COUNT(o.store_id) AS orders_created, COUNT(*) FILTER (o.urgency_rank = 0) AS critical_count,
           COALESCE({dbl(CENTS)}, 0.0) AS total_order_value
    FROM store_dim s LEFT JOIN ord o ON s.store_id = o.store_id GROUP BY s.store_id""")

statement("restock_run_totals", f"""
    SELECT '{STOCK_AS_OF}' AS run_date, COUNT(*) AS total_orders, COUNT(*) FILTER (urgency_rank = 0) AS critical_orders,
           COUNT(*) FILTER (urgency_rank = 1) AS high_orders, COALESCE({dbl(CENTS)}, 0.0) AS total_order_value
    FROM ord""")

QTY_TEXT = "CASE WHEN restock_qty = 0 THEN '0' ELSE CAST(CAST(restock_qty AS DECIMAL(38,1)) AS VARCHAR) END"
EXTRA["r_alerts"] = f"""
    SELECT 'RESTOCK' AS alert_type, 'CRITICAL' AS priority,
           '🔴 CRITICAL: ' || COUNT(*) || ' products stockout risk at ' || store_id AS title,
           'Store ' || store_id || ' has ' || COUNT(*) || ' products that will stock out before supplier delivery. Top item: '
               || arg_min(product_name || ' (stock: ' || current_stock || ', order ' || {QTY_TEXT} || ' units from '
               || supplier_name || ' by ' || CAST(order_deadline AS VARCHAR) || ').', order_seq) AS message,
           CAST(store_id AS VARCHAR) AS store_id,
           string_agg(CAST(product_id AS VARCHAR), '|' ORDER BY order_seq) FILTER (place <= 5) AS data
    FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY order_seq) AS place FROM ord WHERE urgency_rank = 0)
    GROUP BY store_id
    UNION ALL
    SELECT 'RESTOCK', 'HIGH', '🟠 HIGH: ' || COUNT(*) || ' restock orders needed today',
           COUNT(*) || ' products across stores need restock orders today. Estimated total order value: ₹'
               || {grouped(CENTS)} || '.',
           NULL, string_agg(CAST(product_id AS VARCHAR), '|' ORDER BY store_id, order_seq) FILTER (place <= 10)
    FROM (SELECT *, row_number() OVER (ORDER BY store_id, order_seq) AS place FROM ord WHERE urgency_rank = 1)
    HAVING COUNT(*) > 0"""
ALERT = f"alert_type, priority, title, message, store_id, CAST(NULL AS VARCHAR) AS product_id, '{STOCK_AS_OF}' AS created_at"
statement("restock_alerts", f"SELECT {ALERT}, data FROM r_alerts")

EXTRA["e_alerts"] = f"""
    SELECT 'EXPIRY' AS alert_type, band AS priority,
           CASE band WHEN 'CRITICAL' THEN '🔴 EXPIRY: ' || COUNT(*) || ' products expire within 7 days!'
                ELSE '🟠 EXPIRY: ' || COUNT(*) || ' products expire in 8–15 days' END AS title,
           CASE band WHEN 'CRITICAL' THEN '₹' || {grouped("SUM(value_at_risk)")} || ' at risk. Apply 40–50% discount IMMEDIATELY. Top item: '
                     || arg_min(product_name || ' at ' || store_name || '.', place)
                ELSE '₹' || {grouped("SUM(value_at_risk)")} || ' at risk. Apply 25–35% discount this week.' END AS message,
           CAST(NULL AS VARCHAR) AS store_id,
           string_agg(CAST(product_id AS VARCHAR), '|' ORDER BY place) FILTER (place <= 5) AS data
    FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY days_to_expiry, inventory_id) AS place
          FROM (SELECT *, CASE WHEN urgency = 'IMMEDIATE' AND days_to_expiry <= 7 THEN 'CRITICAL'
                               WHEN days_to_expiry > 7 AND days_to_expiry <= 15 THEN 'HIGH' END AS band FROM expiring)
          WHERE band IS NOT NULL)
    GROUP BY band"""
statement("expiry_alert_rollup", f"SELECT {ALERT}, data FROM e_alerts")

CHANNELS = "CASE priority WHEN 'CRITICAL' THEN 'whatsapp,telegram' WHEN 'HIGH' THEN 'telegram,email' WHEN 'MEDIUM' THEN 'email' ELSE 'dashboard' END"
statement("route_alerts", f"""
    SELECT {ALERT}, {CHANNELS} AS channels, FALSE AS dispatched, TRUE AS dry_run FROM r_alerts""")
statement("alert_outbox", f"""
    SELECT {ALERT}, FALSE AS dispatched, TRUE AS dry_run, unnest(string_split({CHANNELS}, ',')) AS channel FROM e_alerts""")

statement("posted_alerts", f"""
    SELECT sha256(concat_ws('', length(alert_type) || ':' || alert_type, length(priority) || ':' || priority, '-', '-',
               '10:{STOCK_AS_OF}', length(channel) || ':' || channel)) AS alert_key,
           {ALERT}, channel, CASE channel WHEN 'telegram' THEN 'sent' ELSE 'pending' END AS state,
           CASE WHEN channel IN ('telegram', 'whatsapp') THEN 1 ELSE 0 END AS attempts,
           CASE WHEN channel IN ('telegram', 'whatsapp') THEN '2026-01-01 08:00:00' END AS attempted_at
    FROM (SELECT *, unnest(string_split({CHANNELS}, ',')) AS channel FROM e_alerts)""")

EXTRA["sup_ord"] = f"""
    SELECT supplier_id, MAX(supplier_name) AS supplier_name, MAX(supplier_phone) AS supplier_phone,
           COUNT(*) AS total_items, {dbl(CENTS)} AS total_value, MIN(order_deadline) AS earliest_deadline,
           string_agg(line_no || '. ' || product_name || ' | Store: ' || store_id || ' | Qty: ' || CAST(restock_qty AS BIGINT)
                      || ' units | Urgency: ' || urgency, chr(10) ORDER BY line_no) FILTER (line_no <= 10) AS printed
    FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY urgency_rank, store_id, order_seq) AS line_no FROM ord)
    GROUP BY supplier_id"""
statement("supplier_orders", """
    SELECT * EXCLUDE (printed) REPLACE (CAST(earliest_deadline AS VARCHAR) AS earliest_deadline) FROM sup_ord""")
statement("supplier_order_lines", f"""
    SELECT {ORDER_LIST}, CAST(o.order_deadline AS VARCHAR) AS order_deadline, o.order_seq,
           total_items AS supplier_items, total_value AS supplier_value,
           CAST(earliest_deadline AS VARCHAR) AS earliest_deadline
    FROM ord o JOIN sup_ord s ON o.supplier_id = s.supplier_id""")
statement("supplier_messages", f"""
    SELECT supplier_id, supplier_name, supplier_phone, total_items, total_value,
           CAST(earliest_deadline AS VARCHAR) AS earliest_deadline,
           concat_ws(chr(10), '🏪 RETAIL — Purchase Order Request',
               '📅 Date: ' || strftime(DATE '{STOCK_AS_OF}', '%d %b %Y'), '📦 Supplier: ' || supplier_name,
               '⏰ Please confirm by: ' || CAST(earliest_deadline AS VARCHAR), '', 'ORDER DETAILS:', printed,
               CASE WHEN total_items > 10 THEN '... and ' || (total_items - 10) || ' more items.' END, '',
               '💰 Estimated Order Value: ₹' || {grouped("total_value")}, '',
               'Please reply to confirm or call us.', '— Retail Purchasing') AS order_message,
           FALSE AS sent, TRUE AS dry_run
    FROM sup_ord""")

# --- ingestion ------------------------------------------------------------

# Texts that a CSV reader of data frames takes for missing by default: fixed values.
NA = """'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A',
    'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"""


def na(x: str) -> str:
    return f"(CASE WHEN {x} NOT IN ({NA}) THEN {x} END)"


def num(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({na(x)}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def truncated(x: str) -> str:
    return f"CAST(trunc({num(x)}) AS INTEGER)"


def whole(x: str) -> str:
    return f"(CASE WHEN {num(x)} = floor({num(x)}) THEN CAST({num(x)} AS INTEGER) END)"


def int0(x: str) -> str:
    return f"COALESCE({truncated(x)}, 0)"


def strict(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({na(x)}, '\\s*[+-]?\\d+\\s*') THEN CAST(trim({x}) AS INTEGER) END)"


def rounded(x: str) -> str:
    return f"CAST(printf('%.0f', {num(x)}) AS INTEGER)"


def _cents(x: str, tie: str) -> str:
    d = f"CAST(trim({x}) AS DECIMAL(30,6))"
    d = f"(CASE WHEN contains(lower({x}), 'e') THEN CAST(CAST(trim({x}) AS DOUBLE) AS DECIMAL(30,6)) ELSE {d} END)"
    f_, over = f"floor({d} * 100)", f"({d} * 100 - floor({d} * 100))"
    up = f"CASE WHEN {over} > 0.5 THEN 1 WHEN {over} < 0.5 THEN 0 ELSE {tie.format(f=f_, d=d)} END"
    return f"(CASE WHEN {num(x)} IS NOT NULL THEN CAST({f_} + {up} AS DOUBLE) / 100 END)"


def cash(x: str) -> str:
    return f"(CASE WHEN {na(x)} IS NULL OR trim({x}) = '' THEN 0.0 ELSE {_cents(x, 'abs(CAST({f} AS BIGINT) % 2)')} END)"


def priced(x: str) -> str:
    return _cents(x, "CASE WHEN {d} < 0 THEN 0 ELSE 1 END")


def txt(x: str) -> str:
    return f"trim({na(x)})"


def flag(x: str) -> str:
    return f"COALESCE(upper(trim({na(x)})) IN ('TRUE','1','YES'), FALSE)"


def flag3(x: str, true: str, false: str) -> str:
    return f"(CASE WHEN upper(trim({na(x)})) IN ({true}) THEN TRUE WHEN upper(trim({na(x)})) IN ({false}) THEN FALSE END)"


def stamp(x: str) -> str:
    return f"strftime(TRY_CAST({na(x)} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"


def iso_day(x: str) -> str:
    return f"CAST(CAST(TRY_CAST({na(x)} AS TIMESTAMP) AS DATE) AS VARCHAR)"


def dmy(x: str) -> str:
    return f"CAST(CAST(try_strptime({na(x)}, '%d-%m-%Y') AS DATE) AS VARCHAR)"


def dmy_stamp(x: str) -> str:
    return f"strftime(try_strptime({na(x)}, '%d-%m-%Y %H:%M'), '%Y-%m-%d %H:%M:%S')"


def columns(rule, *names: str) -> str:
    return ", ".join(f"{rule(name)} AS {name}" for name in names)


for _name in EXPORTS:
    EXTRA[f"raw_{_name}"] = export_sql(_name)

JOBS: dict[str, tuple[str, list[tuple[str, str]]]] = {}


def job(table: str, select: str, rules: list[tuple[str, str]]) -> None:
    """``rules`` pair the condition a valid row meets with the reason given where it does not."""
    JOBS[table] = (select, rules)
    keep = " AND ".join(f"COALESCE({condition}, FALSE)" for condition, _ in rules)
    statement(f"clean_{table}", f"SELECT {select} FROM raw_{table} WHERE {keep}")


NULL_TEXT = "CAST(NULL AS VARCHAR)"
job("brand", f"""{columns(whole, "brand_id")}, {columns(txt, "brand_name", "brand_country")},
    {flag3("is_active", "'TRUE'", "'FALSE'")} AS is_active, {columns(stamp, "created_at")}""",
    [(f"{whole('brand_id')} IS NOT NULL", "key is not a whole number")])

job("category", f"""{columns(whole, "category_id")}, {columns(txt, "category_name")}, {columns(whole, "parent_category_id")},
    {columns(flag, "is_active")}, {columns(stamp, "created_at", "updated_at")}""",
    [(f"{whole('category_id')} IS NOT NULL", "key is not a whole number"),
     (f"({whole('parent_category_id')} IS NOT NULL OR {num('parent_category_id')} IS NULL)", "parent is a fraction")])

job("supplier", f"""{columns(txt, "supplier_id", "supplier_name")},
    regexp_replace({txt("contact_phone")}, '\\.0$', '') AS contact_phone, {NULL_TEXT} AS contact_email,
    {txt("state")} AS city, {txt("city")} AS state, {columns(truncated, "lead_time_days")}, {columns(flag, "is_active")},
    {stamp("created_at")} AS created_at, {stamp("created_at")} AS updated_at""",
    [(f"{txt('supplier_id')} <> ''", "key is blank")])

job("store", f"""{columns(txt, "store_id", "store_name", "store_type", "city", "state", "region", "zone", "country")},
    {NULL_TEXT} AS store_code, {NULL_TEXT} AS address, {NULL_TEXT} AS pincode, {columns(flag, "is_active")},
    {stamp("created_at")} AS created_at, {stamp("created_at")} AS updated_at""",
    [(f"{txt('store_id')} <> ''", "key is blank")])

CUSTOMER_NUMBER = "replace(customer_id, 'CUST', '')"
job("customer", f"""{columns(txt, "customer_id", "phone_hash", "customer_type")}, {columns(iso_day, "first_transaction_date")},
    {flag3("is_active", "'TRUE','1','YES'", "'FALSE','0','NO'")} AS is_active, {columns(stamp, "created_at")}""",
    [(f"{num(CUSTOMER_NUMBER)} IS NOT NULL",
      "key is not a numbered customer"),
     ("customer_type IN ('NEW','REPEAT','INACTIVE')", "customer type is unknown")])

job("date", f"""{columns(whole, "date_id", "day")}, {columns(iso_day, "full_date")},
    {columns(rounded, "month_number", "quarter", "year", "week_number")},
    {columns(flag, "is_weekend", "is_month_start", "is_month_end")}, {columns(txt, "season", "day_name", "month_name")}""",
    [(f"{iso_day('full_date')} IS NOT NULL", "full_date is not a date"),
     (f"{whole('date_id')} IS NOT NULL", "date_id is not a whole number"),
     (f"({whole('day')} IS NOT NULL OR {num('day')} IS NULL)", "day is a fraction")])

job("festival", f"""{columns(txt, "festival_id", "event_id", "event_name", "festival_name", "religion", "state", "region",
    "demand_level", "demand_category")}, {columns(truncated, "religion_id", "festival_period_days")},
    {columns(iso_day, "festival_start_date", "festival_end_date")},
    {columns(flag, "is_national_holiday", "historically_consistent_uplift")}, {columns(stamp, "created_at", "updated_at")},
    {columns(num, "expected_demand_multiplier")}""",
    [("regexp_full_match(festival_id, 'FES\\d+')", "key is not a festival id")])

job("external_factors", f"""{truncated("date_id")} AS factor_id, {iso_day("full_date")} AS record_date,
    {columns(txt, "region", "weather_type")}, {columns(num, "temperature_c", "rainfall_mm", "humidity_pct")},
    {columns(flag, "is_school_holiday", "is_school_reopening", "is_festival", "is_weekend", "is_public_holiday",
             "is_marriage_season", "is_harvest_season", "is_exam_season")},
    {stamp("created_at")} AS created_at, {stamp("created_at")} AS updated_at""",
    [(f"{num('date_id')} IS NOT NULL", "key is not a number")])

job("product", f"""{columns(txt, "product_id", "sku_code", "product_name", "pack_size_unit", "supplier_id")},
    CAST(CAST(trunc({num("barcode")}) AS BIGINT) AS VARCHAR) AS barcode, {columns(strict, "category_id", "brand_id")},
    {columns(priced, "mrp", "cost_price", "selling_price")}, {columns(num, "pack_size_value", "tax_rate_pct")},
    {columns(dmy, "manufacturing_date", "expiry_date")}, {columns(dmy_stamp, "created_at", "updated_at")},
    {columns(flag, "is_active")}""",
    [(f"{txt('product_id')} <> ''", "key is blank"),
     (f"({num('barcode')} IS NOT NULL OR {na('barcode')} IS NULL)", "barcode is not a number")])

LEGEND = "NOT regexp_matches({k}, '^(PK:|Legend:)')"
job("inventory", f"""{columns(txt, "inventory_id")}, {columns(na, "batch_number", "product_id", "store_id")},
    {columns(int0, "date_id", "opening_stock", "closing_stock", "units_consumed", "safety_stock", "reorder_level",
             "reorder_point", "lead_time_days", "shrinkage_units")}, {columns(priced, "unit_cost")},
    {columns(iso_day, "expiry_date")}, {columns(flag, "is_stockout")},
    {stamp("created_at")} AS created_at, {stamp("created_at")} AS updated_at""",
    [(f"{na('inventory_id')} IS NOT NULL", "key is missing"),
     (LEGEND.format(k="inventory_id"), "row is a legend")])

AMOUNTS = ["mrp_per_unit", "unit_selling_price", "discount_amount", "tax_amount", "final_sale_value"]
job("transaction", f"""{columns(txt, "transaction_id", "invoice_number", "store_id", "product_id", "payment_mode",
    "transaction_status")}, {columns(int0, "date_id", "quantity_sold")}, {columns(cash, *AMOUNTS)},
    {columns(na, "customer_id")}, {columns(flag, "is_return")},
    {stamp("created_at")} AS created_at, {stamp("created_at")} AS updated_at""",
    [(f"{na('transaction_id')} IS NOT NULL", "key is missing"),
     (LEGEND.format(k="transaction_id"), "row is a legend")]
    + [(f"{cash(a)} IS NOT NULL", f"{a} is malformed") for a in AMOUNTS])

EXTRA["children"] = STATEMENTS["clean_category"].split("\n", 0)[0]
statement("category_with_parents", """
    SELECT * FROM children WHERE category_id NOT BETWEEN 32 AND 37
    UNION ALL BY NAME
    SELECT 31 + row_number() OVER () AS category_id, n AS category_name, CAST(NULL AS INTEGER) AS parent_category_id,
           TRUE AS is_active, '2026-02-27 00:00:00' AS created_at, '2026-02-27 00:00:00' AS updated_at
    FROM (SELECT unnest(['Grocery & Staples','Snacks & Beverages','Dairy & Beverages','Home & Cleaning','Personal Care','Religious & Others']) AS n)""")

EXTRA["lists"] = f"""
    SELECT trim(festival_id) AS festival_id,
           list_filter(list_transform(string_split({na("top_product_ids")}, ','), lambda x: trim(x)), lambda x: x <> '') AS ids,
           list_filter(list_transform(string_split({na("top_product_names")}, ','), lambda x: trim(x)), lambda x: x <> '') AS names
    FROM raw_festival WHERE regexp_full_match(festival_id, 'FES\\d+')
      AND {na("top_product_ids")} IS NOT NULL AND {na("top_product_names")} IS NOT NULL"""
statement("festival_products", """
    SELECT festival_id, ids[n] AS product_id, names[n] AS product_name, CAST(n AS INTEGER) AS rank
    FROM (SELECT *, unnest(range(1, least(len(ids), len(names)) + 1)) AS n FROM lists)""")


def _rejects(table: str) -> str:
    reasons = " ".join(
        f"WHEN NOT COALESCE({condition}, FALSE) THEN '{reason}'" for condition, reason in JOBS[table][1]
    )
    return f"""SELECT '{table}' AS table_name, reject_reason, COUNT(*) AS n
        FROM (SELECT CASE {reasons} END AS reject_reason FROM raw_{table}) WHERE reject_reason IS NOT NULL GROUP BY ALL"""


statement("rejected_rows", " UNION ALL ".join(_rejects(table) for table in JOBS))

statement("ragged_rows", f"""
    SELECT '' || p_partkey AS brand_id, CASE WHEN p_partkey % 5 = 2 THEN p_brand || ', Ltd' ELSE p_brand END AS brand_name,
           CASE WHEN p_partkey % 5 < 2 THEN 'row does not have the header''s fields' END AS reject_reason,
           CASE WHEN p_partkey % 5 < 2 THEN value END AS line
    FROM (SELECT *, {RAGGED_LINE} AS value FROM part)""")

INSERTED = """
    SELECT c_custkey, c_name AS name FROM customer
    UNION ALL
    SELECT k, 'order ' || MIN(o_orderkey)
    FROM (SELECT o_custkey + CASE WHEN o_orderstatus = 'P' THEN 1000000000 ELSE 0 END AS k, o_orderkey FROM orders)
    WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY k"""
statement("insert_if_absent", INSERTED)
statement("insert_in_place", INSERTED)

EXTRA["merge_batch"] = """
    SELECT CASE WHEN l_returnflag = 'R' THEN -l_orderkey - 1 ELSE l_orderkey END AS entry,
           SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount, MAX(CASE WHEN l_linestatus = 'F' THEN 'F' END) AS status,
           CAST(MAX(l_shipdate) AS DATE) AS day
    FROM lineitem GROUP BY 1"""
UPSERTED = """
    SELECT o_orderkey AS entry, CAST(CASE WHEN b.entry IS NOT NULL THEN b.amount ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount,
           CASE WHEN b.entry IS NOT NULL THEN b.status ELSE o_orderstatus END AS status,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at,
           CASE WHEN b.entry IS NOT NULL THEN '2026-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS updated_at
    FROM orders LEFT JOIN merge_batch b ON o_orderkey = b.entry
    UNION ALL
    SELECT entry, CAST(amount AS DOUBLE), status, CAST(day AS VARCHAR), CAST(day AS VARCHAR) FROM merge_batch
    WHERE entry NOT IN (SELECT o_orderkey FROM orders)"""
for _name in ("upsert", "upsert_in_place", "upsert_by_deltas"):
    statement(_name, UPSERTED)
