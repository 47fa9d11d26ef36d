"""SQL checks of ingest, cleaning, table maintenance and sinks."""

from __future__ import annotations

from tillgrain.oracle.base import big, block, period, query, season_met
from tillgrain.oracle import dashboard  # noqa: F401  (blocks)
from tillgrain.plans.ingest import CLEARED_USER, GONE_UPLOAD, MODEL_VERSION

HH = "lpad(CAST(hour AS VARCHAR), 2, '0')"
block("raw_fields", f"""
SELECT user_id, is_imputed, order_id, order_date, hour,
  CASE WHEN order_id % 109 <> 4 THEN ' ' || CASE WHEN order_id % 107 = 3 THEN '' ELSE CAST(order_id AS VARCHAR) END || ' ' END AS order_reference,
  CASE WHEN order_id % 113 <> 5 THEN split_part(product, '#', 2) END AS sku,
  CASE WHEN order_id % 97 = 0 THEN 'abc' WHEN order_id % 89 = 0 THEN '-1' WHEN order_id % 83 = 0 THEN 'nan' WHEN order_id % 79 = 0 THEN 'Infinity'
    WHEN order_id % 73 = 0 THEN '1e12' ELSE quantity || '.7' END AS quantity,
  CASE WHEN order_id % 101 = 0 THEN 'n/a' WHEN order_id % 83 = 1 THEN 'NaN' ELSE (price_cents // 100) || '.00' END AS unit_price,
  (cost_cents // 100) || '.' || lpad(CAST(cost_cents % 100 AS VARCHAR), 2, '0') AS unit_cost,
  category AS category_en, ' ' || product AS name_en,
  CASE WHEN order_id % 103 = 0 THEN 'bad-date' WHEN order_id % 11 = 1 AND day(order_date) > 12 THEN strftime(order_date, '%d/%m/%Y')
    WHEN order_id % 11 = 2 THEN strftime(order_date, '%Y/%m/%d') WHEN order_id % 11 = 3 THEN strftime(order_date, '%-m/%-d/%Y')
    WHEN order_id % 11 = 4 THEN strftime(order_date, '%Y-%m-%d 00:00:00') WHEN order_id % 11 = 5 THEN strftime(order_date, '%b %-d, %Y')
    WHEN order_id % 11 = 6 THEN strftime(order_date, '%Y%m%d')
    WHEN order_id % 11 = 7 AND day(order_date) > 12 THEN strftime(order_date, '%d/%m/%y') WHEN order_id % 11 = 8 THEN strftime(order_date, '%-d-%b-%y')
    WHEN order_id % 11 = 9 THEN strftime(order_date, '%A, %B %-d, %Y') WHEN order_id % 11 = 10 THEN strftime(order_date, '%m/%d/%y') ELSE CAST(order_date AS VARCHAR) END AS date,
  CASE WHEN order_id % 5 = 0 THEN '' WHEN order_id % 13 = 1 THEN hour || ':15:00' WHEN order_id % 13 = 2 THEN {HH} || ':15'
    WHEN order_id % 13 = 3 THEN ((hour + 11) % 12 + 1) || ':15 ' || CASE WHEN hour < 12 THEN 'AM' ELSE 'PM' END ELSE {HH} || ':15:00' END AS time,
  CASE WHEN order_id % 10 = 0 THEN '' WHEN order_id % 10 = 5 THEN 'evening' WHEN order_id % 10 = 7 THEN 'NULL' ELSE {period('hour')} END AS time_period,
  CASE WHEN order_id % 3 = 0 THEN 'nan' ELSE {season_met('order_date')} END AS season,
  CASE WHEN order_id % 4 = 1 THEN 'None' WHEN order_id % 4 > 1 THEN 'Fair' END AS occasion
FROM sales""")
block("raw_timed", """
SELECT *, CASE WHEN time <> '' THEN time ELSE CASE lower(time_period) WHEN 'morning' THEN '10:00:00' WHEN 'afternoon' THEN '14:00:00'
  WHEN 'evening' THEN '18:00:00' WHEN 'night' THEN '22:00:00' ELSE '12:00:00' END END AS clean_time FROM raw_fields""")
# the moment comes from the values the texts were written from, not from parsing them
block("normal_rows", f"""
SELECT user_id, is_imputed, 'u' || user_id || ':' || trim(coalesce(order_reference, '')) AS order_reference, coalesce(trim(sku), 'nan') AS sku,
  CASE WHEN order_id % 97 = 0 THEN 0 WHEN order_id % 89 = 0 THEN -1 WHEN order_id % 83 = 0 OR order_id % 79 = 0 THEN 0
    WHEN order_id % 73 = 0 THEN 1000000000000 ELSE CAST(split_part(quantity, '.', 1) AS BIGINT) END AS quantity,
  CASE WHEN order_id % 101 = 0 OR order_id % 83 = 1 THEN 0e0 ELSE CAST(unit_price AS DOUBLE) END AS unit_price, CAST(unit_cost AS DOUBLE) AS unit_cost,
  category_en, trim(name_en) AS name_en, season, occasion, time_period,
  CASE WHEN order_id % 103 <> 0 THEN strptime(CAST(order_date AS VARCHAR) || ' ' || CASE WHEN time = '' THEN clean_time ELSE {HH} || ':15:00' END, '%Y-%m-%d %H:%M:%S') END AS order_datetime,
  coalesce(lower(trim(time_period)) IN ('', 'nan', 'none', 'null'), true) AS b_tp,
  coalesce(lower(trim(season)) IN ('', 'nan', 'none', 'null'), true) AS b_se,
  coalesce(lower(trim(occasion)) IN ('', 'nan', 'none', 'null'), true) AS b_oc
FROM raw_timed""")
block("clean_rows", f"""
SELECT n.* EXCLUDE (season, occasion, time_period),
  CASE WHEN b_tp THEN {period('hour(order_datetime)')} ELSE time_period END AS time_period,
  CASE WHEN b_se THEN {season_met('order_datetime')} ELSE n.season END AS season,
  CASE WHEN b_oc THEN c.occasion ELSE n.occasion END AS occasion,
  coalesce(n.order_reference <> '' AND sku <> '' AND quantity > 0 AND order_datetime IS NOT NULL, false) AS ok
FROM normal_rows n LEFT JOIN cal c ON c.ds = CAST(n.order_datetime AS DATE)""")
block("lines", """
SELECT 'u' || user_id || ':' || order_id AS order_reference, order_date, product, category, quantity, price_cents, 'first' AS file FROM sales""")
block("lines_new", "SELECT * REPLACE ('second' AS file) FROM lines WHERE year(order_date) >= 1998")
block("star_orders", """
SELECT CAST(o.o_orderkey AS BIGINT) AS order_id, CAST(year(o.o_orderdate) * 100 + c.c_nationkey AS BIGINT) AS upload_id,
  CAST(o.o_orderdate AS DATE) AS order_date, o.o_orderstatus = 'P' AS is_imputed FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
block("star_uploads", "SELECT upload_id, CAST(upload_id % 100 AS INTEGER) AS user_id, max(order_date) AS uploaded_at FROM star_orders GROUP BY upload_id")
block("star_items", """
SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(l_partkey AS BIGINT) AS product_id, l_linenumber AS line_no, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS unit FROM lineitem""")
block("star_products", """
SELECT CAST(p_partkey AS BIGINT) AS product_id, CASE p_type WHEN 'ECONOMY' THEN 'Espresso Drinks' WHEN 'SMALL' THEN 'Sweets' WHEN 'MEDIUM' THEN 'Cold Drinks'
  WHEN 'LARGE' THEN 'Hot Sweets' WHEN 'PROMO' THEN 'Dripp Coffee Drinks' ELSE 'Gadgets' END AS category FROM part""")
block("report_kpi", f"""
SELECT user_id, {big('sum(quantity * price_cents)')} AS revenue, {big('sum(quantity)')} AS units, count(DISTINCT order_id) AS orders, count(DISTINCT order_date) AS days FROM real_sales GROUP BY user_id""")
block("kpi_rev", f"SELECT user_id, {big('sum(quantity * price_cents)')} AS rev FROM real_sales GROUP BY user_id")


def counts(where: str, name: str = "rows") -> str:
    """Table sizes when only uploads matching ``where`` count."""
    o = f"SELECT order_id FROM star_orders WHERE {where}"
    p = f"SELECT * FROM star_products WHERE product_id IN (SELECT product_id FROM star_items WHERE order_id IN ({o}))"
    return f"""SELECT 'uploads' AS "table", count(*) AS {name} FROM star_uploads WHERE {where}
      UNION ALL SELECT 'orders', count(*) FROM star_orders WHERE {where}
      UNION ALL SELECT 'order_items', count(*) FROM star_items WHERE order_id IN ({o})
      UNION ALL SELECT 'products', count(*) FROM ({p}) UNION ALL SELECT 'categories', count(DISTINCT category) FROM ({p})"""


BASE = "user_id, order_reference, sku"
SQL = {
    # a CSV cell loses the blanks around it and, when empty, its value
    "src_csv": "SELECT nullif(trim(order_reference), '') AS order_reference, sku, quantity, unit_price, unit_cost, category_en, trim(name_en) AS name_en, season, occasion, nullif(time_period, '') AS time_period, date, nullif(time, '') AS time, user_id, is_imputed FROM raw_fields",
    "ing_upsert_dims": """SELECT DISTINCT product AS sku, 'first ' || product AS name_en, category FROM lines WHERE year(order_date) <= 1998
        UNION ALL SELECT product, left(min('second ' || product), 100), min(category) FROM lines_new
        WHERE product NOT IN (SELECT product FROM lines WHERE year(order_date) <= 1998) GROUP BY product""",
    "ing_upsert_orders": """SELECT DISTINCT order_reference, order_date, CASE WHEN year(order_date) >= 1998 THEN 'second' ELSE 'first' END AS file FROM lines""",
    "ing_replace_items": """SELECT order_reference, order_date, product, category, CASE WHEN year(order_date) >= 1998 THEN quantity + 1 ELSE quantity END AS quantity,
        price_cents, CASE WHEN year(order_date) >= 1998 THEN 'second' ELSE 'first' END AS file FROM lines""",
    "ing_resolve_fk": """SELECT i.* FROM star_items i JOIN star_orders o USING (order_id) JOIN star_products p USING (product_id)
        WHERE NOT o.is_imputed AND p.category <> 'Gadgets'""",
    "ing_replace_all": f"""SELECT w."table", w.wiped, k.kept, i.imported FROM ({counts(f'upload_id % 100 = {CLEARED_USER}', 'wiped')}) w
        JOIN ({counts(f'upload_id % 100 <> {CLEARED_USER}', 'kept')}) k USING ("table")
        JOIN ({counts(f'(upload_id % 100 <> {CLEARED_USER} OR upload_id = (SELECT max(upload_id) FROM star_uploads WHERE user_id = {CLEARED_USER}))', 'imported')}) i USING ("table")
        UNION ALL SELECT 'forecasts', count(*) FILTER (user_id = {CLEARED_USER}), count(*) FILTER (user_id <> {CLEARED_USER}), count(*) FILTER (user_id <> {CLEARED_USER}) FROM star_uploads""",
    "ing_summary": """SELECT user_id, count(*) AS rows_in_file, count(*) FILTER (ok) AS rows_imported, count(*) FILTER (NOT ok) AS rows_skipped,
        count(*) FILTER (b_tp) AS filled_time_period, count(*) FILTER (b_se) AS filled_season, count(*) FILTER (b_oc) AS filled_occasion FROM clean_rows GROUP BY user_id""",
    "tbl_upload_history": f"""SELECT u.upload_id, u.user_id, 'sales_' || u.upload_id || '.csv' AS filename, u.uploaded_at,
        (SELECT count(*) FROM star_orders o WHERE o.upload_id = u.upload_id) AS orders, coalesce(s.items, 0) AS items, coalesce(s.cents, 0) / 1e2 AS revenue
        FROM star_uploads u LEFT JOIN (SELECT upload_id, count(*) AS items, {big('sum(quantity * unit * 100)')} AS cents
            FROM star_items JOIN star_orders USING (order_id) GROUP BY upload_id) s USING (upload_id)""",
    "tbl_delete_upload": counts(f"upload_id <> {GONE_UPLOAD}"),
    "tbl_clear": counts(f"upload_id % 100 <> {CLEARED_USER}"),
    "tbl_orphan_uploads": """SELECT upload_id, user_id FROM star_uploads u
        WHERE NOT EXISTS (SELECT 1 FROM star_orders o WHERE o.upload_id = u.upload_id AND o.upload_id % 10 <> 3)""",
    "tbl_quality_counts": """SELECT 'uploads' AS metric, count(*) AS n FROM star_uploads UNION ALL SELECT 'orders', count(*) FROM star_orders
        UNION ALL SELECT 'imputed_orders', count(*) FILTER (is_imputed) FROM star_orders UNION ALL SELECT 'real_orders', count(*) FILTER (NOT is_imputed) FROM star_orders
        UNION ALL SELECT 'items', count(*) FROM star_items UNION ALL SELECT 'users', count(*) FROM nation""",
    "ing_seed_refs": """SELECT user_id, is_imputed, synthetic, count(*) AS rows, CASE WHEN synthetic THEN count(*) ELSE count(DISTINCT order_id) END AS "references"
        FROM (SELECT *, is_imputed OR order_id % 107 = 3 OR order_id % 109 = 4 AS synthetic FROM sales) GROUP BY user_id, is_imputed, synthetic""",
    "ing_stream": "SELECT order_reference, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units FROM clean_rows WHERE ok GROUP BY order_reference",
    "sink_signature": f"SELECT user_id, CAST(max(year(order_date) * 100 + user_id) AS BIGINT) AS upload_id, count(*) AS item_count, '{MODEL_VERSION}' AS model_version FROM sales GROUP BY user_id",
    "sink_report_csv": """SELECT user_id, 'kpi' AS section, CAST(1 AS BIGINT) AS row_no, x.key, CAST(x.value AS VARCHAR) AS value
        FROM report_kpi, LATERAL (VALUES ('revenue_cents', revenue), ('orders', orders), ('units', units), ('open_days', days)) AS x(key, value)
        UNION ALL SELECT 0, 'chain', 1, x.key, CAST(x.value AS VARCHAR) FROM (SELECT CAST(sum(revenue) AS BIGINT) AS revenue, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(units) AS BIGINT) AS units, count(*) AS n FROM report_kpi),
          LATERAL (VALUES ('revenue_cents', revenue), ('orders', orders), ('units', units), ('workspaces', n)) AS x(key, value)
        UNION ALL SELECT user_id, 'trend', CAST(replace(month, '-', '') AS BIGINT), month, CAST(rev AS VARCHAR) FROM monthly
        UNION ALL SELECT user_id, 'categories', 1, category, CAST(CAST(sum(quantity * price_cents) AS BIGINT) AS VARCHAR) FROM real_sales GROUP BY user_id, category
        UNION ALL SELECT user_id, 'items', row_number() OVER (PARTITION BY user_id ORDER BY rev DESC, product), product, CAST(rev AS VARCHAR) FROM product_rev""",
    "cln_order_ref": "SELECT user_id, order_reference FROM clean_rows",
    "cln_fallbacks": "SELECT user_id, name_en AS sku, name_en, name_en AS name_ar, category_en, category_en AS category_ar FROM normal_rows",
    "cln_numeric": f"SELECT {BASE}, quantity, unit_price, unit_cost FROM clean_rows",
    "cln_datetime": f"SELECT {BASE}, order_datetime FROM clean_rows",
    "cln_time_fallback": "SELECT user_id, time, time_period, clean_time FROM raw_timed",
    "cln_blank": "SELECT user_id, season, occasion, time_period, b_se AS blank_season, b_oc AS blank_occasion, b_tp AS blank_time_period FROM normal_rows",
    "enr_time_period": f"SELECT {BASE}, order_datetime, time_period FROM clean_rows",
    "enr_season_met": f"SELECT {BASE}, order_datetime, season FROM clean_rows",
    "enr_occasion": f"SELECT {BASE}, order_datetime, occasion FROM clean_rows",
    "cln_valid_rows": f"SELECT {BASE}, quantity, unit_price, order_datetime FROM clean_rows WHERE ok",
    "cln_dedup_orders": """SELECT user_id, order_reference, order_datetime, time_period, season, occasion FROM clean_rows WHERE ok
        QUALIFY row_number() OVER (PARTITION BY user_id, order_reference ORDER BY order_datetime, time_period, season, occasion) = 1""",
}

ORACLES = {key: query(sql) for key, sql in SQL.items()}
