"""SQL checks of the imputation."""

from __future__ import annotations

from tillgrain.operators.calendar import WMO_CODES
from tillgrain.operators.impute import SPAN_DAYS
from tillgrain.oracle.base import big, block, dow, literal_rows, period, query, r, season_met, whole
from tillgrain.oracle import dashboard  # noqa: F401  (blocks)

block("real_span", f"""
SELECT user_id, unnest(generate_series(greatest(min(order_date), max(order_date) - {SPAN_DAYS - 1}), max(order_date), INTERVAL 1 DAY))::DATE AS ds FROM real_sales GROUP BY user_id""")
block("gap_days", f"""
SELECT user_id, ds, CASE WHEN month(ds) = 3 THEN 'Planned Closure' ELSE 'Missing Data' END AS imputation_type,
  CASE WHEN isodow(ds) IN (5, 6) THEN 'Weekend' ELSE 'Normal Day' END AS occasion, {season_met('ds')} AS season, {dow('ds')} AS dow
FROM real_span s WHERE NOT EXISTS (SELECT 1 FROM real_sales x WHERE x.user_id = s.user_id AND x.order_date = s.ds)""", stored=True)
block("imp_base_rows", f"""
SELECT s.user_id, s.order_date AS ds, s.product, {period('s.hour')} AS time_period, c.occasion, c.season_met AS season, c.dow, s.price_cents, s.cost_cents, {big('sum(s.quantity)')} AS quantity
FROM real_sales s JOIN cal c ON c.ds = s.order_date GROUP BY ALL""", stored=True)
KEY = "user_id, product, time_period, occasion, dow"
# only days of a kind that the cell has seen can be filled
block("gap_grid", f"SELECT p.product, p.time_period, g.* FROM (SELECT DISTINCT {KEY} FROM imp_base_rows) p JOIN gap_days g USING (user_id, occasion, dow)")


def near_rows(order: str) -> str:
    """One history row per cell and day, for the searches of the nearest day."""
    return f"""(SELECT {KEY}, ds, quantity FROM imp_base_rows QUALIFY row_number() OVER (PARTITION BY {KEY}, ds ORDER BY price_cents{order}, cost_cents{order}) = 1)"""


SAME_CELL = " AND ".join(f"{{0}}.{k.strip()} = g.{k.strip()}" for k in KEY.split(","))
block("gap_hits", f"""
SELECT g.*, b.quantity AS qty_before, a.quantity AS qty_after FROM gap_grid g
ASOF LEFT JOIN {near_rows(' DESC')} b ON {SAME_CELL.format('b')} AND g.ds > b.ds
ASOF LEFT JOIN {near_rows('')} a ON {SAME_CELL.format('a')} AND g.ds < a.ds
WHERE b.quantity IS NOT NULL OR a.quantity IS NOT NULL""")
block("gap_filled", f"""
SELECT *, coalesce({whole('(qty_before + qty_after) / 2e0')}, qty_before, qty_after) AS quantity FROM gap_hits""", stored=True)
block("latest_prices", """
SELECT user_id, product, price_cents, cost_cents FROM imp_base_rows
QUALIFY row_number() OVER (PARTITION BY user_id, product ORDER BY ds DESC, time_period DESC, occasion DESC, season DESC, dayname(ds) DESC, price_cents DESC, cost_cents DESC) = 1""")
block("wmo", literal_rows(WMO_CODES, "code, text"))
block("full_weather", """
SELECT ds, temp_max, temp_max - 11e0 AS temp_min, CASE WHEN weather_code >= 51 THEN (day(ds) % 5) / 2e0 ELSE 0e0 END AS precipitation,
  CAST(day(ds) % 9 + 5 AS DOUBLE) AS windspeed, coalesce(text, 'Code ' || weather_code) AS weather_condition FROM weather LEFT JOIN wmo ON code = weather_code""")
NAMES = "split_part(product, '#', 2) AS sku, product AS name_en, product AS name_ar, category, category AS category_ar"
TOTALS = f"price_cents / 1e2 AS unit_price, cost_cents / 1e2 AS unit_cost, {r('quantity * (price_cents / 1e2)')} AS total_price, {r('quantity * (cost_cents / 1e2)', 4)} AS total_cost"
WEATHER = "temp_max, temp_min, precipitation, windspeed, weather_condition"
block("imp_made", f"""
SELECT f.user_id, f.ds, f.product, {NAMES}, f.time_period, f.occasion, f.season, f.dow, f.quantity, {TOTALS}, {WEATHER}, true AS is_imputed, f.imputation_type
FROM gap_filled f JOIN latest_prices p USING (user_id, product) JOIN (SELECT user_id, product, min(category) AS category FROM real_sales GROUP BY ALL) k USING (user_id, product)
LEFT JOIN full_weather w ON w.ds = f.ds""")
block("imp_all", f"""
SELECT user_id, order_date AS ds, product, {NAMES}, {period('hour')} AS time_period, c.occasion, c.season_met AS season, c.dow, quantity, {TOTALS},
  CAST(NULL AS DOUBLE) AS temp_max, CAST(NULL AS DOUBLE) AS temp_min, CAST(NULL AS DOUBLE) AS precipitation, CAST(NULL AS DOUBLE) AS windspeed, CAST(NULL AS VARCHAR) AS weather_condition,
  false AS is_imputed, 'Original' AS imputation_type FROM real_sales s JOIN cal c ON c.ds = s.order_date
UNION ALL SELECT * FROM imp_made""")
block("grid_rows", """
SELECT g.*, p.n AS products, p.n * 4 AS cells FROM gap_days g JOIN (SELECT user_id, count(DISTINCT product) AS n FROM real_sales GROUP BY user_id) p USING (user_id)""")

SQL = {
    "imp_missing_days": "SELECT user_id, ds, imputation_type FROM gap_days",
    "imp_base": "SELECT * FROM imp_base_rows",
    "imp_grid": "SELECT * FROM grid_rows",
    "imp_neighbours": f"SELECT ds, imputation_type, {KEY}, season, qty_before, qty_after, quantity FROM gap_filled",
    "imp_last_price": "SELECT * FROM latest_prices",
    "imp_rows": "SELECT * FROM imp_made",
    "imp_union": "SELECT * FROM imp_all",
    "imp_quality": """SELECT a.*, coalesce(g.cells, 0) - a.imputed_rows AS skipped FROM (
        SELECT user_id, count(*) AS total_rows, count(*) FILTER (NOT is_imputed) AS original_rows, count(*) FILTER (is_imputed) AS imputed_rows,
          count(DISTINCT ds) AS unique_days, count(*) FILTER (quantity IS NULL) AS null_quantity, count(*) FILTER (temp_max IS NULL) AS null_temp,
          count(*) FILTER (abs(total_price - quantity * unit_price) > 0.01e0) AS price_mismatch FROM imp_all GROUP BY user_id) a
        LEFT JOIN (SELECT user_id, CAST(sum(cells) AS BIGINT) AS cells FROM grid_rows GROUP BY user_id) g USING (user_id)""",
}

ORACLES = {key: query(sql) for key, sql in SQL.items()}
