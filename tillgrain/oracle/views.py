"""SQL checks of the prediction views."""

from __future__ import annotations

from tillgrain.functions import labels
from tillgrain.oracle import forecast  # noqa: F401  (blocks)
from tillgrain.oracle.base import big, block, dow, period, query, r, season_met, uavg, usum, whole
from tillgrain.oracle.forecast import cell, cell_totals, on_slot, rounded, wide_grid
from tillgrain.plans.params import AS_OF, PERIOD

block("win", f"""
SELECT g.* FROM service g JOIN data_ends e USING (user_id)
WHERE g.ds BETWEEN greatest(e.data_end, DATE '{AS_OF}') + 1 AND greatest(e.data_end, DATE '{AS_OF}') + {PERIOD}""", stored=True)
# the dense table of slots, products and periods with prices
block("priced_cells", """
SELECT c.*, i.category, coalesce(i.price, 0e0) AS price, coalesce(i.price, 0e0) - coalesce(i.cost, 0e0) AS unit_profit
FROM slot_norm c LEFT JOIN all_items i USING (user_id, product)""")


def slot_sums(name: str, extra: str, values: dict[str, str], days: str = "win") -> None:
    """Block of daily sums over the cells, per day and ``extra``."""
    e = f", {extra}" if extra else ""
    sums = ", ".join(f"sum(nf * {v}) AS {n}" for n, v in values.items())
    cols = ", ".join(f"{cell(f'd.yhat * s.{n}')} AS {n}" for n in values)
    block(f"{name}_slots", f"SELECT user_id, season, dow{e}, {sums} FROM priced_cells GROUP BY ALL")
    block(name, f"SELECT d.user_id, d.ds{''.join(f', s.{x.strip()}' for x in extra.split(',') if x)}, {cols} FROM {days} d JOIN {name}_slots s ON {on_slot('d', 's')}", stored=True)


slot_sums("menu_money", "", {"revenue": "price", "profit": "unit_profit"})
slot_sums("cat_money", "category", {"yhat": "1e0", "revenue": "price"})
slot_sums("period_days", "time_period", {"yhat": "1e0"})
slot_sums("cat_period_days", "category, time_period", {"yhat": "1e0"})
block("item_slots", "SELECT user_id, season, dow, product, category, price, sum(nf) AS share FROM priced_cells GROUP BY ALL", stored=True)
block("item_days_raw", f"""
SELECT user_id, product, category, ds, yhat, {r('yhat * price')} AS revenue FROM (
  SELECT d.user_id, s.product, s.category, d.ds, {cell('d.yhat * s.share')} AS yhat, s.price FROM win d JOIN item_slots s ON {on_slot('d', 's')})""")
block("cat_days_raw", f"SELECT user_id, category, ds, yhat, {r('revenue')} AS revenue FROM cat_money")
block("menu_days_raw", f"SELECT d.user_id, d.ds, d.yhat, {r('m.revenue')} AS revenue FROM win d JOIN menu_money m USING (user_id, ds)")
for name, keys in (("item_days", "user_id, product"), ("cat_days", "user_id, category"), ("menu_days", "user_id")):
    block(name, f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY units DESC, ds) = 1 AS is_peak FROM ({rounded(f'{name}_raw', keys)})")
block("win_cells", cell_totals("win", "slot_"), stored=True)
block("prod_totals", f"""
SELECT user_id, i.category, product, total FROM (SELECT user_id, product, {usum('total')} AS total FROM win_cells GROUP BY ALL) LEFT JOIN all_items i USING (user_id, product)""")
block("prod_hist", f"""
SELECT p.*, coalesce(h.q, 0) AS history FROM prod_totals p
LEFT JOIN (SELECT user_id, product, {big('sum(quantity)')} AS q FROM real_sales GROUP BY ALL) h USING (user_id, product)""")
block("hour_shares", f"""
SELECT *, n / CAST(sum(n) OVER (PARTITION BY user_id, dow, time_period) AS DOUBLE) AS hs FROM (
  SELECT user_id, {dow('order_date')} AS dow, {period('hour')} AS time_period, hour, {big('sum(quantity)')} AS n FROM real_sales GROUP BY ALL)""")


def heat(name: str, days: str, extra: str = "") -> None:
    """Blocks of the forecast heat of a table of days and periods."""
    e, eq = (f", {extra}", f" AND o.{extra} = s.{extra}") if extra else ("", "")
    se = f", s.{extra}" if extra else ""
    block(f"{name}_slots", f"""
SELECT s.user_id{se}, s.dow, s.time_period, {usum('s.yhat')} AS units, o.n_days FROM (
  SELECT user_id{e}, ds, {dow('ds')} AS dow, time_period, CASE WHEN c.occasion = 'Ramadan' AND time_period IN ('morning', 'Afternoon') THEN 0e0 ELSE yhat END AS yhat
  FROM {days} JOIN cal c USING (ds)) s
JOIN (SELECT user_id{e}, {dow('ds')} AS dow, count(DISTINCT ds) AS n_days FROM {days} GROUP BY ALL) o ON o.user_id = s.user_id AND o.dow = s.dow{eq}
GROUP BY s.user_id{se}, s.dow, s.time_period, o.n_days""")
    block(name, f"""
SELECT u.*, CAST(w.dow AS INTEGER) AS dow, w.day, CAST(h.hour AS INTEGER) AS hour, h.hour_ord, coalesce(x.v, 0e0) AS v
FROM (SELECT DISTINCT user_id{e} FROM {days}) u CROSS JOIN weekdays w CROSS JOIN hours h
LEFT JOIN (SELECT s.user_id{se}, s.dow, k.hour, {usum('s.units / s.n_days * k.hs')} AS v FROM {name}_slots s JOIN hour_shares k USING (user_id, dow, time_period) GROUP BY ALL) x
  ON x.user_id = u.user_id AND x.dow = w.dow AND x.hour = h.hour{f' AND x.{extra} = u.{extra}' if extra else ''}""")


heat("fc_heat", "period_days")
heat("fc_cat_heat", "cat_period_days", "category")
block("seas_rows", f"""
SELECT user_id, product, season, q, sum(q) OVER (PARTITION BY user_id, product) AS total, o.ord,
  row_number() OVER (PARTITION BY user_id, product ORDER BY q DESC, season) AS rn
FROM (SELECT user_id, product, {season_met('order_date')} AS season, {big('sum(quantity)')} AS q FROM sales GROUP BY ALL) JOIN seasons o USING (season)""")


def view(name: str, keys: str) -> str:
    b = lambda c: f"{whole(f'greatest(0e0, {c} - abs({c}) * (std / mean) * 1.282e0)')} AS {c}_low, {whole(f'{c} + abs({c}) * (std / mean) * 1.282e0')} AS {c}_high"
    return f"SELECT {keys}, ds, units, {b('units')}, revenue, {b('revenue')}, is_peak FROM {name} JOIN res_stats USING (user_id)"


HOUR = "CASE WHEN hour % 12 = 0 THEN '12' ELSE CAST(hour % 12 AS VARCHAR) END || CASE WHEN hour < 12 THEN 'AM' ELSE 'PM' END"
SQL = {
    "fc_revenue_profit": f"SELECT user_id, {r(usum('revenue', 4))} AS revenue, {r(usum('profit', 4))} AS profit FROM menu_money GROUP BY user_id",
    "fc_daily_revenue": "SELECT user_id, ds, revenue FROM menu_days_raw",
    "fc_heatmap": f"SELECT user_id, dow, day, hour, {HOUR} AS hour_label, {whole('v')} AS value FROM fc_heat",
    "fc_category_heatmap": f"SELECT user_id, category, dow, day, hour, {HOUR} AS hour_label, {whole('v')} AS value FROM fc_cat_heat",
    "fc_heatmap_peak": f"""SELECT p.user_id, p.day, p.hour, {whole('p.v')} AS value, {whole('(p.v - m.mean) / m.mean * 1e2')} AS vs_average
        FROM (SELECT * FROM fc_heat QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, dow, hour_ord) = 1) p
        JOIN (SELECT user_id, {uavg('v')} AS mean FROM fc_heat WHERE v > 0 GROUP BY user_id) m USING (user_id)""",
    "fc_item": view("item_days", "user_id, product"),
    "fc_time_of_day_available": f"SELECT user_id, count(DISTINCT lower({period('hour')})) >= 2 AS available FROM sales GROUP BY user_id",
    "fc_period_totals": f"SELECT user_id, product, time_period, {whole('total')} AS units FROM win_cells",
    "fc_period_breakdown": f"SELECT user_id, product, ds, {', '.join(f'CAST(trunc({x}) AS INTEGER) AS {x}' for x in labels.PERIODS)} FROM ({wide_grid('win', 'slot_')})",
    "fc_category": view("cat_days", "user_id, category"),
    "fc_category_items": "SELECT user_id, category, product, CAST(trunc(total) AS BIGINT) AS units FROM prod_totals",
    "fc_total": f"SELECT user_id, category, CAST(trunc({usum('total')}) AS BIGINT) AS units, count(*) AS item_count FROM prod_totals GROUP BY ALL",
    "fc_total_daily": view("menu_days", "user_id"),
    "fc_top_items": """SELECT user_id, product, category, CAST(trunc(total) AS BIGINT) AS units, history,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY total DESC, product) AS INTEGER) AS place FROM prod_hist QUALIFY place <= 5""",
    "fc_bottom_items": """SELECT user_id, product, category, CAST(trunc(total) AS BIGINT) AS units, history,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY total, product DESC) AS INTEGER) AS place FROM prod_hist WHERE total >= 1 AND history >= 30 QUALIFY place <= 5""",
    "fc_peak_day": "SELECT user_id, ds, units FROM menu_days WHERE is_peak",
    "fc_seasonality": f"""SELECT user_id, product, CASE WHEN one >= 70 THEN s1 WHEN o1 < o2 THEN s1 || '–' || s2 ELSE s2 || '–' || s1 END AS peak_seasons,
        {r('CASE WHEN one >= 70 THEN one ELSE two END', 1)} AS concentration_pct FROM (
        SELECT a.user_id, a.product, a.season AS s1, b.season AS s2, a.ord AS o1, b.ord AS o2, CAST(a.q AS DOUBLE) / CAST(a.total AS DOUBLE) * 1e2 AS one,
          CAST(a.q + b.q AS DOUBLE) / CAST(a.total AS DOUBLE) * 1e2 AS two
        FROM (SELECT * FROM seas_rows WHERE rn = 1) a LEFT JOIN (SELECT * FROM seas_rows WHERE rn = 2) b USING (user_id, product))
        WHERE one >= 70 OR (two >= 70 AND abs(o1 - o2) IN (1, 3))""",
    "fc_tips": """SELECT user_id, unnest(list_filter(CASE WHEN a < 0.5e0 THEN ['low_demand'] ELSE [CASE WHEN pk >= 20 THEN 'peak_high' WHEN pk >= 5 THEN 'peak_mid' ELSE 'peak_low' END,
          CASE WHEN a >= 1 AND ra THEN 'ramadan' END, CASE WHEN a >= 1 AND eid THEN 'eid' END, CASE WHEN a >= 1 AND nat THEN 'national_day' END,
          CASE WHEN we >= 2 AND a >= 3 THEN 'weekends' END] END, lambda x: x IS NOT NULL)) AS tip FROM (
        SELECT m.user_id, sum(units) / count(*) AS a, max(units) AS pk, bool_or(occasion = 'Ramadan') AS ra, bool_or(occasion LIKE 'Eid%') AS eid,
          bool_or(occasion = 'Saudi National Day') AS nat, count(*) FILTER (occasion = 'Weekend') AS we FROM menu_days m JOIN cal c USING (ds) GROUP BY m.user_id)""",
    "fc_summary": f"""SELECT user_id, {r(uavg('yhat'))} AS avg_predicted, max(CASE WHEN hi = 1 THEN ds END) AS peak_ds, max(CASE WHEN lo = 1 THEN ds END) AS low_ds,
        {r('max(yhat)')} AS highest, {r('min(yhat)')} AS lowest,
        {r(uavg('CASE WHEN isodow(ds) IN (5, 6) THEN yhat END') + ' / ' + uavg('CASE WHEN isodow(ds) NOT IN (5, 6) THEN yhat END') + ' * 1e2 - 1e2', 1)} AS weekend_lift,
        CASE WHEN {uavg('CASE WHEN NOT early THEN yhat END')} > {uavg('CASE WHEN early THEN yhat END')} THEN 'up'
             WHEN {uavg('CASE WHEN NOT early THEN yhat END')} < {uavg('CASE WHEN early THEN yhat END')} THEN 'down' ELSE 'flat' END AS trend,
        {', '.join(f"{r(uavg(f'CASE WHEN isodow(ds) = {i + 1} THEN yhat END'))} AS avg_{n.lower()}" for i, n in enumerate(labels.WEEKDAYS))}
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY yhat DESC, ds) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY yhat, ds) AS lo,
              row_number() OVER (PARTITION BY user_id ORDER BY ds) <= count(*) OVER (PARTITION BY user_id) / 2 AS early FROM menu_days_raw) GROUP BY user_id""",
}
SQL["fc_breakdown"] = f"""SELECT p.user_id, p.category, CAST(trunc(p.t) AS BIGINT) AS units, p.n AS item_count, {r('(p.t - b.q) / nullif(CAST(b.q AS DOUBLE), 0) * 1e2', 1)} AS change_pct
    FROM (SELECT user_id, category, {usum('total')} AS t, count(*) AS n FROM prod_totals GROUP BY ALL) p
    LEFT JOIN (SELECT s.user_id, s.category, {big('sum(s.quantity)')} AS q FROM real_sales s JOIN (SELECT user_id, max(order_date) AS e FROM real_sales GROUP BY user_id) x USING (user_id)
      JOIN (SELECT user_id, count(*) AS n FROM win GROUP BY user_id) w USING (user_id) WHERE s.order_date > x.e - CAST(w.n AS INTEGER) GROUP BY ALL) b USING (user_id, category)"""

ORACLES = {key: query(sql) for key, sql in SQL.items()}
