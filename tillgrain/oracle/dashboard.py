"""SQL checks of the sources, dashboard and calendar operators."""

from __future__ import annotations

from tillgrain.oracle.base import big, block, dow, pct, query, r
from tillgrain.plans.params import AS_OF

block("per_order", f"""
SELECT user_id, order_date, order_id, {big('sum(quantity * price_cents)')} AS rev, {big('sum(quantity)')} AS units
FROM real_sales GROUP BY ALL""")
block("daily_rev", f"""
SELECT user_id, order_date, {big('sum(rev)')} AS rev, count(*) AS orders, {big('sum(units)')} AS units
FROM per_order GROUP BY ALL""")
block("win30", """
SELECT o.*, b.first_ds, b.last_ds,
       o.order_date >= b.last_ds - 29 AS cur,
       o.order_date BETWEEN b.last_ds - 59 AND b.last_ds - 30 AS prev
FROM per_order o JOIN (SELECT user_id, min(order_date) AS first_ds, max(order_date) AS last_ds
                       FROM per_order GROUP BY user_id) b USING (user_id)""")
block("win30_agg", f"""
SELECT user_id, first_ds, last_ds,
  {big('sum(CASE WHEN cur THEN rev ELSE 0 END)')} AS cur_rev, {big('sum(CASE WHEN prev THEN rev ELSE 0 END)')} AS prev_rev,
  count(*) FILTER (cur) AS cur_orders, count(*) FILTER (prev) AS prev_orders,
  min(CASE WHEN prev THEN order_date END) AS prev_first,
  coalesce({r('sum(CASE WHEN cur THEN rev ELSE 0 END) / 1e2 / nullif(count(*) FILTER (cur), 0)')}, 0e0) AS cur_aov,
  coalesce({r('sum(CASE WHEN prev THEN rev ELSE 0 END) / 1e2 / nullif(count(*) FILTER (prev), 0)')}, 0e0) AS prev_aov
FROM win30 GROUP BY ALL""")
block("product_rev", f"""
SELECT user_id, product, min(category) AS category, {big('sum(quantity * price_cents)')} AS rev, {big('sum(quantity)')} AS qty
FROM real_sales GROUP BY user_id, product""")
block("monthly", f"""
SELECT user_id, strftime(order_date, '%Y-%m') AS month, {big('sum(quantity * price_cents)')} AS rev
FROM real_sales GROUP BY ALL""")
block("monthly_growth", f"""
SELECT user_id, month, rev / 1e2 AS revenue,
  coalesce({pct('lag(rev) OVER (PARTITION BY user_id ORDER BY month)', 'rev')}, 0e0) AS growth FROM monthly""")
block("heat", f"""
SELECT u.user_id, CAST(w.dow AS INTEGER) AS dow, w.day, CAST(h.hour AS INTEGER) AS hour,
  CASE WHEN h.hour % 12 = 0 THEN '12' ELSE CAST(h.hour % 12 AS VARCHAR) END || CASE WHEN h.hour < 12 THEN 'AM' ELSE 'PM' END AS hour_label,
  coalesce(s.n, 0) AS value
FROM (SELECT DISTINCT user_id FROM real_sales) u CROSS JOIN weekdays w CROSS JOIN hours h
LEFT JOIN (SELECT user_id, {dow('order_date')} AS dow, hour, count(*) AS n FROM real_sales GROUP BY ALL) s
  ON s.user_id = u.user_id AND s.dow = w.dow AND s.hour = h.hour""")
block("range_rows", f"""
SELECT user_id, min(order_date) AS earliest, max(order_date) AS latest,
  CAST(date_diff('day', min(order_date), max(order_date)) + 1 AS BIGINT) AS total_days,
  count(*) AS total_rows, count(DISTINCT order_id) AS unique_orders FROM sales GROUP BY user_id""")
block("data_range", f"""
SELECT user_id, earliest, latest, total_days, total_rows, unique_orders,
  CAST(greatest(DATE '{AS_OF}', latest) + 1 AS DATE) AS forecast_start,
  CAST(greatest(DATE '{AS_OF}', latest) + 1 + CAST(greatest(1825, total_days * 5) AS INTEGER) AS DATE) AS forecast_end_max,
  greatest(1825, total_days * 5) AS forecast_max_days,
  greatest(7, CAST(floor(total_days * 0.3e0) AS BIGINT)) AS reliable_days, total_days AS directional_days
FROM range_rows""")
block("occ_days", "SELECT d.user_id, d.order_date AS ds, d.rev, c.occasion FROM daily_rev d JOIN cal c ON c.ds = d.order_date")
block("holiday_events", f"""
SELECT holiday, CAST(ds + shift AS DATE) AS ds, 0 AS lower_window, upper_window FROM (
  SELECT c.ds, e.* FROM (SELECT unnest(generate_series(a - 35, b + 35, INTERVAL 1 DAY))::DATE AS ds
        FROM (SELECT min(order_date) AS a, max(order_date) AS b FROM sales)) s JOIN cal c USING (ds)
  JOIN (VALUES ('ramadan', 9, 1, 0, 0, 0, 28), ('eid_fitr_day1', 10, 1, 0, 0, 0, 0), ('eid_fitr_bounce', 10, 1, 0, 0, 1, 3),
       ('eid_adha_day1', 12, 10, 0, 0, 0, 0), ('eid_adha_bounce', 12, 10, 0, 0, 1, 3),
       ('saudi_national_day', 0, 0, 9, 23, 0, 0), ('saudi_founding_day', 0, 0, 2, 22, 0, 0),
       ('payday_late', 0, 0, 0, 27, 0, 4), ('payday_early', 0, 0, 0, 1, 0, 4)) AS e(holiday, hm2, hd2, gm, gd, shift, upper_window)
    ON (e.hm2 > 0 AND c.hm = e.hm2 AND c.hd = e.hd2)
    OR (e.hm2 = 0 AND day(c.ds) = e.gd AND (e.gm = 0 OR month(c.ds) = e.gm)))""")
block("holiday_offsets", """
SELECT DISTINCT CAST(ds + off AS DATE) AS ds, holiday, CAST(off AS INTEGER) AS day_offset, holiday || '_' || off AS key
FROM (SELECT holiday, ds, unnest(range(lower_window, upper_window + 1))::INTEGER AS off FROM holiday_events)""")
block("weather", """
SELECT ds, CAST(m.temp AS DOUBLE) + CAST(day(ds) % 3 AS DOUBLE) AS temp_max,
       CAST([0, 1, 2, 3, 51, 53, 61, 63, 95, 71][1 + day(ds) % 10] AS INTEGER) AS weather_code
FROM (SELECT DISTINCT order_date AS ds FROM sales)
JOIN (VALUES (1,19),(2,22),(3,26),(4,32),(5,38),(6,41),(7,42),(8,42),(9,39),(10,34),(11,26),(12,21)) AS m(mo, temp) ON m.mo = month(ds)
WHERE day(ds) % 7 <> 3""")
block("spine_days", """
SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS ds FROM (SELECT min(order_date) AS a, max(order_date) AS b FROM sales)""")
block("daily_temp", """
SELECT s.ds, coalesce(w.temp_max, k.climate) AS temp_max FROM spine_days s LEFT JOIN weather w USING (ds)
LEFT JOIN (SELECT strftime(ds, '%m-%d') AS md, avg(temp_max) AS climate FROM weather GROUP BY 1) k ON k.md = strftime(s.ds, '%m-%d')""")

SQL = {
    # sources
    "src_sales": "SELECT * FROM sales",
    "src_scope": """SELECT s.user_id, CASE WHEN s.user_id % 3 = 2 THEN s.user_id - 1 ELSE s.user_id END AS workspace_id,
        count(*) AS rows, CAST(sum(s.quantity) AS BIGINT) AS units FROM sales s GROUP BY ALL""",
    "src_real_only": "SELECT * FROM real_sales",
    "src_derive": f"""SELECT user_id, order_id, line_no, product, order_date, hour, dayname(order_date) AS day_name, quantity,
        quantity * price_cents / 1e2 AS total_price, quantity * cost_cents / 1e2 AS product_cost,
        quantity * (price_cents - cost_cents) / 1e2 AS profit,
        {r('CAST(quantity * price_cents - quantity * cost_cents AS DOUBLE) / nullif(CAST(quantity * price_cents AS DOUBLE), 0) * 1e2')} AS margin_pct FROM sales""",
    "src_filter": "SELECT * FROM sales WHERE order_date BETWEEN DATE '1996-03-01' AND DATE '1999-08-31' AND category = 'Sweets'",
    # dashboard
    "dash_kpis": f"""SELECT user_id, sum(rev) / 1e2 AS total_revenue, count(*) AS total_orders,
        {r('sum(rev) / 1e2 / count(*)')} AS avg_order_value,
        {r("sum(rev) / 1e2 / greatest(date_diff('day', min(order_date), max(order_date)), 1)")} AS avg_daily_revenue
        FROM per_order GROUP BY user_id""",
    "dash_last30": """SELECT user_id, CAST(last_ds - 29 AS DATE) AS window_start, last_ds AS window_end, cur_rev / 1e2 AS revenue,
        cur_orders AS orders, cur_aov AS avg_order_value FROM win30_agg""",
    "dash_prev30_delta": f"""SELECT user_id,
        CASE WHEN prev_rev > 0 THEN {pct('prev_rev / 1e2', 'cur_rev / 1e2')} ELSE 0e0 END AS revenue_change,
        CASE WHEN prev_orders > 0 THEN {pct('prev_orders', 'cur_orders')} ELSE 0e0 END AS orders_change,
        CASE WHEN prev_aov > 0 THEN {pct('prev_aov', 'cur_aov')} ELSE 0e0 END AS avg_order_change FROM win30_agg""",
    "dash_has_comparison": """SELECT user_id, coalesce(prev_first >= first_ds AND prev_rev > 0, false) AS has_comparison FROM win30_agg""",
    "dash_best_seller": """SELECT user_id, product, qty FROM product_rev
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rev DESC, product) = 1""",
    "dash_worst_seller": """SELECT user_id, product, qty FROM product_rev
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rev, product) = 1""",
    "dash_busiest_day": f"""SELECT user_id, day_name, {r('rev / 1e2 / dates', 0)} AS avg_revenue FROM (
        SELECT user_id, dayname(order_date) AS day_name, sum(rev) AS rev, count(*) AS dates FROM daily_rev GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rev DESC, day_name) = 1""",
    "dash_dow_stats": f"""SELECT p.user_id, p.dow, p.name, coalesce(f.o, 0) AS orders, coalesce(f.u, 0) AS units, coalesce(f.r, 0) / 1e2 AS revenue
        FROM (SELECT DISTINCT user_id, {dow('ds')} AS dow, left(dayname(ds), 3) AS name FROM (
            SELECT user_id, unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY))::DATE AS ds FROM daily_rev GROUP BY user_id)) p
        LEFT JOIN (SELECT user_id, {dow('order_date')} AS dow, {big('sum(orders)')} AS o, {big('sum(units)')} AS u, {big('sum(rev)')} AS r
                   FROM daily_rev GROUP BY ALL) f USING (user_id, dow)""",
    "dash_daily": "SELECT user_id, order_date, rev / 1e2 AS revenue, orders FROM daily_rev",
    "dash_monthly_growth": "SELECT user_id, month, revenue, growth FROM monthly_growth",
    "dash_by_category": f"""SELECT user_id, category, sum(quantity * price_cents) / 1e2 AS revenue, {big('sum(quantity)')} AS units
        FROM real_sales GROUP BY ALL""",
    "dash_top_revenue": """SELECT user_id, product, category, rev / 1e2 AS revenue,
        row_number() OVER (PARTITION BY user_id ORDER BY rev DESC, product) AS place FROM product_rev""",
    "dash_top_qty": """SELECT user_id, product, category, qty,
        row_number() OVER (PARTITION BY user_id ORDER BY qty DESC, product) AS place FROM product_rev""",
    "dash_heatmap": "SELECT user_id, dow, day, hour, hour_label, value FROM heat",
    "dash_heatmap_norm": f"""SELECT user_id, dow, hour, value,
        {r('least(value / CAST(greatest(max(value) OVER (PARTITION BY user_id), 1) AS DOUBLE), 1e0)', 6)} AS intensity FROM heat""",
    "dash_category_list": """SELECT user_id, category, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n, category) AS INTEGER) AS place FROM (
        SELECT DISTINCT user_id, category, 1 AS n FROM real_sales UNION ALL SELECT DISTINCT user_id, 'All', 0 FROM real_sales)""",
    "dash_data_range": "SELECT * FROM data_range",
    "dash_reliability": """SELECT user_id, CAST(h.horizon AS INTEGER) AS horizon, CASE WHEN h.horizon <= reliable_days THEN 'reliable'
        WHEN h.horizon <= directional_days THEN 'directional' ELSE 'extrapolation' END AS tier
        FROM data_range CROSS JOIN (VALUES (7),(30),(90),(365),(730),(1095),(3650)) AS h(horizon)""",
    "dash_products": f"""SELECT user_id, product, min(category) AS category, {big('sum(quantity)')} AS qty,
        sum(quantity * price_cents) / 1e2 AS revenue FROM sales GROUP BY user_id, product""",
    "dash_rollup": f"""SELECT d.user_id, d.rev / 1e2 AS revenue, d.orders, {r('d.rev / 1e2 / d.orders')} AS avg_order_value,
        {r('d.rev / 1e2 / d.days')} AS avg_daily_revenue, coalesce(g.growth, 0e0) AS last_growth
        FROM (SELECT user_id, {big('sum(rev)')} AS rev, {big('sum(orders)')} AS orders, count(*) AS days FROM daily_rev
              WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY user_id) d
        LEFT JOIN (SELECT user_id, growth FROM monthly_growth WHERE month BETWEEN '1997-01' AND '1999-12'
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY month DESC) = 1) g USING (user_id)""",
    "dash_special_days": f"""SELECT o.user_id, o.occasion, o.days, {r('o.rev / 1e2 / o.days')} AS avg_revenue,
        {pct('n.rev / 1e2 / n.days', 'o.rev / 1e2 / o.days')} AS lift_pct, k.peak_ds, k.peak_event, k.peak_event_in_days
        FROM (SELECT user_id, occasion, sum(rev) AS rev, count(*) AS days FROM occ_days GROUP BY ALL) o
        LEFT JOIN (SELECT user_id, sum(rev) AS rev, count(*) AS days FROM occ_days WHERE occasion = 'Normal Day' GROUP BY ALL) n USING (user_id)
        JOIN (SELECT p.user_id, p.ds AS peak_ds, e.occasion AS peak_event, CAST(date_diff('day', p.ds, e.ds) AS INTEGER) AS peak_event_in_days
              FROM (SELECT user_id, ds FROM occ_days QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rev DESC, ds) = 1) p
              JOIN cal e ON e.occasion IN ('Ramadan', 'Eid al-Fitr', 'Eid al-Adha', 'Saudi National Day', 'Saudi Founding Day')
              QUALIFY row_number() OVER (PARTITION BY p.user_id ORDER BY abs(date_diff('day', p.ds, e.ds)), e.ds) = 1) k USING (user_id)""",
    # calendar
    "cal_spine": "SELECT user_id, unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY))::DATE AS ds FROM sales GROUP BY user_id",
    "cal_hijri": "SELECT s.ds, c.hm AS hijri_month, c.hd AS hijri_day FROM spine_days s JOIN cal c USING (ds)",
    "cal_season_local": "SELECT s.ds, c.season FROM spine_days s JOIN cal c USING (ds)",
    "cal_payday": "SELECT s.ds, c.is_payday FROM spine_days s JOIN cal c USING (ds)",
    "cal_occasion": "SELECT s.ds, c.occasion FROM spine_days s JOIN cal c USING (ds)",
    "cal_holidays": "SELECT holiday, ds, CAST(lower_window AS INTEGER) AS lower_window, CAST(upper_window AS INTEGER) AS upper_window FROM holiday_events",
    "cal_holiday_expand": "SELECT ds, holiday, day_offset, key FROM holiday_offsets",
    "cal_notable": """SELECT ds, occasion AS event FROM spine_days JOIN cal USING (ds) WHERE occasion <> 'Normal Day'
        UNION ALL SELECT ds, 'Payday' FROM spine_days JOIN cal USING (ds) WHERE day(ds) = 27 AND occasion <> 'Payday'
        UNION ALL SELECT ds, 'Post-payday spending' FROM spine_days JOIN cal USING (ds)
            WHERE (day(ds) >= 28 OR day(ds) <= 5) AND occasion <> 'Post-payday spending'""",
    "cal_regressors": "SELECT s.ds, c.season, c.occasion FROM spine_days s JOIN cal c USING (ds)",
    "cal_islands": """SELECT occasion, min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS days FROM (
        SELECT ds, occasion, ds - CAST(row_number() OVER (PARTITION BY occasion ORDER BY ds) AS INTEGER) AS g
        FROM spine_days JOIN cal USING (ds)) GROUP BY occasion, g""",
    "cal_occ_family": """SELECT s.ds, CASE WHEN occasion LIKE 'Eid%' THEN 'Eid' WHEN occasion LIKE 'Saudi%' THEN 'Solar holiday'
        WHEN occasion = 'Ramadan' THEN 'Ramadan' WHEN occasion = 'Payday' THEN 'Payday anchor'
        WHEN occasion = 'Post-payday spending' THEN 'Post-payday' WHEN occasion = 'Weekend' THEN 'Weekend (Fri/Sat)'
        ELSE 'Normal' END AS occ_family FROM spine_days s JOIN cal c USING (ds)""",
    "cal_onehot": """SELECT s.ds, season, CAST(season = 'Winter' AS INTEGER) AS season_Winter, CAST(season = 'Spring' AS INTEGER) AS season_Spring,
        CAST(season = 'Summer' AS INTEGER) AS season_Summer, CAST(season = 'Autumn' AS INTEGER) AS season_Autumn
        FROM spine_days s JOIN cal c USING (ds)""",
    "wx_daily_temp": f"SELECT ds, {r('temp_max', 6)} AS temp_max FROM daily_temp",
    "wx_fill": f"SELECT ds, {r('coalesce(temp_max, avg(temp_max) OVER (), 28e0)', 6)} AS temp_max FROM daily_temp",
    "wx_decode": """SELECT ds, weather_code, coalesce(CASE weather_code WHEN 0 THEN 'Clear Sky' WHEN 1 THEN 'Mainly Clear' WHEN 2 THEN 'Partly Cloudy'
        WHEN 3 THEN 'Overcast' WHEN 51 THEN 'Light Drizzle' WHEN 53 THEN 'Moderate Drizzle' WHEN 55 THEN 'Dense Drizzle' WHEN 61 THEN 'Slight Rain'
        WHEN 63 THEN 'Moderate Rain' WHEN 65 THEN 'Heavy Rain' WHEN 95 THEN 'Thunderstorm' END, 'Code ' || weather_code) AS weather_condition FROM weather""",
}

ORACLES = {key: query(sql) for key, sql in SQL.items()}
