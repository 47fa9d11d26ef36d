"""SQL checks of the forecast evaluation."""

from __future__ import annotations

import math

from tillgrain.functions import labels
from tillgrain.oracle import forecast, ingest, menu, views  # noqa: F401  (blocks)
from tillgrain.oracle.base import big, block, dow, literal_rows, query, r, uavg, usum, whole
from tillgrain.plans.evaluate import FOLDS, SAMPLE_DATES, TEST_END, TRAIN_END
from tillgrain.plans.params import NEAR

block("fold_plan", literal_rows(FOLDS, "fold, cutoff_text, horizon"))
block("real_daily", f"SELECT user_id, order_date AS ds, {big('sum(quantity)')} AS y FROM real_sales GROUP BY ALL", stored=True)
block("fold_train", "SELECT f.*, p.fold, CAST(p.cutoff_text AS DATE) AS cutoff, CAST(p.horizon AS INTEGER) AS horizon FROM fc_daily f JOIN fold_plan p ON f.ds <= CAST(p.cutoff_text AS DATE)", stored=True)
block("fold_days", "SELECT DISTINCT user_id, fold, cutoff, unnest(generate_series(cutoff + 1, cutoff + horizon, INTERVAL 1 DAY))::DATE AS ds FROM fold_train", stored=True)
block("fold_full", f"SELECT t.* FROM fold_train t JOIN (SELECT user_id, fold, {dow('ds')} AS dow, median(y) AS m FROM fold_train GROUP BY ALL) u ON u.user_id = t.user_id AND u.fold = t.fold AND u.dow = {dow('t.ds')} WHERE t.y >= u.m * 0.3e0", stored=True)
SID = "user_id || '|' || fold"
forecast.regression("fit_fold", f"SELECT {SID} AS sid, ds, CAST(y AS DOUBLE) AS y, {forecast.W} FROM fold_full", f"SELECT {SID} AS sid, ds FROM fold_days")
forecast.regression("fit_fold_all", f"SELECT {SID} AS sid, ds, CAST(y AS DOUBLE) AS y, {forecast.W} FROM fold_train", f"SELECT {SID} AS sid, ds FROM fold_days")
_DROPS = " OR ".join(f"(sid LIKE '%no_{n}' AND j BETWEEN {a} AND {b})" for n, a, b in forecast.BLOCK_OF if n != "weekly")
_VARIANTS = "(VALUES ('no_holidays'), ('no_weather'), ('no_seasons')) AS v(variant)"
forecast.regression("fit_ablation", f"SELECT user_id || '|' || variant AS sid, ds, CAST(y AS DOUBLE) AS y, {forecast.W} FROM fold_train, {_VARIANTS} WHERE fold = '{FOLDS[-1][0]}'",
                    f"SELECT user_id || '|' || variant AS sid, ds FROM fold_days, {_VARIANTS} WHERE fold = '{FOLDS[-1][0]}'", _DROPS)
block("fold_floor", f"SELECT user_id, fold, {dow('ds')} AS dow, quantile_cont(y, 0.25) AS p25 FROM fold_full GROUP BY ALL")
block("fold_rate", f"SELECT user_id, fold, CAST(sum(y) AS DOUBLE) / (max(ds) - min(ds) + 1) AS per_day, {r(uavg('y'), 6)} AS naive_mean FROM fold_train GROUP BY ALL")
block("fold_values", f"""
SELECT d.*, {forecast.yhat('a.raw')} AS raw, {forecast.yhat('b.raw')} AS cells FROM fold_days d
JOIN fit_fold a ON a.sid = d.user_id || '|' || d.fold AND a.ds = d.ds JOIN fit_fold_all b ON b.sid = a.sid AND b.ds = d.ds""", stored=True)
block("fold_scale", f"""
SELECT user_id, fold, {r('CASE WHEN m > 0 AND abs(raw - 1) >= 0.05e0 THEN raw ELSE 1e0 END', 6)} AS scale FROM (
  SELECT v.user_id, v.fold, v.m, least(greatest(q.per_day / nullif(v.m, 0), 0.1e0), 2e1) AS raw FROM (SELECT user_id, fold, {uavg('cells')} AS m FROM fold_values GROUP BY ALL) v JOIN fold_rate q USING (user_id, fold))""")
block("fold_rows", f"""
SELECT v.user_id, v.fold, v.cutoff, v.ds, CAST(v.ds - v.cutoff AS INTEGER) AS horizon_day, v.raw, {r('greatest(v.raw, coalesce(p.p25, 0e0))', 4)} AS floored, v.cells,
  {r('v.cells * s.scale', 6)} AS service, s.scale, {r('coalesce(d.m, l.m)', 6)} AS naive_dow, q.naive_mean, coalesce(t.y, 0) AS y, t.y IS NULL AS is_imputed_day
FROM fold_values v JOIN fold_scale s USING (user_id, fold) JOIN fold_rate q USING (user_id, fold)
LEFT JOIN fold_floor p ON p.user_id = v.user_id AND p.fold = v.fold AND p.dow = {dow('v.ds')}
LEFT JOIN (SELECT user_id, fold, {dow('ds')} AS dow, {uavg('y')} AS m FROM fold_train GROUP BY ALL) d ON d.user_id = v.user_id AND d.fold = v.fold AND d.dow = {dow('v.ds')}
JOIN (SELECT user_id, fold, {uavg('y')} AS m FROM fold_train GROUP BY ALL) l ON l.user_id = v.user_id AND l.fold = v.fold
LEFT JOIN real_daily t ON t.user_id = v.user_id AND t.ds = v.ds""", stored=True)
block("scored", """
SELECT f.*, f.floored AS yhat, c.occasion, CASE WHEN occasion LIKE 'Eid%' THEN 'Eid' WHEN occasion LIKE 'Saudi%' THEN 'Solar holiday' WHEN occasion = 'Ramadan' THEN 'Ramadan'
    WHEN occasion = 'Payday' THEN 'Payday anchor' WHEN occasion = 'Post-payday spending' THEN 'Post-payday' WHEN occasion = 'Weekend' THEN 'Weekend (Fri/Sat)' ELSE 'Normal' END AS occ_family,
  strftime(f.ds, '%Y-%m') AS month, dayname(f.ds) AS day_name,
  CASE WHEN horizon_day <= 7 THEN '1-7d' WHEN horizon_day <= 14 THEN '8-14d' WHEN horizon_day <= 21 THEN '15-21d' WHEN horizon_day <= 31 THEN '22-31d' END AS horizon_bucket
FROM fold_rows f JOIN cal c USING (ds) WHERE NOT is_imputed_day AND y > 0""", stored=True)

# shares as each fold knew them: workspace and fold are one key
block("fold_cells0", f"""
SELECT {SID} AS user_id, product, {forecast.season_local('order_date')} AS season, {dow('order_date')} AS dow, {forecast.period('hour')} AS time_period, {big('sum(quantity)')} AS qty
FROM fsales JOIN fold_plan ON order_date <= CAST(cutoff_text AS DATE) GROUP BY ALL""", stored=True)
block("fold_scored", f"SELECT {SID} AS user_id, user_id AS uid, fold, ds, yhat, y, cells FROM scored", stored=True)
forecast.shares("fold_", "fold_cells0", forecast.slots_of("fold_scored"))
block("fold_sold", f"""
SELECT s.user_id, s.uid, s.ds, r.product, {forecast.period('r.hour')} AS time_period, {big('sum(r.quantity)')} AS y
FROM fold_scored s JOIN real_sales r ON r.user_id = s.uid AND r.order_date = s.ds GROUP BY ALL""", stored=True)
block("period_rows", f"""
SELECT d.uid AS user_id, d.fold, d.ds, k.time_period, {forecast.cell('d.yhat * k.share')} AS yhat, coalesce(t.y, 0) AS y FROM fold_scored d
JOIN (SELECT user_id, season, dow, time_period, sum(nf) AS share FROM fold_norm GROUP BY ALL) k ON {forecast.on_slot('d', 'k')}
LEFT JOIN (SELECT user_id, ds, time_period, {big('sum(y)')} AS y FROM fold_sold GROUP BY ALL) t ON t.user_id = d.user_id AND t.ds = d.ds AND t.time_period = k.time_period""")
block("best_products", f"""
SELECT uid, product FROM (SELECT uid, product, sum(y) AS v FROM fold_sold GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY v DESC, product) <= 15""")
block("product_rows", f"""
SELECT d.uid AS user_id, d.fold, d.ds, k.product, {forecast.cell('d.yhat * k.share')} AS yhat, coalesce(t.y, 0) AS y FROM fold_scored d
JOIN (SELECT user_id, season, dow, product, sum(nf) AS share FROM fold_norm GROUP BY ALL) k ON {forecast.on_slot('d', 'k')}
JOIN best_products b ON b.uid = d.uid AND b.product = k.product
LEFT JOIN (SELECT user_id, ds, product, {big('sum(y)')} AS y FROM fold_sold GROUP BY ALL) t ON t.user_id = d.user_id AND t.ds = d.ds AND t.product = k.product""")
block("every_product_rows", f"""
SELECT d.uid AS user_id, d.fold, d.ds, k.product, {forecast.cell('d.yhat * k.share')} AS yhat, coalesce(t.y, 0) AS y FROM fold_scored d
JOIN (SELECT user_id, season, dow, product, sum(nf) AS share FROM fold_norm GROUP BY ALL) k ON {forecast.on_slot('d', 'k')}
LEFT JOIN (SELECT user_id, ds, product, {big('sum(y)')} AS y FROM fold_sold GROUP BY ALL) t ON t.user_id = d.user_id AND t.ds = d.ds AND t.product = k.product""")
block("fold_totals", forecast.cell_totals("fold_scored", "fold_"))
block("fold_cell_rows", """
SELECT t.*, s.y, split_part(t.user_id, '|', 1)::INTEGER AS uid FROM fold_totals t
LEFT JOIN (SELECT user_id, product, time_period, CAST(sum(y) AS BIGINT) AS y FROM fold_sold GROUP BY ALL) s USING (user_id, product, time_period)""")


def metric(p: str = "yhat", y: str = "y") -> str:
    e = f"({p} - {y})"
    return f"""count(*) AS n, {r(uavg(f'abs{e}'))} AS mae, {r(f'sqrt(avg({e} * {e}))')} AS rmse,
      {r(f"{usum(f'abs{e}')} / nullif({usum(f'abs({y})')}, 0) * 1e2", 1)} AS wape, {r(f'avg(CASE WHEN {y} > 0 THEN abs{e} / {y} END) * 1e2', 1)} AS mape,
      {r(uavg(e))} AS mbe, {r(uavg(y), 1)} AS y_mean, {r(uavg(p), 1)} AS yhat_mean"""


def corr(a: str, b: str, least: int = 3) -> str:
    both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""CASE WHEN count(*) FILTER {both} < {least} THEN NULL WHEN stddev_pop({a}) FILTER {both} < 1e-9 OR stddev_pop({b}) FILTER {both} < 1e-9 THEN 0e0 ELSE corr({a}, {b}) END"""


def strength(src: str, keys: str, v: str, name: str) -> str:
    return f"""SELECT {keys}, {r('rng / CASE WHEN dev > 0 THEN dev ELSE 1e-9 END', 4)} AS {name} FROM (
      SELECT {keys}, max(m) - min(m) AS rng FROM (SELECT {keys}, isodow(ds) AS d, avg({v}) AS m FROM {src} GROUP BY ALL) GROUP BY ALL)
      JOIN (SELECT {keys}, stddev_samp({v}) AS dev FROM {src} GROUP BY ALL) USING ({keys})"""


def fft(src: str, keys: str, v: str, name: str) -> str:
    ang = f"(k * j / n * CAST({2 * math.pi!r} AS DOUBLE))"
    return f"""SELECT {keys}, {r(f'CASE WHEN max(n) >= 14 THEN sqrt(pow(sum(x * cos{ang}), 2) + pow(sum(x * sin{ang}), 2)) / (max(n) * max(mean)) END', 5)} AS {name} FROM (
      SELECT {keys}, x, mean, CAST(n AS DOUBLE) AS n, CAST(j AS DOUBLE) AS j, floor(n / 7e0) + CASE WHEN n / 7e0 - floor(n / 7e0) > 0.5e0 THEN 1 ELSE 0 END AS k FROM (
        SELECT {keys}, {v} - avg({v}) OVER w AS x, avg({v}) OVER w AS mean, count(*) OVER w AS n, row_number() OVER (PARTITION BY {keys} ORDER BY ds) - 1 AS j FROM {src} WINDOW w AS (PARTITION BY {keys}))) GROUP BY ALL"""


def lagged(src: str, keys: str, v: str, k: int, name: str) -> str:
    return f"""SELECT {keys}, {r(f"CASE WHEN count({v}) >= {k + 3} THEN {corr(v, 'lg')} END", 4)} AS {name} FROM (
      SELECT *, lag({v}, {k}) OVER (PARTITION BY {keys} ORDER BY ds) AS lg FROM {src}) GROUP BY ALL"""


def dow_spearman(src: str, keys: str) -> str:
    rk = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2e0"
    return f"""SELECT {keys}, {r(corr('ra', 'rb'), 4)} AS spearman FROM (SELECT {keys}, {rk('fm')} AS ra, {rk('am')} AS rb FROM (
      SELECT {keys}, isodow(ds) AS d, {r('avg(yhat)', 6)} AS fm, {r('avg(y)', 6)} AS am FROM {src} GROUP BY ALL)) GROUP BY ALL"""


block("cat_real", f"SELECT user_id, category, order_date AS ds, {big('sum(quantity)')} AS y FROM real_sales GROUP BY ALL")
block("cat_recent", f"""
SELECT c.* FROM cat_real c JOIN (SELECT user_id, category, max(ds) AS e FROM cat_real WHERE ds <= DATE '{TRAIN_END}' GROUP BY ALL) x USING (user_id, category)
WHERE c.ds <= DATE '{TRAIN_END}' AND c.ds >= x.e - 27""")
forecast.regression("fit_pattern", f"SELECT user_id AS sid, ds, CAST(y AS DOUBLE) AS y, {forecast.W} FROM fc_daily WHERE ds <= DATE '{TRAIN_END}'",
                    f"SELECT DISTINCT user_id AS sid, unnest(generate_series(DATE '{TRAIN_END}' + 1, DATE '{TEST_END}', INTERVAL 1 DAY))::DATE AS ds FROM fc_daily WHERE ds <= DATE '{TRAIN_END}'")
block("pattern_daily", f"SELECT sid AS user_id, ds, {forecast.yhat()} AS yhat FROM fit_pattern")
block("pattern_cells0", f"""
SELECT user_id, product, {forecast.season_local('order_date')} AS season, {dow('order_date')} AS dow, {forecast.period('hour')} AS time_period, {big('sum(quantity)')} AS qty
FROM fsales WHERE order_date <= DATE '{TRAIN_END}' GROUP BY ALL""")
forecast.shares("pattern_", "pattern_cells0", forecast.slots_of("pattern_daily"))
block("cat_rows", f"""
SELECT k.user_id, k.category, k.ds, k.yhat, {r('coalesce(nd.m, nl.m)', 6)} AS naive, t.y FROM (
  SELECT d.user_id, s.category, d.ds, {forecast.cell('d.yhat * s.share')} AS yhat FROM pattern_daily d
  JOIN (SELECT n.user_id, n.season, n.dow, i.category, sum(n.nf) AS share FROM pattern_norm n JOIN all_items i USING (user_id, product) GROUP BY ALL) s ON {forecast.on_slot('d', 's')}) k
LEFT JOIN (SELECT user_id, category, {dow('ds')} AS dow, {uavg('y')} AS m FROM cat_recent GROUP BY ALL) nd ON nd.user_id = k.user_id AND nd.category = k.category AND nd.dow = {dow('k.ds')}
LEFT JOIN (SELECT user_id, category, {uavg('y')} AS m FROM cat_recent GROUP BY ALL) nl ON nl.user_id = k.user_id AND nl.category = k.category
LEFT JOIN cat_real t ON t.user_id = k.user_id AND t.category = k.category AND t.ds = k.ds""", stored=True)
block("cat_hit", "SELECT * FROM cat_rows WHERE y IS NOT NULL")
UC = "user_id, category"
block("pattern", f"""
SELECT b.user_id, b.category, b.real_days, b.mean_actual, b.mean_forecast, b.mae, w.mapd_naive, lf.lag7_fc, la.lag7_ac, sf.ws_fc, sa.ws_ac, ff.fft_fc, fa.fft_ac, sp.spearman,
  {r('CASE WHEN b.sa > 1e-9 THEN b.sf / b.sa END', 5)} AS var_ratio, {r('CASE WHEN w.wn > 1e-9 THEN w.wf / w.wn END', 5)} AS var_over_naive,
  {r('CASE WHEN fa.fft_ac > 0 THEN ff.fft_fc / fa.fft_ac END', 5)} AS fft_ratio
FROM (SELECT {UC}, count(*) AS real_days, {r(uavg('y'), 1)} AS mean_actual, {r(uavg('yhat'), 1)} AS mean_forecast, {r(uavg('abs(yhat - y)'), 1)} AS mae,
        stddev_samp(yhat) AS sf, stddev_samp(y) AS sa FROM cat_hit GROUP BY ALL) b
JOIN (SELECT {UC}, {r('avg(CASE WHEN naive > 1e-9 THEN abs(yhat - naive) / naive END) * 1e2', 1)} AS mapd_naive, stddev_samp(yhat) AS wf, stddev_samp(naive) AS wn FROM cat_rows GROUP BY ALL) w USING ({UC})
LEFT JOIN ({lagged('cat_hit', UC, 'yhat', 7, 'lag7_fc')}) lf USING ({UC}) LEFT JOIN ({lagged('cat_hit', UC, 'y', 7, 'lag7_ac')}) la USING ({UC})
LEFT JOIN ({strength('cat_hit', UC, 'yhat', 'ws_fc')}) sf USING ({UC}) LEFT JOIN ({strength('cat_hit', UC, 'y', 'ws_ac')}) sa USING ({UC})
LEFT JOIN ({fft('cat_hit', UC, 'yhat', 'fft_fc')}) ff USING ({UC}) LEFT JOIN ({fft('cat_hit', UC, 'y', 'fft_ac')}) fa USING ({UC})
LEFT JOIN ({dow_spearman('cat_hit', UC)}) sp USING ({UC})""")
block("heat_all", f"""
SELECT u.user_id, d.dow, h.hour, {r('coalesce(c.q / CAST(o.n AS DOUBLE), 0e0)', 4)} AS v FROM (SELECT DISTINCT user_id FROM real_sales) u
CROSS JOIN (SELECT CAST(unnest(range(7)) AS INTEGER) AS dow) d CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour) h
LEFT JOIN (SELECT user_id, {dow('order_date')} AS dow, hour, {big('sum(quantity)')} AS q FROM real_sales GROUP BY ALL) c ON c.user_id = u.user_id AND c.dow = d.dow AND c.hour = h.hour
LEFT JOIN (SELECT user_id, {dow('order_date')} AS dow, count(DISTINCT order_date) AS n FROM real_sales GROUP BY ALL) o ON o.user_id = u.user_id AND o.dow = d.dow""")
block("near", f"SELECT l.* FROM raw_long l JOIN data_ends e USING (user_id) WHERE l.ds <= e.data_end + {NEAR}", stored=True)
views.slot_sums("near_money", "", {"revenue": "price"}, "near")
views.slot_sums("near_cat", "category", {"revenue": "price"}, "near")
views.slot_sums("near_periods", "time_period", {"yhat": "1e0"}, "near")
views.heat("near_heat", "near_periods")
block("dow_pair", f"""
SELECT p.user_id, p.dow, {r('p.v')} AS pred, {r('coalesce(t.v, 0e0)')} AS real FROM (SELECT user_id, {dow('ds')} AS dow, {usum('revenue', 4)} / count(*) AS v FROM near_money GROUP BY ALL) p
LEFT JOIN (SELECT user_id, {dow('order_date')} AS dow, {big('sum(quantity * price_cents)')} / 1e2 / count(DISTINCT order_date) AS v FROM real_sales GROUP BY ALL) t USING (user_id, dow)""")
block("cat_pair", f"""
SELECT p.user_id, p.category, {r('p.v')} AS pred, {r('t.v')} AS real FROM (SELECT user_id, category, {usum('revenue', 4)} AS v FROM near_cat GROUP BY ALL) p
JOIN (SELECT s.user_id, category, {big('sum(quantity * price_cents)')} / 1e2 AS v FROM real_sales s JOIN (SELECT user_id, max(order_date) AS e FROM real_sales GROUP BY user_id) x USING (user_id)
      WHERE s.order_date > x.e - {NEAR} GROUP BY ALL) t USING (user_id, category)""")
block("heat_pair", "SELECT a.user_id, a.dow, a.hour, coalesce(round_even(h.v, 0), 0e0) AS pred, a.v AS real FROM heat_all a LEFT JOIN near_heat h USING (user_id, dow, hour)")
block("heat_score", f"""
SELECT user_id, {r(corr('pred', 'real'), 4)} AS pearson, {r('count(*) FILTER (pa <= 5 AND ra <= 5) / CAST(count(*) FILTER (pa <= 5 OR ra <= 5) AS DOUBLE)', 4)} AS top5_jaccard, bool_or(pa = 1 AND ra = 1) AS peak_match
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, dow, hour) AS pa, row_number() OVER (PARTITION BY user_id ORDER BY real DESC, dow, hour) AS ra FROM heat_pair) GROUP BY user_id""")
block("level_rows", f"""
SELECT user_id, {r('rm', 3)} AS real_mean, {r('fm', 3)} AS forecast_mean, {r('abs(fm - rm) / rm * 1e2', 3)} AS deviation_pct FROM (
  SELECT t.user_id, {uavg('t.y')} AS rm FROM real_daily t JOIN (SELECT user_id, max(ds) AS e FROM real_daily GROUP BY user_id) x USING (user_id) WHERE t.ds >= x.e - 55 GROUP BY t.user_id)
JOIN (SELECT user_id, {uavg('yhat')} AS fm FROM (SELECT n.*, row_number() OVER (PARTITION BY n.user_id ORDER BY n.ds) AS rn FROM near n
        JOIN (SELECT user_id, max(ds) AS e FROM real_daily GROUP BY user_id) x USING (user_id) WHERE n.ds > x.e) WHERE rn <= 30 GROUP BY user_id) USING (user_id)""")


def agree(table: str, name: str, n: int) -> str:
    rk = lambda c: f"rank() OVER (PARTITION BY user_id ORDER BY {c}) + (count(*) OVER (PARTITION BY user_id, {c}) - 1) / 2e0"
    return f"""SELECT user_id, {r(corr('ra', 'rb'), 4)} AS spearman, {r(f'count(*) FILTER (pa <= {n} AND qa <= {n}) / CAST(count(*) FILTER (pa <= {n} OR qa <= {n}) AS DOUBLE)', 4)} AS jaccard FROM (
      SELECT *, {rk('pred')} AS ra, {rk('real')} AS rb, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, {name}) AS pa, row_number() OVER (PARTITION BY user_id ORDER BY real DESC, {name}) AS qa FROM {table}) GROUP BY user_id"""


def ranks(table: str, name: str) -> str:
    return f"""SELECT user_id, {name}, pred, real, CAST(rank() OVER (PARTITION BY user_id ORDER BY pred DESC) AS INTEGER) AS pred_rank,
      CAST(rank() OVER (PARTITION BY user_id ORDER BY real DESC) AS INTEGER) AS real_rank FROM {table}"""


def hist(src: str, v: str, bins: int) -> str:
    return f"""SELECT user_id, CAST(least(coalesce(floor((v - lo) / nullif((hi - lo) / {bins}e0, 0)), 0), {bins - 1}) AS INTEGER) AS bin, mean, count(*) AS n FROM (
      SELECT user_id, {v} AS v FROM {src}) JOIN (SELECT user_id, min({v}) AS lo, max({v}) AS hi, {r(uavg(v), 4)} AS mean FROM {src} GROUP BY user_id) USING (user_id) GROUP BY ALL"""


PARTS = ("level", "weekly", "holidays", "seasons", "weather")
WEEK_EFFECTS = [f"weekly_{n.lower()}" for n in labels.WEEKDAYS]
views.slot_sums("service_cells", "category, time_period", {"yhat": "1e0"}, "service")
block("ablation_rows", f"""
SELECT a.*, t.y AS y_real FROM (
  SELECT user_id, 'full' AS variant, ds, cells AS yhat FROM fold_values WHERE fold = '{FOLDS[-1][0]}'
  UNION ALL SELECT user_id, 'naive_dow', ds, naive_dow FROM fold_rows WHERE fold = '{FOLDS[-1][0]}'
  UNION ALL SELECT CAST(split_part(sid, '|', 1) AS INTEGER), split_part(sid, '|', 2), ds, {forecast.yhat()} FROM fit_ablation) a JOIN real_daily t USING (user_id, ds)""", stored=True)
DIMS = ("fold", "day_name", "occ_family", "horizon_bucket", "month")
SQL = {
    "ev_source": """SELECT n.user_id, n.sku, CAST(n.order_datetime AS DATE) AS ds, n.quantity, n.is_imputed, c.season, c.occasion, c.dow
        FROM normal_rows n JOIN cal c ON c.ds = CAST(n.order_datetime AS DATE)""",
    "ev_folds": "SELECT * FROM fold_rows",
    "ev_real_days": "SELECT user_id, fold, ds, y, yhat, occasion, occ_family, month FROM scored",
    "ev_metrics": f"SELECT user_id, {metric()} FROM scored GROUP BY user_id",
    "ev_slice": " UNION ALL ".join([f"SELECT '{d}' AS dimension, {d} AS value, {metric()} FROM scored GROUP BY {d}" for d in DIMS] + [
        f"SELECT 'time_period', time_period, {metric()} FROM period_rows GROUP BY time_period", f"SELECT 'product', product, {metric()} FROM every_product_rows GROUP BY product"]),
    "ev_horizon_bucket": "SELECT user_id, fold, ds, horizon_day, horizon_bucket FROM scored",
    "ev_model_compare": " UNION ALL ".join(f"SELECT user_id, '{m}' AS model, {metric(m)} FROM scored GROUP BY user_id"
                                           for m in ("raw", "floored", "cells", "service", "naive_dow", "naive_mean")),
    "ev_inflation": f"""SELECT fold, {r(uavg('ratio'), 3)} AS mean, {r('median(ratio)', 3)} AS median, {r('min(ratio)', 3)} AS min, {r('max(ratio)', 3)} AS max FROM (
        SELECT s.fold, {r('s.cells * t.total / nullif(s.yhat, 0)', 6)} AS ratio FROM fold_scored s
        JOIN (SELECT user_id, season, dow, sum(fraction) AS total FROM fold_cells GROUP BY ALL) t ON {forecast.on_slot('s', 't')}) GROUP BY fold""",
    "ev_worst_days": f"""SELECT 'over' AS side, user_id, fold, ds, y, yhat, err, CAST(row_number() OVER (PARTITION BY user_id ORDER BY err DESC, ds, fold) AS INTEGER) AS place
          FROM (SELECT *, {r('yhat - y', 4)} AS err FROM scored) QUALIFY place <= 10
        UNION ALL SELECT 'under', user_id, fold, ds, y, yhat, err, CAST(row_number() OVER (PARTITION BY user_id ORDER BY err, ds, fold) AS INTEGER) AS place
          FROM (SELECT *, {r('yhat - y', 4)} AS err FROM scored) QUALIFY place <= 10""",
    "ev_residual_hist": hist("scored", r("yhat - y", 6), 30),
    "ev_menu_hist": " UNION ALL ".join(f"SELECT *, '{c}' AS measure FROM ({hist('classed', r(c, 6), 40)})" for c in ("margin", "popularity")),
    "ev_renorm": f"""SELECT c.user_id, c.ds, c.category, c.time_period, {r('CASE WHEN s.t > 0 THEN c.yhat / s.t * u.units ELSE 0e0 END', 4)} AS yhat FROM service_cells c
        JOIN (SELECT user_id, ds, {usum('yhat')} AS t FROM service_cells GROUP BY ALL) s USING (user_id, ds) JOIN ({forecast.rounded('service', 'user_id')}) u USING (user_id, ds)""",
    "ev_cells": " UNION ALL ".join(f"SELECT uid AS user_id, '{d}' AS dimension, {d} AS name, {r(usum('total'), 3)} AS yhat, coalesce({big('sum(y)')}, 0) AS y FROM fold_cell_rows GROUP BY uid, {d}"
                                   for d in ("time_period", "product")),
    "ev_top_products": f"SELECT user_id, product, {metric()} FROM product_rows GROUP BY user_id, product",
    "ev_pearson": f"SELECT user_id, {r(corr('yhat', 'y'), 4)} AS pearson FROM scored GROUP BY user_id",
    "ev_autocorr": lagged("real_daily", "user_id", "y", 7, "lag7"),
    "ev_weekday_strength": strength("real_daily", "user_id", "y", "strength"),
    "ev_fft7": fft("real_daily", "user_id", "y", "fft7"),
    "ev_spearman": dow_spearman("scored", "user_id"),
    "ev_naive28": f"""SELECT n.user_id, n.ds, {r('coalesce(d.m, l.m)', 6)} AS yhat FROM naive_fc n
        LEFT JOIN (SELECT t.user_id, {dow('t.ds')} AS dow, {uavg('t.y')} AS m FROM real_daily t JOIN (SELECT user_id, max(ds) AS e FROM real_daily GROUP BY user_id) x USING (user_id) WHERE t.ds >= x.e - 27 GROUP BY ALL) d
          ON d.user_id = n.user_id AND d.dow = {dow('n.ds')}
        LEFT JOIN (SELECT t.user_id, {uavg('t.y')} AS m FROM real_daily t JOIN (SELECT user_id, max(ds) AS e FROM real_daily GROUP BY user_id) x USING (user_id) WHERE t.ds >= x.e - 27 GROUP BY ALL) l ON l.user_id = n.user_id""",
    "ev_mapd": f"SELECT user_id, {r('avg(CASE WHEN naive_mean > 1e-9 THEN abs(yhat - naive_mean) / naive_mean END) * 1e2', 3)} AS mapd FROM scored GROUP BY user_id",
    "ev_pattern": "SELECT * FROM pattern",
    "ev_grade": f"""SELECT user_id, category, a AS pattern_score, b AS replication_score, CAST(least(greatest({whole('(a + b) / 2e0')}, 1), 5) AS INTEGER) AS grade FROM (
        SELECT *, CASE WHEN coalesce(var_over_naive < 1.05e0, false) AND b0 > 2 THEN 2 ELSE b0 END AS b FROM (SELECT *,
          CAST(coalesce(spearman >= 0.6e0, false) AS INTEGER) + CAST(coalesce(var_ratio BETWEEN 0.5e0 AND 1.5e0, false) AS INTEGER)
          + CAST(coalesce(lag7_fc * lag7_ac >= 0 AND abs(lag7_fc - lag7_ac) <= 0.25e0, false) AS INTEGER)
          + CAST(coalesce(ws_ac > 1e-6 AND ws_fc / ws_ac BETWEEN 0.5e0 AND 1.5e0, false) AS INTEGER) + CAST(coalesce(fft_ratio BETWEEN 0.5e0 AND 1.5e0, false) AS INTEGER) AS a,
          CASE WHEN mapd_naive >= 30 THEN 5 WHEN mapd_naive >= 20 THEN 4 WHEN mapd_naive >= 12 THEN 3 WHEN mapd_naive >= 6 THEN 2 ELSE 1 END AS b0 FROM pattern))""",
    "ev_real_heatmap": "SELECT user_id, dow, hour, v AS units_per_day FROM heat_all",
    "ev_top_cells": "SELECT * FROM heat_score",
    "ev_level": "SELECT *, deviation_pct <= 20 AS passed FROM level_rows",
    "ev_dow_rank": ranks("dow_pair", "dow"),
    "ev_category_rank": ranks("cat_pair", "category"),
    "ev_components": f"""SELECT *, CASE {" ".join(f"WHEN {w} = greatest({', '.join(WEEK_EFFECTS)}) THEN '{n}'" for w, n in zip(WEEK_EFFECTS, labels.WEEKDAYS))} END AS weekly_peak FROM (
        SELECT sid AS user_id, {", ".join(f"sum(abs({c})) > 1e-9 AS {c}_active" for c in PARTS)}, {r('stddev_samp(weather)', 3)} AS weather_std,
          {", ".join(f"{r(f'avg(weekly) FILTER (isodow(ds) = {i + 1})', 3)} AS {w}" for i, w in enumerate(WEEK_EFFECTS))},
          {r("avg(holidays) FILTER (occasion LIKE 'Eid%')", 3)} AS eid_effect, {r("avg(holidays) FILTER (occasion = 'Payday')", 3)} AS payday_effect
        FROM fit_total JOIN cal USING (ds) GROUP BY sid)""",
    "ev_component_sample": f"""SELECT sid AS user_id, ds, {", ".join(f"{r(c, 3)} AS {c}" for c in PARTS)} FROM fit_total WHERE ds IN ({", ".join(f"DATE '{d}'" for d in SAMPLE_DATES)})""",
    "ev_ablation": f"SELECT user_id, variant, n, mae, wape FROM (SELECT user_id, variant, {metric('yhat', 'y_real')} FROM ablation_rows GROUP BY user_id, variant)",
    "ev_gates": f"""SELECT user_id, gate, passed, count(*) FILTER (passed) OVER (PARTITION BY user_id) AS n_passed FROM (
        SELECT user_id, 'heatmap_pearson' AS gate, coalesce(pearson >= 0.85e0, false) AS passed FROM heat_score
        UNION ALL SELECT user_id, 'heatmap_top5_jaccard', coalesce(top5_jaccard >= 0.6e0, false) FROM heat_score
        UNION ALL SELECT user_id, 'daily_level', coalesce(deviation_pct <= 20, false) FROM level_rows
        UNION ALL SELECT user_id, 'dow_spearman', coalesce(spearman >= 0.7e0, false) FROM ({agree('dow_pair', 'dow', 2)})
        UNION ALL SELECT user_id, 'category_jaccard', coalesce(jaccard >= 0.66e0, false) FROM ({agree('cat_pair', 'category', 3)})
        UNION ALL SELECT user_id, 'category_spearman', coalesce(spearman >= 0.6e0, false) FROM ({agree('cat_pair', 'category', 3)})
        UNION ALL SELECT user_id, 'ablation_full_beats_baseline', coalesce(max(mae) FILTER (variant = 'full') < max(mae) FILTER (variant = 'naive_dow'), false)
          FROM (SELECT user_id, variant, {metric('yhat', 'y_real')} FROM ablation_rows GROUP BY user_id, variant) GROUP BY user_id
        UNION ALL SELECT DISTINCT sid, 'date_spot_checks', true FROM fit_total
        UNION ALL SELECT sid, 'components_active', {" AND ".join(f"sum(abs({c})) > 1e-9" for c in PARTS)} FROM fit_total GROUP BY sid)""",
}

ORACLES = {key: query(sql) for key, sql in SQL.items()}
