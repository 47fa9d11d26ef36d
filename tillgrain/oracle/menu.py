"""SQL checks of the product matrix and pricing operators."""

from __future__ import annotations

from tillgrain.functions import rules
from tillgrain.oracle.base import big, block, classify, pct, query, r, uavg, usum, whole

def project(p: str, e: str = "elasticity", prefix: str = "") -> str:
    return f"(CASE WHEN {prefix}price > 0 THEN greatest(0e0, {prefix}qty * pow(({p}) / {prefix}price, {e})) ELSE CAST({prefix}qty AS DOUBLE) END)"


def margin(q: str, p: str, c: str) -> str:
    return f"(CASE WHEN {q} * {p} > 0 THEN ({p} - {c}) / ({p}) * 1e2 ELSE 0e0 END)"


def pop(q: str) -> str:
    return f"(CASE WHEN (total_qty - qty) + {q} > 0 THEN {q} / ((total_qty - qty) + {q}) * 1e2 ELSE 0e0 END)"


def cls(q: str, p: str, c: str) -> str:
    return classify(pop(q), margin(q, p, c), "pop_cut", "margin_cut")


def lookup(table: str, default: float, col: str) -> str:
    return f"""
SELECT category, coalesce(max(e.val), max(p.val), {default}e0) AS {col},
  coalesce(max(e.keyword), max(p.keyword)) AS matched,
  CASE WHEN max(e.keyword) IS NOT NULL THEN 'exact' WHEN max(p.keyword) IS NOT NULL THEN 'partial' ELSE 'default' END AS source
FROM (SELECT DISTINCT category, lower(trim(category)) AS k FROM sales) c
LEFT JOIN (SELECT keyword, CAST(val AS DOUBLE) AS val FROM {table}) e ON e.keyword = c.k
LEFT JOIN (SELECT c2.k AS pk, r.keyword, CAST(r.val AS DOUBLE) AS val FROM (SELECT DISTINCT lower(trim(category)) AS k FROM sales) c2
           JOIN {table} r ON contains(c2.k, r.keyword) OR contains(r.keyword, c2.k)
           QUALIFY row_number() OVER (PARTITION BY c2.k ORDER BY r.ord) = 1) p ON p.pk = c.k
GROUP BY category"""


FIRST = "ROW_NUMBER() OVER (PARTITION BY user_id, product ORDER BY order_date, order_id, line_no, price_cents, cost_cents)"


def items_sql(source: str) -> str:
    return f"""
SELECT user_id, product, max(CASE WHEN rn = 1 THEN category END) AS category, {big('sum(quantity)')} AS qty,
  max(CASE WHEN rn = 1 THEN price_cents END) / 1e2 AS price, max(CASE WHEN rn = 1 THEN cost_cents END) / 1e2 AS cost,
  {big('sum(quantity * price_cents)')} / 1e2 AS revenue, {big('sum(quantity * cost_cents)')} / 1e2 AS total_cost,
  {big('sum(quantity * (price_cents - cost_cents))')} / 1e2 AS profit,
  coalesce(CAST(sum(quantity * price_cents) - sum(quantity * cost_cents) AS DOUBLE) / nullif(CAST(sum(quantity * price_cents) AS DOUBLE), 0) * 1e2, 0e0) AS margin
FROM (SELECT *, {FIRST} AS rn FROM {source}) GROUP BY user_id, product"""


block("items", items_sql("real_sales"))
block("cuts", f"""
SELECT user_id, count(*) AS n_items, {big('sum(qty)')} AS total_qty, 7e1 / count(*) AS pop_cut, {uavg('margin')} AS margin_cut FROM items GROUP BY user_id""")
block("classed", f"""
SELECT *, {classify('popularity', 'margin', 'pop_cut', 'margin_cut')} AS classification
FROM (SELECT i.*, c.n_items, c.total_qty, c.pop_cut, c.margin_cut, CAST(i.qty AS DOUBLE) / nullif(CAST(c.total_qty AS DOUBLE), 0) * 1e2 AS popularity
      FROM items i JOIN cuts c USING (user_id))""")
block("classed_mean", f"""
SELECT *, 1e2 / n_items AS mean_cut, {classify('popularity', 'margin', '1e2 / n_items', 'margin_cut')} AS by_mean FROM classed""")
block("elastic", lookup("elasticity_rules", rules.DEFAULT_ELASTICITY, "elasticity"))
block("caps", lookup("cap_rules", rules.DEFAULT_COST_CAP, "cost_cap"))
block("priced", """
SELECT c.*, e.elasticity, k.cost_cap FROM classed c JOIN elastic e USING (category) JOIN caps k USING (category)""")
block("candidates", f"""
SELECT *, round_even(price, 0) AS ip,
  greatest(CASE WHEN d1 >= round_even(price, 0) THEN round_even(price, 0) - 1 ELSE d1 END, ceil(cost * 1.05e0)) AS dog_p,
  CASE WHEN z1 >= round_even(price, 0) THEN round_even(price, 0) - 1 ELSE z1 END AS puz_p,
  CASE WHEN elasticity <= -1.05e0 THEN elasticity * cost / (1e0 + elasticity) END AS theory
FROM (SELECT *, greatest(round_even(price * 0.9e0, 0), ceil(cost * 1.2e0)) AS d1,
             greatest(round_even(price * 0.92e0, 0), ceil(cost * 1.3e0)) AS z1 FROM priced)""")
GAIN = "({c} > 0 AND price > 0 AND " + project("{c}") + " * ({c} - cost) > qty * (price - cost))"
block("ruled", f"""
SELECT *, CASE WHEN classification = 'Dog' THEN CASE WHEN elasticity < -1.05e0 AND {GAIN.format(c='dog_p')} THEN 'dog_discount' ELSE 'dog_remove' END
  WHEN classification = 'Puzzle' THEN CASE WHEN elasticity < -1.05e0 AND {GAIN.format(c='puz_p')} THEN 'puzzle_discount' ELSE 'puzzle_visibility' END
  WHEN elasticity > -1.05e0 THEN 'test_increase'
  WHEN classification = 'Star' AND bounded < price AND margin_cut > 0
       AND (CASE WHEN bounded > 0 THEN (bounded - cost) / bounded * 1e2 ELSE 0e0 END) < margin_cut THEN 'star_protect'
  WHEN theory > price * 1.2e0 THEN 'capped_up' WHEN theory < price * 0.8e0 THEN 'capped_down' ELSE 'direct' END AS kind
FROM (SELECT *, CASE WHEN theory > price * 1.2e0 THEN price * 1.2e0 WHEN theory < price * 0.8e0 THEN price * 0.8e0 ELSE theory END AS bounded FROM candidates)""")
block("suggested", """
SELECT *, CASE kind WHEN 'dog_discount' THEN dog_p WHEN 'dog_remove' THEN ip WHEN 'puzzle_discount' THEN puz_p WHEN 'star_protect' THEN ip
  WHEN 'puzzle_visibility' THEN CASE WHEN ceil(price * 1.05e0) <= ip THEN ip + 1 ELSE ceil(price * 1.05e0) END
  WHEN 'test_increase' THEN CASE WHEN ceil(price * 1.1e0) <= ip THEN ip + 1 ELSE ceil(price * 1.1e0) END
  ELSE round_even(bounded, 0) END AS sug FROM ruled""")
block("costed", f"""
SELECT *, CASE WHEN price > 0 AND cost >= 1 AND raw_t < cost AND (cost - raw_t) / cost >= 0.05e0 THEN raw_t END AS tc FROM (
  SELECT *, CASE WHEN ref * (1e0 - margin_cut / 1e2) < cost
       THEN floor(greatest(ref * (1e0 - margin_cut / 1e2), cost * (1e0 - cost_cap)) * 2e0) / 2e0
       ELSE ceil(cost * (1e0 - cost_cap) * 2e0) / 2e0 END AS raw_t
  FROM (SELECT *, CASE WHEN sug > 0 THEN sug ELSE price END AS ref FROM suggested))""")
block("levers", f"""
SELECT *, abs(cost_lift - price_lift) <= greatest(5e1, greatest(cost_lift, price_lift) * 0.05e0) AS tied,
  price_lift > 0.5e0 AS pays
FROM (SELECT *, CASE WHEN round_even(sug, 0) > ip THEN 'raise' WHEN round_even(sug, 0) < ip THEN 'lower' ELSE 'hold' END AS direction,
  {r(project('sug') + ' * (sug - cost)')} - profit AS price_lift,
  {cls(project('sug'), 'sug', 'cost')} <> classification AS price_flips,
  tc IS NOT NULL AS has_cost, coalesce({r('(cost - tc) * qty')}, 0e0) AS cost_lift,
  coalesce({classify('popularity', '(price - tc) / price * 1e2', 'pop_cut', 'margin_cut')} <> classification AND tc IS NOT NULL, false) AS cost_flips
  FROM costed)""")
block("lever_rows", f"""
SELECT *, sys <> best AS mismatch, {r('abs(cost_lift - price_lift)')} AS magnitude FROM (SELECT *,
  CASE WHEN has_cost AND (direction = 'hold' OR (cost_flips AND cost_lift > price_lift)) THEN 'cost' ELSE 'price' END AS sys,
  CASE WHEN NOT has_cost THEN CASE WHEN pays THEN 'price' ELSE 'neither' END
       WHEN NOT pays OR direction = 'hold' THEN 'cost'
       WHEN tied AND cost_flips <> price_flips THEN CASE WHEN cost_flips THEN 'cost' ELSE 'price' END
       WHEN cost_lift > price_lift THEN 'cost' ELSE 'price' END AS best FROM levers)""")
block("bulk_groups", f"""
SELECT user_id, classification, count(*) AS n, {usum('revenue', 4)} AS rev, {usum('profit', 4)} AS prof,
  {usum(project('price * 1.1e0') + ' * (price * 1.1e0)', 4)} AS nrev, {usum(project('price * 1.1e0') + ' * (price * 1.1e0 - cost)', 4)} AS nprof
FROM priced GROUP BY ALL""")
block("month_items", f"""
SELECT user_id, product, m AS period_start, {big('sum(quantity)')} AS qty, {big('sum(quantity * price_cents)')} AS rev, {big('sum(quantity * cost_cents)')} AS cst,
  coalesce(CAST(sum(quantity * price_cents) - sum(quantity * cost_cents) AS DOUBLE) / nullif(CAST(sum(quantity * price_cents) AS DOUBLE), 0) * 1e2, 0e0) AS margin
FROM (SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS m FROM real_sales) GROUP BY ALL""")


def drift(source: str, name: str) -> str:
    return f"""SELECT user_id, product, {classify('qty * 1e2 / tq', 'margin', '1e2 / n', 'mc')} AS {name} FROM (
      SELECT *, CAST(sum(qty) OVER w AS DOUBLE) AS tq, count(*) OVER w AS n,
        CAST(sum(CAST(round_even(margin * 1e6, 0) AS BIGINT)) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE) / 1e6 AS mc FROM (
        SELECT user_id, product, CAST(sum(quantity) AS DOUBLE) AS qty,
          coalesce(CAST(sum(quantity * price_cents) - sum(quantity * cost_cents) AS DOUBLE) / nullif(CAST(sum(quantity * price_cents) AS DOUBLE), 0) * 1e2, 0e0) AS margin
        FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY user_id))"""


NP, NC = "price * 1.1e0", "cost * 0.95e0"
NQ = project(NP)
LOW, HIGH = project(NP, "elasticity * 1.3e0"), project(NP, "elasticity * 0.7e0")
SQ = project("sug")
SCN = "price * (1e0 + d / 1e2)"


def ends(name: str, a: str, b: str) -> str:
    return f"least({a}, {b}) AS {name}_low, greatest({a}, {b}) AS {name}_high"


def search(start: str, stop: str, cost: str) -> str:
    price = f"(CASE WHEN i = 399 THEN {stop} ELSE {start} + i * (({stop} - {start}) / 399e0) END)"
    return f"list_min(list_transform(range(400), lambda i: {{'gap': abs({project(price)} * ({price} - {cost}) - profit), 'i': i, 'price': {price}}})).price"


CHANGE = "CASE WHEN classification = {n} THEN 'Stays ' || classification ELSE classification || ' → ' || {n} END"

SQL = {
    "menu_items": f"SELECT user_id, product, category, qty, price, cost, revenue, total_cost, profit, {r('margin')} AS margin FROM items",
    "menu_popularity": f"SELECT user_id, product, qty, {r('popularity', 6)} AS popularity FROM classed",
    "menu_thresholds": "SELECT user_id, n_items, total_qty, pop_cut, margin_cut FROM cuts",
    "menu_classify": f"""SELECT user_id, product, category, qty, revenue, profit, {r('margin')} AS margin, {r('popularity', 6)} AS popularity, classification FROM classed""",
    "menu_quadrants": f"""SELECT u.user_id, k.classification, coalesce(t.n, 0) AS item_count, coalesce(t.rev, 0e0) AS class_revenue, m.product
        FROM (SELECT DISTINCT user_id FROM items) u CROSS JOIN classes k
        LEFT JOIN (SELECT user_id, classification, count(*) AS n, {usum('revenue', 4)} AS rev FROM classed GROUP BY ALL) t USING (user_id, classification)
        LEFT JOIN classed m ON m.user_id = u.user_id AND m.classification = k.classification""",
    "menu_classify_mean": f"""SELECT user_id, product, {r('popularity', 6)} AS popularity, {r('pm')} AS margin,
        {classify('popularity', 'pm', '1e2 / n_items', 'pm_cut')} AS classification
        FROM (SELECT *, CAST(sum(CAST(round_even(pm * 1e6, 0) AS BIGINT)) OVER (PARTITION BY user_id) AS DOUBLE) / CAST(n_items AS DOUBLE) / 1e6 AS pm_cut
              FROM (SELECT *, coalesce((price - cost) / nullif(price, 0) * 1e2, 0e0) AS pm FROM classed))""",
    "menu_snapshot": f"""SELECT user_id, product, period_start, last_day(period_start) AS period_end, qty AS total_qty, rev / 1e2 AS total_revenue, cst / 1e2 AS total_cost,
        (rev - cst) / 1e2 AS contribution_margin, {r('margin')} AS margin_pct, {r('popularity')} AS popularity_score,
        {classify('popularity', 'margin', '7e1 / n', 'mc')} AS classification
        FROM (SELECT *, qty / CAST(sum(qty) OVER w AS DOUBLE) * 1e2 AS popularity, count(*) OVER w AS n,
              CAST(sum(CAST(round_even(margin * 1e6, 0) AS BIGINT)) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE) / 1e6 AS mc
              FROM month_items WINDOW w AS (PARTITION BY user_id, period_start))""",
    "price_elasticity": "SELECT DISTINCT i.user_id, e.category, e.elasticity, e.matched, e.source FROM items i JOIN elastic e USING (category)",
    "price_cost_cap": "SELECT DISTINCT i.user_id, k.category, k.cost_cap, k.matched, k.source FROM items i JOIN caps k USING (category)",
    "price_project_qty": f"""SELECT user_id, product, qty, elasticity, {r(project('price * 1.2e0'), 4)} AS projected_qty, {whole(project('price * 1.2e0'))} AS projected_int FROM priced""",
    "price_what_if": f"""SELECT user_id, product, {r(NP)} AS new_price, {r(NC)} AS new_cost, {whole(NQ)} AS projected_qty, {r(f'{NQ} * ({NP})')} AS new_revenue,
        {r(f'{NQ} * ({NP} - {NC})')} AS new_profit, {r(margin(NQ, f'({NP})', NC))} AS new_margin, {r(pop(NQ), 6)} AS new_popularity,
        {cls(NQ, f'({NP})', NC)} AS new_classification FROM priced""",
    "price_band": f"""SELECT user_id, product, {ends('qty', whole(LOW), whole(HIGH))}, {ends('revenue', r(f'{LOW} * ({NP})'), r(f'{HIGH} * ({NP})'))},
        {ends('profit', r(f'{LOW} * ({NP} - cost)'), r(f'{HIGH} * ({NP} - cost)'))},
        {ends('margin', r(margin(LOW, f'({NP})', 'cost')), r(margin(HIGH, f'({NP})', 'cost')))} FROM priced""",
    "price_scenarios": f"""SELECT user_id, product, CAST(d AS INTEGER) AS change_pct, {r(SCN)} AS new_price, {whole(project(SCN))} AS projected_qty,
        {r(f'{project(SCN)} * ({SCN})')} AS new_revenue, {r(f'{project(SCN)} * ({SCN} - cost)')} AS new_profit,
        {r(margin(project(SCN), f'({SCN})', 'cost'))} AS new_margin, {cls(project(SCN), f'({SCN})', 'cost')} AS new_classification
        FROM priced CROSS JOIN (VALUES (-20),(-10),(0),(10),(20),(30)) AS s(d)""",
    "price_delta": f"""SELECT user_id, product, {pct('price', NP)} AS price_change_pct, {pct('cost', NC)} AS cost_change_pct,
        {pct('qty', whole(NQ))} AS qty_change_pct, {pct('revenue', r(f'{NQ} * ({NP})'))} AS revenue_change_pct,
        {pct('profit', r(f'{NQ} * ({NP} - {NC})'))} AS profit_change_pct, {CHANGE.format(n='ncls')} AS classification_change
        FROM (SELECT *, {cls(NQ, f'({NP})', NC)} AS ncls FROM priced)""",
    "price_optimal": f"""SELECT user_id, product, classification, price, CAST(sug AS BIGINT) AS suggested_price, kind,
        kind IN ('dog_remove', 'puzzle_visibility', 'test_increase') AS inelastic,
        CASE WHEN kind IN ('direct', 'capped_up', 'capped_down') THEN {whole('theory')} END AS theoretical_price,
        CASE WHEN kind = 'star_protect' THEN {r('CASE WHEN margin_cut / 1e2 < 1 THEN cost / (1e0 - margin_cut / 1e2) ELSE price END')} END AS demotion_price FROM suggested""",
    "price_dog": "SELECT user_id, product, price, CAST(sug AS BIGINT) AS suggested_price, kind FROM suggested WHERE classification = 'Dog'",
    "price_puzzle": "SELECT user_id, product, price, CAST(sug AS BIGINT) AS suggested_price, kind FROM suggested WHERE classification = 'Puzzle'",
    "price_profit_guard": f"""SELECT user_id, product, classification, CAST(cand AS BIGINT) AS candidate, {GAIN.format(c='cand')} AS pays
        FROM (SELECT *, CASE WHEN classification = 'Dog' THEN dog_p ELSE puz_p END AS cand FROM candidates WHERE classification IN ('Dog', 'Puzzle'))""",
    "price_star_protect": f"""SELECT user_id, product, price, cost, {r('margin_cut')} AS margin_cut, kind = 'star_protect' AS held,
        CASE WHEN kind = 'star_protect' THEN {r('cost / (1e0 - margin_cut / 1e2)')} END AS demotion_price FROM suggested WHERE classification = 'Star'""",
    "price_direction": f"""SELECT user_id, product, CASE WHEN sug > ip THEN 'raise' WHEN sug < ip THEN 'lower' ELSE 'hold' END AS direction,
        CASE WHEN price > 0 THEN {pct('price', 'sug')} END AS price_change_pct, ncls AS new_classification, {CHANGE.format(n='ncls')} AS classification_change,
        {whole(SQ)} AS projected_qty, {r(f'{SQ} * (sug - cost)')} AS projected_profit, {r(margin(SQ, 'sug', 'cost'))} AS projected_margin,
        {pct('profit', r(f'{SQ} * (sug - cost)'))} AS profit_change_pct FROM (SELECT *, {cls(SQ, 'sug', 'cost')} AS ncls FROM suggested)""",
    "price_cost_lowering": f"""SELECT user_id, product, cost, tc AS suggested_cost, {r('(cost - tc) / cost * 1e2', 1)} AS reduction_pct, {r('(cost - tc) * qty')} AS additional_profit,
        classification AS current_classification, c_sug AS new_classification, c_sug <> classification AS moves_classification,
        c_cur AS classification_at_current_price, c_cur <> classification AS flips_at_current_price
        FROM (SELECT *, CASE WHEN tc IS NOT NULL THEN {classify('popularity', '(ref - tc) / ref * 1e2', 'pop_cut', 'margin_cut')} END AS c_sug,
                     CASE WHEN tc IS NOT NULL THEN {classify('popularity', '(price - tc) / price * 1e2', 'pop_cut', 'margin_cut')} END AS c_cur FROM costed)""",
    "price_break_even": f"""SELECT user_id, product, CASE WHEN qty > 0 AND price > 0 THEN {r(search('greatest(0.01e0, price * 0.3e0)', 'price * 3e0', 'cost'))} END AS break_even_price FROM priced""",
    "price_cost_defense": f"""SELECT user_id, product, {r('nc')} AS new_cost, {r('km')} AS keep_margin_price, {r('(km - price) / price * 1e2', 1)} AS keep_margin_pct,
        {r('kp')} AS keep_profit_price, {r('(kp - price) / price * 1e2', 1)} AS keep_profit_pct
        FROM (SELECT *, cost * 1.2e0 AS nc, CASE WHEN cost > 0 THEN price * ((cost * 1.2e0) / cost) ELSE price END AS km,
              {search('price', 'price * 3e0', 'cost * 1.2e0')} AS kp FROM priced)""",
    "price_bulk": f"""SELECT user_id, classification, n AS item_count, {r('rev')} AS current_revenue, {r('nrev')} AS new_revenue, {pct('rev', 'nrev')} AS revenue_change_pct,
        {r('prof')} AS current_profit, {r('nprof')} AS new_profit, {pct('prof', 'nprof')} AS profit_change_pct,
        {r('mrev')} AS menu_revenue, {r('mrev - rev + nrev')} AS new_menu_revenue, {pct('mrev', '(mrev - rev + nrev)')} AS menu_revenue_change_pct,
        {r('mprof')} AS menu_profit, {r('mprof - prof + nprof')} AS new_menu_profit, {pct('mprof', '(mprof - prof + nprof)')} AS menu_profit_change_pct
        FROM bulk_groups JOIN (SELECT user_id, {usum('rev', 4)} AS mrev, {usum('prof', 4)} AS mprof FROM bulk_groups GROUP BY user_id) USING (user_id)""",
    "price_linear_demand": f"""SELECT user_id, product, CAST(a AS INTEGER) AS adjust, {r('dem', 4)} AS demand_change_pct,
        {r('(price + a - cost) / (price + a) * 1e2')} AS new_margin, {r('(price + a - cost) * qty * (1e0 + dem / 1e2) - (price - cost) * qty')} AS profit_change
        FROM (SELECT *, CASE WHEN a > 0 THEN -(a / price) * 15e0 ELSE abs(a) / price * 1e1 END AS dem FROM priced CROSS JOIN (VALUES (-2), (2)) AS v(a))""",
    "price_lever": f"""SELECT user_id, product, classification, price, cost, kind, direction, tc AS target_cost, {r('price_lift')} AS price_lift, {r('cost_lift')} AS cost_lift,
        price_flips, cost_flips, sys AS system_primary, best AS expected_primary, mismatch, magnitude FROM lever_rows""",
    "price_lever_summary": """SELECT user_id, 'class' AS section, classification AS name, count(*) FILTER (NOT mismatch) || '/' || count(*) FILTER (mismatch) AS value FROM lever_rows GROUP BY ALL
        UNION ALL SELECT user_id, 'direction', sys || '->' || best, CAST(count(*) AS VARCHAR) FROM lever_rows WHERE mismatch GROUP BY user_id, sys, best
        UNION ALL SELECT user_id, 'top', product, CAST(place AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY magnitude DESC, product) AS place
            FROM lever_rows WHERE mismatch) WHERE place <= 5""",
    "price_lever_skipped": """SELECT user_id, CASE WHEN cost < 1 THEN 'cost below 1' ELSE 'cut below 5 %' END AS reason, count(*) AS items FROM lever_rows WHERE tc IS NULL GROUP BY ALL""",
    "menu_quadrant_share": f"""SELECT user_id, by_mean AS classification, n AS item_count, qty, rev AS revenue, {r('n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) * 1e2', 1)} AS count_share,
        {r('rev / (CAST(sum(CAST(round_even(rev * 1e4, 0) AS BIGINT)) OVER (PARTITION BY user_id) AS BIGINT) / 1e4) * 1e2', 1)} AS revenue_share, {r('mp', 4)} AS med_popularity, {r('mm', 4)} AS med_margin
        FROM (SELECT user_id, by_mean, count(*) AS n, {big('sum(qty)')} AS qty, {usum('revenue', 4)} AS rev, median(popularity) AS mp, median(margin) AS mm FROM classed_mean GROUP BY ALL)""",
    "menu_cutoff_flips": f"""SELECT user_id, product, by_mean, by_median FROM (SELECT *, {classify('popularity', 'margin', 'mp', 'mm')} AS by_median FROM (
        SELECT *, median(popularity) OVER (PARTITION BY user_id) AS mp, median(margin) OVER (PARTITION BY user_id) AS mm FROM classed_mean)) WHERE by_mean <> by_median""",
    "menu_boundary": f"""SELECT user_id, product, classification, pop_dist, margin_dist FROM (SELECT user_id, product, by_mean AS classification,
        {r('popularity - mean_cut', 4)} AS pop_dist, {r('margin - margin_cut', 4)} AS margin_dist FROM classed_mean) WHERE abs(pop_dist) <= 0.2e0 OR abs(margin_dist) <= 2e0""",
    "menu_elasticity_coverage": "SELECT i.user_id, e.category, count(*) AS n_items, e.elasticity, e.source FROM items i JOIN elastic e USING (category) GROUP BY ALL",
    "menu_textbook_check": f"""SELECT user_id, product, CAST(d AS INTEGER) AS delta_pct, elasticity, {r(project(SCN), 4)} AS projected_qty,
        {r('qty * pow(1e0 + d / 1e2, elasticity)', 4)} AS closed_form_qty, {r(f'abs({project(SCN)} - qty * pow(1e0 + d / 1e2, elasticity))', 6)} AS abs_diff
        FROM priced CROSS JOIN (VALUES (-20),(-10),(10),(20),(30)) AS s(d)""",
    "menu_suggestion_audit": f"""SELECT user_id, product, kind, CAST(sug AS BIGINT) AS suggested_price, {r('ch')} AS profit_delta, ch < -1 AS loses
        FROM (SELECT *, {SQ} * (sug - cost) - qty * (price - cost) AS ch FROM suggested)""",
    "menu_discount_overshoot": f"""SELECT user_id, product, classification, kind, i AS intended_pct, re AS realised_pct, {r('re - i')} AS overshoot_pp
        FROM (SELECT *, CASE WHEN classification = 'Dog' THEN -1e1 ELSE -8e0 END AS i, {r('(sug - price) / price * 1e2')} AS re FROM suggested WHERE classification IN ('Dog', 'Puzzle'))""",
    "menu_imputed_drift": f"""SELECT a.user_id, a.product, a.real_only, b.with_imputed, s.real_share FROM ({drift('real_sales', 'real_only')}) a
        JOIN ({drift('sales', 'with_imputed')}) b USING (user_id, product)
        JOIN (SELECT user_id, {r('CAST(sum(CASE WHEN is_imputed THEN 0 ELSE quantity END) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE)', 3)} AS real_share FROM sales GROUP BY user_id) s USING (user_id)
        WHERE a.real_only <> b.with_imputed""",
}

ORACLES = {key: query(sql) for key, sql in SQL.items()}
