"""SQL building blocks of the DuckDB checks.

Each named block is one common table expression; ``query`` puts the blocks a
statement mentions in front of it. The SQL is written in the plain relational
form of each operator (windows over whole groups, dense grids), which makes it
an independent check of the Spark plans.
"""

from __future__ import annotations

import re

from tillgrain.functions import labels, rules

BLOCKS: dict[str, str] = {}
STORED: set[str] = set()
RECURSIVE: set[str] = set()


def block(name: str, sql: str, stored: bool = False, recursive: bool = False) -> None:
    BLOCKS[name] = sql.strip()
    if stored:
        STORED.add(name)
    if recursive:
        RECURSIVE.add(name)


def query(sql: str) -> str:
    """Prefix ``sql`` with every block it needs, in definition order."""
    needed: set[str] = set()
    stack = [sql]
    while stack:
        words = set(re.findall(r"[a-z_0-9]+", stack.pop()))
        for name in words & BLOCKS.keys() - needed:
            needed.add(name)
            stack.append(BLOCKS[name])
    kept = lambda n: "AS" if n in RECURSIVE else "AS MATERIALIZED" if n in STORED else "AS"
    parts = [f"{n} {kept(n)} ({BLOCKS[n]})" for n in BLOCKS if n in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql.strip()) if parts else sql.strip()


def r(x: str, n: int = 2) -> str:
    """Half-even rounding of a double."""
    return f"(round_even(CAST({x} AS DOUBLE) * 1e{n}, 0) / 1e{n} + 0e0)"


def whole(x: str) -> str:
    return f"CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def usum(x: str, n: int = 6) -> str:
    """Sum on a fixed-point grid of ``n`` places."""
    return f"(CAST(sum(CAST(round_even(({x}) * 1e{n}, 0) AS BIGINT)) AS BIGINT) / 1e{n})"


def uavg(x: str) -> str:
    return f"(CAST(sum(CAST(round_even(({x}) * 1e6, 0) AS BIGINT)) AS DOUBLE) / nullif(CAST(count({x}) AS DOUBLE), 0) / 1e6)"


def pct(old: str, new: str, n: int = 1) -> str:
    return r(f"CAST(({new}) - ({old}) AS DOUBLE) / nullif(CAST({old} AS DOUBLE), 0) * 1e2", n)


def period(h: str) -> str:
    return (
        f"CASE WHEN {h} IS NULL THEN NULL WHEN {h} BETWEEN 5 AND 11 THEN 'morning' "
        f"WHEN {h} BETWEEN 12 AND 16 THEN 'Afternoon' WHEN {h} BETWEEN 17 AND 21 THEN 'Evening' ELSE 'night' END"
    )


def season_met(d: str) -> str:
    return (
        f"CASE WHEN {d} IS NULL THEN NULL WHEN month({d}) IN (12,1,2) THEN 'Winter' "
        f"WHEN month({d}) IN (3,4,5) THEN 'Spring' WHEN month({d}) IN (6,7,8) THEN 'Summer' ELSE 'Autumn' END"
    )


def season_local(d: str) -> str:
    return (
        f"CASE WHEN month({d}) IN (12,1,2) THEN 'Winter' WHEN month({d}) IN (3,4) THEN 'Spring' "
        f"WHEN month({d}) BETWEEN 5 AND 9 THEN 'Summer' ELSE 'Autumn' END"
    )


def dow(d: str) -> str:
    return f"CAST(isodow({d}) - 1 AS INTEGER)"


def classify(pop: str, margin: str, cut_pop: str, cut_margin: str) -> str:
    return (
        f"CASE WHEN {pop} >= {cut_pop} THEN CASE WHEN {margin} >= {cut_margin} THEN 'Star' ELSE 'Plowhorse' END "
        f"ELSE CASE WHEN {margin} >= {cut_margin} THEN 'Puzzle' ELSE 'Dog' END END"
    )


def literal_rows(rows: list[tuple], names: str) -> str:
    def lit(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


block("sales", """
SELECT CAST(c.c_nationkey AS INTEGER) AS user_id, CAST(o.o_orderkey AS BIGINT) AS order_id,
       CAST(o.o_orderdate AS DATE) AS order_date, CAST(o.o_orderkey % 24 AS INTEGER) AS hour,
       concat(p.p_name, ' #', CAST(p.p_partkey AS VARCHAR)) AS product,
       CASE p.p_type WHEN 'ECONOMY' THEN 'Espresso Drinks' WHEN 'SMALL' THEN 'Sweets'
                     WHEN 'MEDIUM' THEN 'Cold Drinks' WHEN 'LARGE' THEN 'Hot Sweets'
                     WHEN 'PROMO' THEN 'Dripp Coffee Drinks' ELSE 'Gadgets' END AS category,
       CAST(l.l_quantity AS BIGINT) AS quantity,
       CAST(floor(l.l_extendedprice / l.l_quantity) AS BIGINT) * 100 AS price_cents,
       CAST(floor(l.l_extendedprice / l.l_quantity) AS BIGINT) * (20 + p.p_size) AS cost_cents,
       o.o_orderstatus = 'P' AS is_imputed, l.l_linenumber AS line_no
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
""")
block("real_sales", "SELECT * FROM sales WHERE NOT is_imputed")
block("elasticity_rules", literal_rows(
    [(i, k, v) for i, (k, v) in enumerate(rules.ELASTICITY)], "ord, keyword, val"))
block("cap_rules", literal_rows(
    [(i, k, v) for i, (k, v) in enumerate(rules.COST_CAP)], "ord, keyword, val"))

# Umm al-Qura month starts, Jumada II 1415 to Safar 1423 (first entry: year 1415, month 6).
HIJRI_STARTS = """
1994-11-05 1994-12-04 1995-01-03 1995-02-01 1995-03-03 1995-04-01 1995-05-01
1995-05-31 1995-06-30 1995-07-29 1995-08-28 1995-09-26 1995-10-26
1995-11-24 1995-12-23 1996-01-22 1996-02-20 1996-03-21 1996-04-19
1996-05-19 1996-06-18 1996-07-17 1996-08-16 1996-09-15 1996-10-14
1996-11-12 1996-12-12 1997-01-10 1997-02-09 1997-03-10 1997-04-09
1997-05-08 1997-06-07 1997-07-06 1997-08-05 1997-09-04 1997-10-03
1997-11-02 1997-12-01 1997-12-31 1998-01-29 1998-02-28 1998-03-29
1998-04-28 1998-05-27 1998-06-26 1998-07-25 1998-08-24 1998-09-22
1998-10-22 1998-11-20 1998-12-20 1999-01-19 1999-02-18 1999-03-19
1999-04-17 1999-05-16 1999-06-15 1999-07-14 1999-08-12 1999-09-11
1999-10-10 1999-11-09 1999-12-09 2000-01-08 2000-02-07 2000-03-07
2000-04-06 2000-05-05 2000-06-03 2000-07-03 2000-08-01 2000-08-30
2000-09-28 2000-10-28 2000-11-27 2000-12-27 2001-01-26 2001-02-24
2001-03-26 2001-04-25 2001-05-24 2001-06-22 2001-07-22 2001-08-20
2001-09-18 2001-10-17 2001-11-16 2001-12-16 2002-01-15 2002-02-13
2002-03-15 2002-04-14
""".split()
block("hijri_starts", literal_rows(
    [((5 + i) // 12 + 1415, (5 + i) % 12 + 1, s) for i, s in enumerate(HIJRI_STARTS)], "hy, hm, start_text"))
block("hijri_months", """
SELECT CAST(hy AS INTEGER) AS hy, CAST(hm AS INTEGER) AS hm, CAST(start_text AS DATE) AS start,
       lead(CAST(start_text AS DATE)) OVER (ORDER BY hy, hm) AS next_start FROM hijri_starts
""")
block("all_days", """
SELECT CAST(unnest(generate_series(DATE '1994-11-05', DATE '2002-04-13', INTERVAL 1 DAY)) AS DATE) AS ds
""")
block("cal", f"""
SELECT d.ds, m.hm, CAST(date_diff('day', m.start, d.ds) + 1 AS INTEGER) AS hd,
  {season_local('d.ds')} AS season, {season_met('d.ds')} AS season_met, {dow('d.ds')} AS dow,
  (day(d.ds) >= 27 OR day(d.ds) <= 5) AS is_payday,
  CASE WHEN m.hm = 9 THEN 'Ramadan'
       WHEN m.hm = 10 AND date_diff('day', m.start, d.ds) < 3 THEN 'Eid al-Fitr'
       WHEN m.hm = 12 AND date_diff('day', m.start, d.ds) BETWEEN 9 AND 12 THEN 'Eid al-Adha'
       WHEN month(d.ds) = 9 AND day(d.ds) = 23 THEN 'Saudi National Day'
       WHEN month(d.ds) = 2 AND day(d.ds) = 22 THEN 'Saudi Founding Day'
       WHEN day(d.ds) = 27 THEN 'Payday'
       WHEN day(d.ds) >= 28 OR day(d.ds) <= 5 THEN 'Post-payday spending'
       WHEN isodow(d.ds) IN (5, 6) THEN 'Weekend' ELSE 'Normal Day' END AS occasion
FROM all_days d JOIN hijri_months m ON d.ds >= m.start AND d.ds < m.next_start
""")
block("hours", literal_rows([(h, i) for i, h in enumerate(labels.OPEN_HOURS)], "hour, hour_ord"))
block("weekdays", literal_rows([(i, d, d[:3]) for i, d in enumerate(labels.WEEKDAYS)], "dow, day_name, day"))
block("periods", literal_rows([(i, p) for i, p in enumerate(labels.PERIODS)], "ord, time_period"))
block("seasons", literal_rows([(i, p) for i, p in enumerate(labels.SEASONS)], "ord, season"))
block("classes", literal_rows([(i, p) for i, p in enumerate(labels.CLASSES)], "ord, classification"))
