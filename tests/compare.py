"""Run registered queries next to their SQL checks: python tests/compare.py [prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    return str(v)


def rows_of(table) -> tuple[list[str], list[tuple]]:
    """Arrow table as sorted text rows with columns in name order."""
    names = sorted(table.column_names)
    cols = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*cols)) if cols else []


def diff(spark_table, duck_table) -> str | None:
    sn, sr = rows_of(spark_table)
    dn, dr = rows_of(duck_table)
    if sn != dn:
        return f"columns {sn} != {dn}"
    st = {f.name: str(f.type).replace("large_", "") for f in spark_table.schema}
    dt = {f.name: str(f.type).replace("large_", "") for f in duck_table.schema}
    bad = {n: (st[n], dt[n]) for n in sn if st[n] != dt[n]}
    if bad:
        return f"types {bad}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    wrong = [(a, b) for a, b in zip(sr, dr) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(sr)} rows differ: {sn} {wrong[0]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tillgrain.session import local_session, run_tables

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            with run_tables(spark):
                got = fn(spark, sf_dir).toArrow()
            t1 = time.time()
            if name not in oracles:
                print(f"rows {name:28s} {got.num_rows:8d} {t1 - t0:6.2f}s (no SQL)", flush=True)
                continue
            want = con.execute(oracles[name]).to_arrow_table()
            problem = diff(got, want)
            t2 = time.time()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name:28s} {type(e).__name__}: {str(e)[:700]}", flush=True)
            failed += 1
            continue
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {got.num_rows:8d} spark {t1 - t0:6.2f}s duck {t2 - t1:6.2f}s {problem or ''}"[:1500], flush=True)
    print("failed:", failed, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
