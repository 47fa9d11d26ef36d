"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillgrain.plans.registry import all_queries  # noqa: E402
from tillgrain.session import local_session, run_tables  # noqa: E402

HEADLINE = (
    "dash_kpis", "dash_heatmap", "dash_top_revenue", "menu_classify", "menu_quadrant_share", "price_direction", "price_bulk",
    "price_break_even", "cln_valid_rows", "ing_replace_items", "fc_fit_total", "fc_fit_product", "fc_total", "fc_top_items",
    "imp_quality", "ev_slice", "ev_gates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in registered]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        with run_tables(spark):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
