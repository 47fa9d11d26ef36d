"""A cross-section of the registered queries against their SQL at sf 0.001.
`python tests/compare.py` runs all of them at sf 0.01."""

import os

import pytest

from compare import diff, duck
from tillgrain.plans.registry import all_oracles, all_queries
from tillgrain.session import run_tables

SAMPLE = (
    "src_sales", "dash_kpis", "dash_dow_stats", "dash_top_qty", "dash_special_days", "cal_holiday_expand", "wx_fill",
    "menu_classify", "menu_cutoff_flips", "price_direction", "price_cost_lowering", "price_break_even", "price_lever_summary",
    "cln_valid_rows", "ing_upsert_dims", "ing_stream", "tbl_delete_upload", "fc_naive_dow", "fc_calibrate", "fc_residual_stats",
    "ev_slice", "ev_pattern", "ev_folds", "ev_gates", "ev_ablation", "ev_source", "fc_fit_total", "fc_holdout_mae", "fc_per_product", "fc_item",
    "fc_category_heatmap", "fc_summary", "fc_order", "imp_rows", "imp_quality", "cln_datetime", "sink_tables", "sink_report_csv", "menu_quadrant_share",
)


def test_every_check_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, name):
    with run_tables(spark) as made:
        got = all_queries()[name](spark, sf).toArrow()
    want = duck(sf).sql(all_oracles()[name]).to_arrow_table()
    assert diff(got, want) is None
    assert not any(os.path.exists(path) for path in made)
