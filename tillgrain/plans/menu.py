"""Registered queries: product matrix and pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillgrain.operators import menu, pricing
from tillgrain.plans.dashboard import real
from tillgrain.session import through_table
from tillgrain.sources import sales as src


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menu.item_table(real(spark, sf_dir))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.priced(table(spark, sf_dir))


def levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_table(pricing.lever(priced(spark, sf_dir)), "levers")


QUERIES = {
    "menu_items": lambda s, d: menu.item_report(menu.items(real(s, d))),
    "menu_popularity": lambda s, d: menu.popularity(table(s, d)),
    "menu_thresholds": lambda s, d: menu.thresholds(menu.items(real(s, d))),
    "menu_classify": lambda s, d: menu.class_report(table(s, d)),
    "menu_quadrants": lambda s, d: menu.quadrants(table(s, d)),
    "menu_classify_mean": lambda s, d: menu.classify_mean(table(s, d)),
    "menu_snapshot": lambda s, d: menu.snapshot(real(s, d)),
    "price_elasticity": lambda s, d: pricing.elasticity_report(real(s, d).select("user_id", "category")),
    "price_cost_cap": lambda s, d: pricing.cost_cap_report(real(s, d).select("user_id", "category")),
    "price_project_qty": lambda s, d: pricing.projection(priced(s, d), 20),
    "price_what_if": lambda s, d: pricing.what_if(priced(s, d), 10, -5),
    "price_band": lambda s, d: pricing.band(priced(s, d), 10),
    "price_scenarios": lambda s, d: pricing.scenarios(priced(s, d)),
    "price_delta": lambda s, d: pricing.delta(priced(s, d), 10, -5),
    "price_optimal": lambda s, d: pricing.optimal(priced(s, d)),
    "price_dog": lambda s, d: pricing.class_prices(priced(s, d), "Dog"),
    "price_puzzle": lambda s, d: pricing.class_prices(priced(s, d), "Puzzle"),
    "price_profit_guard": lambda s, d: pricing.profit_guard(priced(s, d)),
    "price_star_protect": lambda s, d: pricing.star_protect(priced(s, d)),
    "price_direction": lambda s, d: pricing.direction(priced(s, d)),
    "price_cost_lowering": lambda s, d: pricing.cost_lowering(priced(s, d)),
    "price_break_even": lambda s, d: pricing.break_even(priced(s, d)),
    "price_cost_defense": lambda s, d: pricing.cost_defense(priced(s, d)),
    "price_bulk": lambda s, d: pricing.bulk(priced(s, d), 10),
    "price_linear_demand": lambda s, d: pricing.linear_demand(priced(s, d)),
    "price_lever": lambda s, d: pricing.lever(priced(s, d)),
    "price_lever_summary": lambda s, d: pricing.lever_summary(levers(s, d)),
    "price_lever_skipped": lambda s, d: pricing.lever_skipped(levers(s, d)),
    "menu_quadrant_share": lambda s, d: menu.quadrant_share(table(s, d)),
    "menu_cutoff_flips": lambda s, d: menu.cutoff_flips(table(s, d)),
    "menu_boundary": lambda s, d: menu.boundary(table(s, d)),
    "menu_elasticity_coverage": lambda s, d: menu.elasticity_coverage(menu.items(real(s, d))),
    "menu_textbook_check": lambda s, d: menu.textbook_check(table(s, d)),
    "menu_suggestion_audit": lambda s, d: pricing.suggestion_audit(priced(s, d)),
    "menu_discount_overshoot": lambda s, d: pricing.discount_overshoot(priced(s, d)),
    "menu_imputed_drift": lambda s, d: menu.imputed_drift(src.sales(s, d)),
}
