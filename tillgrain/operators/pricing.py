"""Price and cost changes under constant-elasticity demand, all items at once.

The formulas are column expressions over the classified item table: one narrow
stage, no shuffle, whatever the number of products. Only the two grid searches
are Arrow functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tillgrain.functions import rules
from tillgrain.functions.numeric import micro_sum, pct_change, rnd, whole
from tillgrain.functions.ranking import top_k
from tillgrain.functions.tables import values
from tillgrain.operators.menu import classified, quadrant, with_rules

# Thresholds of the price and cost rules.
ELASTIC_BELOW = -1.05
BAND = 0.30
SCENARIO_STEPS = (-20, -10, 0, 10, 20, 30)
SEARCH_POINTS = 400


# today's price, cost, quantity and elasticity of an item


def p0() -> Column:
    return F.col("price")


def c0() -> Column:
    return F.col("cost")


def q0() -> Column:
    return F.col("qty")


def e0() -> Column:
    return F.col("elasticity")


def priced(items: DataFrame) -> DataFrame:
    """Classified items with elasticity and cost cap of their category."""
    if "elasticity" not in items.columns:
        items = with_rules(items)
    return classified(items)


def elasticity_report(items: DataFrame) -> DataFrame:
    e = rules.elasticity(F.col("category"))
    names = items.select("user_id", "category").distinct()
    return names.select(
        "user_id", "category", e["value"].alias("elasticity"), e["keyword"].alias("matched"), e["source"].alias("source")
    )


def cost_cap_report(items: DataFrame) -> DataFrame:
    cap = rules.cost_cap(F.col("category"))
    names = items.select("user_id", "category").distinct()
    return names.select(
        "user_id", "category", cap["value"].alias("cost_cap"), cap["keyword"].alias("matched"), cap["source"].alias("source")
    )


def project_qty(qty: Column, price: Column, new_price: Column, elasticity: Column) -> Column:
    """Expected quantity at a new price; unchanged without a current price."""
    projected = F.greatest(F.lit(0.0), qty * F.pow(new_price / price, elasticity))
    return F.when(price > 0, projected).otherwise(qty.cast("double"))


def with_outcome(df: DataFrame, new_price: Column, new_cost: Column | None = None, exponent: Column | None = None, tag: str = "new") -> DataFrame:
    """Append the projected ``{tag}_price, _qty, _revenue, _profit, _margin,
    _popularity, _class`` of a change. Each step names its result, so an
    expression is evaluated once and the plan stays small."""
    n = lambda name: F.col(f"{tag}_{name}")
    step = df.withColumns({f"{tag}_price": new_price, f"{tag}_cost": c0() if new_cost is None else new_cost})
    step = step.withColumn(f"{tag}_qty", project_qty(q0(), p0(), n("price"), e0() if exponent is None else exponent))
    step = step.withColumns({
        f"{tag}_revenue": n("qty") * n("price"),
        f"{tag}_profit": n("qty") * (n("price") - n("cost")),
        f"{tag}_total": (F.col("total_qty") - q0()) + n("qty"),
    })
    step = step.withColumns({
        f"{tag}_margin": F.when(n("revenue") > 0, (n("price") - n("cost")) / n("price") * 100.0).otherwise(0.0),
        f"{tag}_popularity": F.when(n("total") > 0, n("qty") / n("total") * 100.0).otherwise(0.0),
    })
    return step.withColumn(
        f"{tag}_class", quadrant(n("popularity"), n("margin"), F.col("pop_cut"), F.col("margin_cut"))
    )


def projection(priced: DataFrame, change_pct: float) -> DataFrame:
    new_price = p0() * F.lit(1 + change_pct / 100)
    qty = project_qty(q0(), p0(), new_price, e0())
    return priced.select(
        "user_id", "product", "qty", "elasticity", rnd(qty, 4).alias("projected_qty"), whole(qty).alias("projected_int")
    )


def what_if(priced: DataFrame, price_pct: float, cost_pct: float) -> DataFrame:
    """One (price, cost) change applied to every item."""
    o = with_outcome(priced, p0() * F.lit(1 + price_pct / 100), c0() * F.lit(1 + cost_pct / 100))
    return o.select(
        "user_id", "product", rnd(F.col("new_price")).alias("new_price"), rnd(F.col("new_cost")).alias("new_cost"),
        whole(F.col("new_qty")).alias("projected_qty"), rnd(F.col("new_revenue")).alias("new_revenue"),
        rnd(F.col("new_profit")).alias("new_profit"), rnd(F.col("new_margin")).alias("new_margin"),
        rnd(F.col("new_popularity"), 6).alias("new_popularity"), F.col("new_class").alias("new_classification"),
    )


def band(priced: DataFrame, price_pct: float) -> DataFrame:
    """Low and high ends from an elasticity 30 % up and down."""
    new_price = p0() * F.lit(1 + price_pct / 100)
    both = with_outcome(priced, new_price, c0(), e0() * (1 + BAND), "a")
    both = with_outcome(both, new_price, c0(), e0() * (1 - BAND), "b")

    def ends(name: str, fmt=rnd) -> list[Column]:
        a, b = fmt(F.col(f"a_{name}")), fmt(F.col(f"b_{name}"))
        return [F.least(a, b).alias(f"{name}_low"), F.greatest(a, b).alias(f"{name}_high")]

    return both.select("user_id", "product", *ends("qty", whole), *ends("revenue"), *ends("profit"), *ends("margin"))


def scenarios(priced: DataFrame) -> DataFrame:
    """Six fixed price steps per item."""
    steps = values(priced.sparkSession, [(s,) for s in SCENARIO_STEPS], "change_pct int")
    o = with_outcome(priced.crossJoin(F.broadcast(steps)), p0() * (1.0 + F.col("change_pct") / 100.0))
    return o.select(
        "user_id", "product", "change_pct", rnd(F.col("new_price")).alias("new_price"), whole(F.col("new_qty")).alias("projected_qty"),
        rnd(F.col("new_revenue")).alias("new_revenue"), rnd(F.col("new_profit")).alias("new_profit"),
        rnd(F.col("new_margin")).alias("new_margin"), F.col("new_class").alias("new_classification"),
    )


def transition(old: Column, new: Column) -> Column:
    return F.when(old == new, F.concat(F.lit("Stays "), old)).otherwise(F.concat(old, F.lit(" → "), new))


def delta(priced: DataFrame, price_pct: float, cost_pct: float) -> DataFrame:
    """Change of every measure in %, NULL without a base, and class transition."""
    o = with_outcome(priced, p0() * F.lit(1 + price_pct / 100), c0() * F.lit(1 + cost_pct / 100))
    return o.select(
        "user_id", "product",
        pct_change(p0(), F.col("new_price")).alias("price_change_pct"),
        pct_change(c0(), F.col("new_cost")).alias("cost_change_pct"),
        pct_change(q0(), whole(F.col("new_qty"))).alias("qty_change_pct"),
        pct_change(F.col("revenue"), rnd(F.col("new_revenue"))).alias("revenue_change_pct"),
        pct_change(F.col("profit"), rnd(F.col("new_profit"))).alias("profit_change_pct"),
        transition(F.col("classification"), F.col("new_class")).alias("classification_change"),
    )


# -- price suggestion --------------------------------------------------------


def gains(suggested: Column) -> Column:
    """A discount counts only when the projected profit exceeds today's."""
    new = project_qty(q0(), p0(), suggested, e0()) * (suggested - c0())
    return (suggested > 0) & (p0() > 0) & (new > q0() * (p0() - c0()))


def _above(price: Column) -> Column:
    """Rounded-up test price, at least one unit over today's."""
    return F.when(price <= F.rint(p0()), F.rint(p0()) + 1).otherwise(price)


def _below(price: Column) -> Column:
    return F.when(price >= F.rint(p0()), F.rint(p0()) - 1).otherwise(price)


def candidates(priced: DataFrame) -> DataFrame:
    """Prices each rule would propose: Dog and Puzzle discount, the Lerner
    optimum (only where demand is elastic enough for one) and its 20 % bounds."""
    dog, puzzle = F.col("dog_price"), F.col("puzzle_price")
    theory = F.col("theoretical")
    step = priced.withColumns({
        "dog_price": F.greatest(_below(F.greatest(F.rint(p0() * 0.90), F.ceil(c0() * 1.20).cast("double"))), F.ceil(c0() * 1.05).cast("double")),
        "puzzle_price": _below(F.greatest(F.rint(p0() * 0.92), F.ceil(c0() * 1.30).cast("double"))),
        "theoretical": F.when(e0() <= ELASTIC_BELOW, e0() * c0() / (1.0 + e0())),
    })
    return step.withColumns({
        "dog_pays": (e0() < ELASTIC_BELOW) & gains(dog),
        "puzzle_pays": (e0() < ELASTIC_BELOW) & gains(puzzle),
        "bounded": F.least(F.greatest(theory, p0() * 0.8), p0() * 1.2),
    })


def star_would_drop(price: Column) -> Column:
    """A Star cut to ``price`` would fall below the margin cutoff."""
    cut = F.col("margin_cut")
    margin = F.when(price > 0, (price - c0()) / price * 100.0).otherwise(0.0)
    return (F.col("classification") == "Star") & (price < p0()) & (cut > 0) & (margin < cut)


def with_suggestion(priced: DataFrame, star_hold: bool = True) -> DataFrame:
    """Append the suggested price and the kind of the rule behind it."""
    cls, theory, frac = F.col("classification"), F.col("theoretical"), F.col("margin_cut") / 100.0
    kind = (
        F.when(cls == "Dog", F.when(F.col("dog_pays"), "dog_discount").otherwise("dog_remove"))
        .when(cls == "Puzzle", F.when(F.col("puzzle_pays"), "puzzle_discount").otherwise("puzzle_visibility"))
        .when(e0() > ELASTIC_BELOW, "test_increase")
        .when(F.lit(star_hold) & star_would_drop(F.col("bounded")), "star_protect")
        .when(theory > p0() * 1.2, "capped_up")
        .when(theory < p0() * 0.8, "capped_down")
        .otherwise("direct")
    )
    k = F.col("kind")
    price = (
        F.when(k == "dog_discount", F.col("dog_price"))
        .when(k == "puzzle_discount", F.col("puzzle_price"))
        .when(k.isin("dog_remove", "star_protect"), F.rint(p0()))
        .when(k == "puzzle_visibility", _above(F.ceil(p0() * 1.05).cast("double")))
        .when(k == "test_increase", _above(F.ceil(p0() * 1.10).cast("double")))
        .otherwise(F.rint(F.col("bounded")))
    )
    return candidates(priced).withColumn("kind", kind).withColumns({
        "suggested": price,
        "inelastic": k.isin("dog_remove", "puzzle_visibility", "test_increase"),
        "theoretical": F.when(k.isin("direct", "capped_up", "capped_down"), F.rint(theory)),
        "demotion_price": F.when(k == "star_protect", rnd(F.when((frac < 1) & (frac > 0), c0() / (1.0 - frac)).otherwise(p0()))),
    })


def optimal(priced: DataFrame) -> DataFrame:
    return with_suggestion(priced).select(
        "user_id", "product", "classification", "price",
        F.col("suggested").cast("bigint").alias("suggested_price"), "kind", "inelastic",
        F.col("theoretical").cast("bigint").alias("theoretical_price"), "demotion_price",
    )


def class_prices(priced: DataFrame, classification: str) -> DataFrame:
    """Suggestions of one class (Dog or Puzzle)."""
    return optimal(priced.filter(F.col("classification") == classification)).select(
        "user_id", "product", "price", "suggested_price", "kind"
    )


def profit_guard(priced: DataFrame) -> DataFrame:
    """Does the class discount pay? For every Dog and Puzzle."""
    is_dog = F.col("classification") == "Dog"
    candidate = F.when(is_dog, F.col("dog_price")).otherwise(F.col("puzzle_price"))
    chosen = candidates(priced.filter(F.col("classification").isin("Dog", "Puzzle"))).withColumn("candidate", candidate)
    return chosen.select(
        "user_id", "product", "classification", F.col("candidate").cast("bigint").alias("candidate"),
        gains(F.col("candidate")).alias("pays"),
    )


def star_protect(priced: DataFrame) -> DataFrame:
    """Every Star: is its price held, and the price below which it is demoted."""
    held = F.col("kind") == "star_protect"
    return with_suggestion(priced.filter(F.col("classification") == "Star")).select(
        "user_id", "product", "price", "cost", rnd(F.col("margin_cut")).alias("margin_cut"),
        held.alias("held"), F.when(held, F.col("demotion_price")).alias("demotion_price"),
    )


def _direction(suggested: Column) -> Column:
    now, new = F.rint(p0()), F.rint(suggested)
    return F.when(new > now, "raise").when(new < now, "lower").otherwise("hold")


def direction(priced: DataFrame) -> DataFrame:
    s = F.col("suggested")
    return with_outcome(with_suggestion(priced), s).select(
        "user_id", "product", _direction(s).alias("direction"),
        F.when(p0() > 0, pct_change(p0(), s)).alias("price_change_pct"),
        F.col("new_class").alias("new_classification"),
        transition(F.col("classification"), F.col("new_class")).alias("classification_change"),
        whole(F.col("new_qty")).alias("projected_qty"), rnd(F.col("new_profit")).alias("projected_profit"),
        rnd(F.col("new_margin")).alias("projected_margin"),
        pct_change(F.col("profit"), rnd(F.col("new_profit"))).alias("profit_change_pct"),
    )


# -- cost suggestion ---------------------------------------------------------


def cost_target(category_cap: bool = True) -> Column:
    """Suggested unit cost in half units, NULL where no cut is worth it."""
    cap = F.col("cost_cap") if category_cap else F.lit(rules.DEFAULT_COST_CAP)
    ref = F.when(F.col("suggested") > 0, F.col("suggested")).otherwise(p0())
    for_mean, floor = ref * (1.0 - F.col("margin_cut") / 100.0), c0() * (1.0 - cap)
    target = F.when(for_mean < c0(), F.floor(F.greatest(for_mean, floor) * 2.0) / 2.0).otherwise(F.ceil(floor * 2.0) / 2.0)
    worth = (p0() > 0) & (c0() >= 1) & (target < c0()) & ((c0() - target) / c0() >= 0.05)
    return F.when(worth, target)


def with_cost(suggested: DataFrame, category_cap: bool = True) -> DataFrame:
    """Cost target with what it does to class and profit."""
    t, cut = F.col("target_cost"), F.col("margin_cut")
    ref = F.when(F.col("suggested") > 0, F.col("suggested")).otherwise(p0())
    cls = lambda base: quadrant(F.col("popularity"), (base - t) / base * 100.0, F.col("pop_cut"), cut)
    have = t.isNotNull()
    return suggested.withColumn("target_cost", cost_target(category_cap)).withColumns({
        "reduction_pct": F.when(have, (c0() - t) / c0() * 100.0),
        "cost_gain": F.when(have, (c0() - t) * q0()),
        "class_at_suggested": F.when(have, cls(ref)),
        "class_at_current": F.when(have, cls(p0())),
    })


def cost_lowering(priced: DataFrame) -> DataFrame:
    """Cost target of every item, NULL where no cut is suggested."""
    cls = F.col("classification")
    return with_cost(with_suggestion(priced)).select(
        "user_id", "product", "cost", F.col("target_cost").alias("suggested_cost"),
        rnd(F.col("reduction_pct"), 1).alias("reduction_pct"), rnd(F.col("cost_gain")).alias("additional_profit"),
        cls.alias("current_classification"), F.col("class_at_suggested").alias("new_classification"),
        (F.col("class_at_suggested") != cls).alias("moves_classification"),
        F.col("class_at_current").alias("classification_at_current_price"),
        (F.col("class_at_current") != cls).alias("flips_at_current_price"),
    )


# -- grid searches -----------------------------------------------------------


def _closest(start: pd.Series, stop: pd.Series, cost: pd.Series, goal: pd.Series, qty: pd.Series, price: pd.Series, elasticity: pd.Series) -> pd.Series:
    """Of evenly spaced prices the one whose profit is closest to ``goal``, the
    first on ties. Arrow batches and one vectorised power per grid point: the
    same search as a lambda over an array column runs interpreted, row by row."""
    best_gap = np.full(len(start), np.inf)
    best_price = np.full(len(start), np.nan)
    step = (stop - start).to_numpy() / (SEARCH_POINTS - 1)
    for i in range(SEARCH_POINTS):
        p = stop.to_numpy() if i == SEARCH_POINTS - 1 else start.to_numpy() + i * step
        gap = np.abs(qty.to_numpy() * (p / price.to_numpy()) ** elasticity.to_numpy() * (p - cost.to_numpy()) - goal.to_numpy())
        closer = gap < best_gap
        best_gap = np.where(closer, gap, best_gap)
        best_price = np.where(closer, p, best_price)
    return pd.Series(best_price)


def _search(start: Column, stop: Column, cost: Column) -> Column:
    search = F.pandas_udf(_closest, "double")
    return search(start, stop, cost, F.col("profit"), q0().cast("double"), p0(), e0())


def break_even(priced: DataFrame) -> DataFrame:
    best = _search(F.greatest(F.lit(0.01), p0() * 0.3), p0() * 3.0, c0())
    return priced.select(
        "user_id", "product", F.when((q0() > 0) & (p0() > 0), rnd(best)).alias("break_even_price")
    )


def cost_defense(priced: DataFrame, rise_pct: float = 20.0) -> DataFrame:
    """Prices that keep the margin, and the profit, when the cost rises."""
    new_cost = c0() * (1 + rise_pct / 100)
    keep_margin = F.when(c0() > 0, p0() * (new_cost / c0())).otherwise(p0())
    keep_profit = _search(p0(), p0() * 3.0, new_cost)
    return priced.withColumns({"new_cost": new_cost, "km": keep_margin, "kp": keep_profit}).select(
        "user_id", "product", rnd(F.col("new_cost")).alias("new_cost"),
        rnd(F.col("km")).alias("keep_margin_price"), rnd((F.col("km") - p0()) / p0() * 100.0, 1).alias("keep_margin_pct"),
        rnd(F.col("kp")).alias("keep_profit_price"), rnd((F.col("kp") - p0()) / p0() * 100.0, 1).alias("keep_profit_pct"),
    )


# -- bulk and variants -------------------------------------------------------


def bulk_items(priced: DataFrame, change_pct: float) -> DataFrame:
    new_price = p0() * F.lit(1 + change_pct / 100)
    qty = project_qty(q0(), p0(), new_price, e0())
    return priced.withColumns({"new_price": new_price, "new_qty": qty}).withColumns({
        "new_rev": qty * new_price, "new_prof": qty * (new_price - c0()),
    })


def bulk(priced: DataFrame, change_pct: float) -> DataFrame:
    """The same change for every item of a class: before and after, for the
    class and for the menu, for each of the four classes."""
    m = lambda c: micro_sum(F.col(c), 4)
    groups = bulk_items(priced, change_pct).groupBy("user_id", "classification").agg(
        F.count("*").alias("item_count"), m("revenue").alias("rev"), m("profit").alias("prof"),
        m("new_rev").alias("new_rev"), m("new_prof").alias("new_prof"),
    )
    menu = groups.groupBy("user_id").agg(m("rev").alias("menu_rev"), m("prof").alias("menu_prof"))
    rev, prof = F.col("menu_rev") - F.col("rev") + F.col("new_rev"), F.col("menu_prof") - F.col("prof") + F.col("new_prof")
    return groups.join(menu, "user_id").select(
        "user_id", "classification", "item_count",
        rnd(F.col("rev")).alias("current_revenue"), rnd(F.col("new_rev")).alias("new_revenue"),
        pct_change(F.col("rev"), F.col("new_rev")).alias("revenue_change_pct"),
        rnd(F.col("prof")).alias("current_profit"), rnd(F.col("new_prof")).alias("new_profit"),
        pct_change(F.col("prof"), F.col("new_prof")).alias("profit_change_pct"),
        rnd(F.col("menu_rev")).alias("menu_revenue"), rnd(rev).alias("new_menu_revenue"),
        pct_change(F.col("menu_rev"), rev).alias("menu_revenue_change_pct"),
        rnd(F.col("menu_prof")).alias("menu_profit"), rnd(prof).alias("new_menu_profit"),
        pct_change(F.col("menu_prof"), prof).alias("menu_profit_change_pct"),
    )


def linear_demand(priced: DataFrame, adjustments: tuple[int, ...] = (-2, 2)) -> DataFrame:
    """Linear variant: demand falls 15 % per price unit share up, rises 10 % down."""
    steps = values(priced.sparkSession, [(a,) for a in adjustments], "adjust int")
    a, new_price = F.col("adjust"), p0() + F.col("adjust")
    demand = F.when(a > 0, -(a / p0()) * 15.0).otherwise(F.abs(a) / p0() * 10.0)
    gain = (new_price - c0()) * q0() * (1.0 + demand / 100.0) - (p0() - c0()) * q0()
    return priced.crossJoin(F.broadcast(steps)).select(
        "user_id", "product", "adjust", rnd(demand, 4).alias("demand_change_pct"),
        rnd((new_price - c0()) / new_price * 100.0).alias("new_margin"), rnd(gain).alias("profit_change"),
    )


# -- which lever -------------------------------------------------------------


def lever(priced: DataFrame, production: bool = True) -> DataFrame:
    """Which single lever the rule shows, and which one earns more.

    ``production=False`` leaves out the Star hold and the category cost caps.
    """
    d = with_outcome(with_cost(with_suggestion(priced, production), production), F.col("suggested")).withColumns({
        "direction": _direction(F.col("suggested")),
        "price_lift": rnd(F.col("new_profit")) - F.col("profit"),
        "price_flips": F.col("new_class") != F.col("classification"),
        "has_cost": F.col("target_cost").isNotNull(),
        "cost_lift": F.coalesce(rnd(F.col("cost_gain")), F.lit(0.0)),
        "cost_flips": F.coalesce(F.col("class_at_current") != F.col("classification"), F.lit(False)),
    })
    cost_lift, price_lift = F.col("cost_lift"), F.col("price_lift")
    has_cost, hold = F.col("has_cost"), F.col("direction") == "hold"
    more = F.when(cost_lift > price_lift, "cost").otherwise("price")
    tied = F.abs(cost_lift - price_lift) <= F.greatest(F.lit(50.0), F.greatest(cost_lift, price_lift) * 0.05)
    shown = F.when(has_cost & (hold | (F.col("cost_flips") & (cost_lift > price_lift))), "cost").otherwise("price")
    pays = price_lift > 0.5
    best = (
        F.when(~has_cost & ~pays, "neither")
        .when(~has_cost, "price")
        .when(~pays | hold, "cost")
        .when(tied & F.col("cost_flips") & ~F.col("price_flips"), "cost")
        .when(tied & F.col("price_flips") & ~F.col("cost_flips"), "price")
        .otherwise(more)
    )
    d = d.withColumn("system_primary", shown).withColumn("expected_primary", best)
    return d.select(
        "user_id", "product", "classification", "price", "cost", "kind", "direction", "target_cost",
        rnd(price_lift).alias("price_lift"), rnd(cost_lift).alias("cost_lift"), "price_flips", "cost_flips",
        "system_primary", "expected_primary",
        (F.col("system_primary") != F.col("expected_primary")).alias("mismatch"),
        rnd(F.abs(cost_lift - price_lift)).alias("magnitude"),
    )


def lever_summary(levers: DataFrame) -> DataFrame:
    """Right and wrong picks per class, mismatch directions, and the five
    largest mismatches, in long form."""
    text = lambda c: c.cast("string")
    wrong = levers.filter("mismatch")
    by_class = levers.groupBy("user_id", "classification").agg(
        F.count_if(~F.col("mismatch")).alias("right"), F.count_if("mismatch").alias("wrong")
    )
    classes = by_class.select(
        "user_id", F.lit("class").alias("section"), F.col("classification").alias("name"),
        F.concat_ws("/", text(F.col("right")), text(F.col("wrong"))).alias("value"),
    )
    ways = wrong.groupBy("user_id", "system_primary", "expected_primary").agg(F.count("*").alias("n")).select(
        "user_id", F.lit("direction").alias("section"),
        F.concat_ws("->", "system_primary", "expected_primary").alias("name"), text(F.col("n")).alias("value"),
    )
    top = top_k(wrong, ["user_id"], [F.col("magnitude").desc(), F.col("product")], 5).select(
        "user_id", F.lit("top").alias("section"), "product", text(F.col("place"))
    )
    return classes.unionByName(ways).union(top)


def lever_skipped(levers: DataFrame) -> DataFrame:
    """Items without a cost suggestion, counted by reason."""
    reason = F.when(c0() < 1, "cost below 1").otherwise("cut below 5 %")
    return levers.filter(F.col("target_cost").isNull()).groupBy("user_id", reason.alias("reason")).agg(F.count("*").alias("items"))


def suggestion_audit(priced: DataFrame) -> DataFrame:
    """Profit change of every suggestion by the demand model; losing more than
    1 is flagged."""
    s = F.col("suggested")
    change = project_qty(q0(), p0(), s, e0()) * (s - c0()) - q0() * (p0() - c0())
    return with_suggestion(priced).withColumn("change", change).select(
        "user_id", "product", "kind", F.col("suggested").cast("bigint").alias("suggested_price"),
        rnd(F.col("change")).alias("profit_delta"), (F.col("change") < -1).alias("loses"),
    )


def discount_overshoot(priced: DataFrame) -> DataFrame:
    """Realised against intended discount of Dogs and Puzzles."""
    intended = F.when(F.col("classification") == "Dog", -10.0).otherwise(-8.0)
    realised = rnd((F.col("suggested") - p0()) / p0() * 100.0)
    return with_suggestion(priced.filter(F.col("classification").isin("Dog", "Puzzle"))).select(
        "user_id", "product", "classification", "kind", intended.alias("intended_pct"), realised.alias("realised_pct"),
        rnd(realised - intended).alias("overshoot_pp"),
    )
