"""The forecast as factors: a daily value times the share of its slot.

A cell of the grid (day x product x period) is the day's value times

    (fallback(product, period) + lift(slot, product, period)) / total(slot)

with a slot being the season and weekday of the day, and a lift being there only
for cells the history has seen. So a sum over cells is a sum over the observed
cells and the products, weighted by the value that falls into each slot: no
product x day table is built for any of them. ``expand`` multiplies out, where
the cells themselves are wanted.

``cells`` is the stored table of ``forecast.cells``: a row a product that holds
its cells, at most 28 slots of four periods. Shares are read off that row and
what its group knows (``group_shares``, joined by group alone), so products are
neither sorted nor exchanged again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tillgrain.functions import labels
from tillgrain.functions.numeric import MICRO, rnd, share, whole
from tillgrain.operators.forecast import QTY, USER, slot_code, with_slot_names
from tillgrain.session import once, through_table

SLOT = ["season", "dow"]
#: a table of that many days of workspaces is sent to every task, some 40 MB
SENT_DAYS = 1_000_000


def exact_sum(value: Column) -> Column:
    """Sum of shares on a decimal grid: small terms keep their digits, and the
    result does not depend on the order in which partial sums meet."""
    return F.sum(value.cast("decimal(32,15)")).cast("double")


def cell(value: Column) -> Column:
    """A value of the grid: six places, after noise beyond the tenth is rounded
    off, so that halves fall to the same side whatever way they were computed."""
    return rnd(rnd(F.greatest(value, F.lit(0.0)), 10), 6)


def with_slot(days: DataFrame) -> DataFrame:
    ds = F.col("ds")
    return days.withColumns({"season": labels.season_local(ds), "dow": labels.dow(ds)})


def margins(cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """Per group, slot and period: quantity of the cells, and of the cells above
    (``up``) and below 0 (``down``) with that of their products (``_held``). At most
    112 rows a group; stored, because every share is made from them and a stored
    table has a size that joins can go by."""
    named = F.col("product").isNotNull()
    sums = []
    for i, q in enumerate(QTY):
        signed = {"up": named & (F.col(q) > 0), "down": named & (F.col(q) < 0)}
        held = [F.sum(F.when(test, F.col(c))).alias(f"{name}{i}") for n, test in signed.items() for c, name in ((q, n), ("product_qty", f"{n}_held"))]
        sums += [F.sum(q).alias(q), *held]
    names = ["up", "up_held", "down", "down_held"]
    pairs = F.array(*[F.struct(F.lit(p).alias("time_period"), F.col(f"q{i}").alias("qty"), *[F.col(f"{n}{i}").alias(n) for n in names]) for i, p in enumerate(labels.PERIODS)])
    rows = cells.select(*by, "product", "product_qty", F.inline("cells")).groupBy(*by, "slot").agg(*sums)
    flat = with_slot_names(rows.select(*by, "slot", F.inline(pairs)).filter(F.col("qty").isNotNull()))
    return once(("margins", cells, *by), lambda: through_table(flat, "margins"))


def slot_qty(cells: DataFrame, by: list[str] = USER) -> DataFrame:
    return margins(cells, by).groupBy(*by, *SLOT).agg(F.sum("qty").alias("slot_qty"))


def group_shares(cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """One row a group: its quantity (``all_qty``), the share of each period
    (``period_<name>``) and the quantity of each slot (``slot_qtys``). Small: a sum
    over ``margins``."""
    sums = [F.sum(F.when(F.col("time_period") == p, F.col("qty")).otherwise(0)).alias(f"qty_{p}") for p in labels.PERIODS]
    slot = margins(cells, by).filter(F.col("slot").isNotNull()).groupBy(*by, "slot").agg(F.sum("qty").alias("slot_qty")).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "slot_qty"))).alias("slot_qtys"))
    both = margins(cells, by).groupBy(*by).agg(F.sum("qty").alias("all_qty"), *sums).join(slot, by, "left").select(
        *by, "all_qty", *[share(F.col(f"qty_{p}"), F.col("all_qty")).alias(f"period_{p}") for p in labels.PERIODS], "slot_qtys")
    return once(("group-shares", cells, *by), lambda: through_table(both, "group-shares"))


def fractions(c: Column) -> list[Column]:
    """Shares of a slot's cells (``c``, one of ``cells``) in their slot, by period;
    NULL unless above 0 and of a named product."""
    known = [share(c[q], F.try_element_at("slot_qtys", c["slot"])) for q in QTY]
    return [F.when((f > 0) & F.col("product").isNotNull(), f) for f in known]


def fallback(p: str, qty: Column | str = "product_qty") -> Column:
    """Fallback share of a period, of a row with ``qty`` and the group's shares."""
    return share(F.col(qty) if isinstance(qty, str) else qty, F.col("all_qty")) * F.col(f"period_{p}")


def own_fallback(qty: Column | str = "product_qty") -> Column:
    """Fallback share of the period a row is about."""
    out = F.lit(None).cast("double")
    for p in labels.PERIODS:
        out = F.when(F.col("time_period") == p, fallback(p, qty)).otherwise(out)
    return out


def slot_total(cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """What the shares of a slot add up to before normalising. The fallbacks of
    all cells sum to 1, so only observed cells are needed, and of them only their
    quantities and those of their products."""
    # cells with a share above 0 are those of their slot's sign
    up = F.col("slot_qty") > 0
    qty, held = (F.when(up, F.col(f"up{c}")).otherwise(F.col(f"down{c}")) for c in ("", "_held"))
    seen = margins(cells, by).join(slot_qty(cells, by), [*by, *SLOT]).filter((F.col("slot_qty") != 0) & qty.isNotNull()).join(group_shares(cells, by), by)
    lift = share(qty, F.col("slot_qty")) - own_fallback(held)
    return seen.groupBy(*by, *SLOT).agg((exact_sum(lift) + 1.0).alias("slot_sum"))


def slots(daily: DataFrame, cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """The slots in use with the value that falls into them and their total;
    stored, a few rows a group."""
    used = with_slot(daily).groupBy(*by, *SLOT).agg(exact_sum(F.col("yhat")).alias("units"), F.count("*").alias("n_days"))
    both = used.join(slot_total(cells, by), [*by, *SLOT], "left").withColumn("slot_sum", F.coalesce("slot_sum", F.lit(1.0)))
    return once(("slots", daily, cells, *by), lambda: through_table(both, "slots"))


def wide_totals(daily: DataFrame, cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """Sum of the cells of every product over the days of ``daily``: a row for each
    product, a column for each period.

    The lifts' weighted sum is taken apart into the fractions' and the weights of
    the slots seen, so a product's total is read off its row.
    """
    weight = F.col("units") / F.col("slot_sum")
    used = slots(daily, cells, by).select(*by, slot_code().alias("slot"), weight.alias("weight"))
    every = once(("group-weights", daily, cells, *by), lambda: through_table(used.groupBy(*by).agg(
        exact_sum(F.col("weight")).alias("weights"), F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("slot_weights")), "group-weights"))
    at = lambda c: F.try_element_at("slot_weights", c["slot"])
    # a product's cells in the slots in use: weight, and fraction times weight
    hits = F.transform("cells", lambda c: F.struct(*[e for i, f in enumerate(fractions(c)) for e in (
        (f * at(c)).cast("decimal(32,15)").alias(f"seen{i}"), F.when(f.isNotNull(), at(c)).cast("decimal(32,15)").alias(f"there{i}"))]))
    zero = F.lit(0).cast("decimal(33,15)")
    added = lambda name: F.aggregate("hits", zero, lambda a, h: F.coalesce((a + h[name]).cast("decimal(33,15)"), a)).cast("double")
    rows = cells.join(group_shares(cells, by), by).join(every, by).withColumn("hits", hits)
    total = lambda i, p: fallback(p) * (F.col("weights") - added(f"there{i}")) + added(f"seen{i}")
    return rows.select(*by, "product", *[cell(total(i, p)).alias(p) for i, p in enumerate(labels.PERIODS)])


def totals(daily: DataFrame, cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """Sum of the cells of every product and period over the days of ``daily``."""
    pairs = F.array(*[F.struct(F.lit(p).alias("time_period"), F.col(p).alias("total")) for p in labels.PERIODS])
    return wide_totals(daily, cells, by).select(*by, "product", F.inline(pairs))


def product_totals(daily: DataFrame, cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """A product's total: its periods' on the grid of six places, added as integers."""
    units = sum((F.rint(F.col(p) * float(MICRO)).cast("bigint") for p in labels.PERIODS[1:]), F.rint(F.col(labels.PERIODS[0]) * float(MICRO)).cast("bigint"))
    return wide_totals(daily, cells, by).select(*by, "product", (units / float(MICRO)).alias("total"))


def slot_values(daily: DataFrame, cells: DataFrame, values: dict[str, Column], extra: list[str] | None = None,
                items: DataFrame | None = None, by: list[str] = USER) -> DataFrame:
    """Per slot in use, and per ``extra`` (time_period or columns of ``items``):
    the sums of the shares times each of ``values``. Fallbacks and lifts of a
    product's row are added up in one pass; what is left is small and stored."""
    extra = list(extra or [])
    used = slots(daily, cells, by).select(*by, *SLOT, slot_code().alias("slot"), "slot_sum")
    rows = (cells if items is None else cells.join(items, [*by[:1], "product"], "left")).join(group_shares(cells, by), by)
    part = lambda slot, i, value: F.struct(slot.alias("slot"), F.lit(i).alias("period"), value.alias("part"))
    base = F.array(*[part(F.lit(None).cast("int"), i, fallback(p)) for i, p in enumerate(labels.PERIODS)])
    lift = lambda c: F.array(*[part(c["slot"], i, f - fallback(labels.PERIODS[i])) for i, f in enumerate(fractions(c))])
    rows = rows.select("*", F.inline(F.concat(base, F.flatten(F.transform("cells", lift))))).filter(F.col("slot").isNull() | F.col("part").isNotNull())
    rows = rows.withColumn("time_period", F.get(F.array(*[F.lit(p) for p in labels.PERIODS]), F.col("period")))
    summed = [exact_sum(F.col("part") * v).alias(n) for n, v in values.items()]
    sums = through_table(rows.groupBy(*by, "slot", *extra).agg(*summed), "slot-sums")
    seen = sums.filter(F.col("slot").isNotNull()).withColumnsRenamed({n: f"seen_{n}" for n in values})
    rows = sums.filter(F.col("slot").isNull()).drop("slot").join(used, by).join(seen, [*by, "slot", *extra], "left")
    return rows.select(*by, *SLOT, *extra, *[
        ((F.col(n) + F.coalesce(f"seen_{n}", F.lit(0.0))) / F.col("slot_sum")).alias(n) for n in values])


def by_day(daily: DataFrame, cells: DataFrame, values: dict[str, Column], extra: list[str] | None = None,
           items: DataFrame | None = None, by: list[str] = USER) -> DataFrame:
    """Per day (and ``extra``): the sums of the cells times each of ``values``."""
    factors = slot_values(daily, cells, values, extra, items, by).withColumnsRenamed({n: f"per_unit_{n}" for n in values})
    return with_slot(daily).join(factors, [*by, *SLOT]).select(
        *by, "ds", *(extra or []), *[cell(F.col("yhat") * F.col(f"per_unit_{n}")).alias(n) for n in values])


def product_rows(cells: DataFrame, by: list[str] = USER, only: DataFrame | None = None, more: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """Every product (or those of ``only``: user_id, product) once, with its
    fallbacks (``base_<period>``) and ``seen``: the fractions of each slot it was
    sold in, at most 28. What is known of a product (``more`` columns of ``known``,
    the same rows with more columns) is on its row before slots and days multiply it."""
    rows = cells if known is None else known
    kept = rows if only is None else rows.join(only, [*by[:1], "product"], "left_semi")
    held = F.filter("cells", lambda c: c["slot"].isNotNull())
    seen = F.transform(held, lambda c: F.struct(c["slot"].alias("slot"), F.struct(*[f.alias(p) for f, p in zip(fractions(c), labels.PERIODS)]).alias("f")))
    return kept.join(group_shares(cells, by), by).select(
        *by, "product", F.map_from_entries(seen).alias("seen"), *[fallback(p).alias(f"base_{p}") for p in labels.PERIODS], *more)


def _shares() -> list[Column]:
    """The shares of a product's row in the slot that has been joined to it."""
    at = F.try_element_at(F.col("seen"), F.col("slot"))
    return [(F.coalesce(at[p], F.col(f"base_{p}")) / F.col("slot_sum")).alias(p) for p in labels.PERIODS]


def _slots_of(daily: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    return slots(daily, cells, by).select(*by, *SLOT, slot_code().alias("slot"), "slot_sum")


def product_slots(daily: DataFrame, cells: DataFrame, by: list[str] = USER, only: DataFrame | None = None) -> DataFrame:
    """Shares of every product (or those of ``only``: user_id, product) in every
    slot in use, one column per period."""
    return product_rows(cells, by, only).join(_slots_of(daily, cells, by), by).select(*by, *SLOT, "product", *_shares())


def expand(daily: DataFrame, cells: DataFrame, by: list[str] = USER, more: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """The grid itself: a row for each day and product, a column for each period.
    The cells of a day add up to its forecast. ``known`` are the rows of ``cells``
    with ``more`` columns, which the grid then has too. Slots and days are joined
    by group alone, and nothing is exchanged after the cells were stored."""
    share_rows = product_rows(cells, by, None, more, known).join(_slots_of(daily, cells, by), by).select(*by, *SLOT, "product", *more, *_shares())
    return share_rows.join(_stored_days(daily, by), [*by, *SLOT]).select(
        *by, "ds", "product", *[cell(F.col("yhat") * F.col(p)).alias(p) for p in labels.PERIODS], *more)


def slot_days(daily: DataFrame, cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """The days with their slot as a number and its total."""
    return _stored_days(daily, by).join(_slots_of(daily, cells, by), [*by, *SLOT])


def _stored_days(daily: DataFrame, by: list[str]) -> DataFrame:
    """The days with their slots as a stored table: small, and known to be."""
    return once(("days", daily, *by), lambda: through_table(with_slot(daily).select(*by, "ds", *SLOT, "yhat"), "slot-days"))


def product_days(daily: DataFrame, cells: DataFrame, by: list[str] = USER, only: DataFrame | None = None) -> DataFrame:
    """Value of every product (or those of ``only``) on every day."""
    share = sum((F.col(p) for p in labels.PERIODS[1:]), F.col(labels.PERIODS[0]))
    factors = product_slots(daily, cells, by, only).select(*by, *SLOT, "product", share.alias("share"))
    return factors.join(_stored_days(daily, by), [*by, *SLOT]).select(
        *by, "ds", "product", cell(F.col("yhat") * F.col("share")).alias("yhat"))


def observed(fitted: DataFrame, cells: DataFrame, by: list[str] = USER) -> DataFrame:
    """Predicted next to observed quantity for every observed cell of the history,
    a row for each day and product: its share is known and stands on the product's
    row with its days (``forecast.cells`` with ``days``), so no grid is needed and
    nothing is joined by product."""
    days = through_table(with_slot(fitted.select(*by, "ds", "yhat")).join(slot_total(cells, by), [*by, *SLOT]).select(*by, "ds", "yhat", "slot_sum"), "fitted-days")
    if days.count() <= SENT_DAYS:  # else lines would be exchanged and sorted by day
        days = F.broadcast(days)
    at = lambda c: F.struct(c["days"].alias("days"), *[f.alias(f"f{i}") for i, f in enumerate(fractions(c))])
    rows = cells.join(group_shares(cells, by), by).select(*by, "product", F.inline(F.transform("cells", at)))
    rows = rows.select(*by, "product", "f0", "f1", "f2", "f3", F.inline("days")).join(days, [*by, "ds"])
    there = [F.col(q).isNotNull() & F.col(f"f{i}").isNotNull() for i, q in enumerate(QTY)]
    return rows.filter(there[0] | there[1] | there[2] | there[3]).select(
        *by, "ds", "product",
        *[F.when(there[i], cell(F.col("yhat") * F.col(f"f{i}") / F.col("slot_sum"))).alias(f"yhat_{p}") for i, p in enumerate(labels.PERIODS)],
        *[F.when(there[i], F.col(q)).alias(f"y_{labels.PERIODS[i]}") for i, q in enumerate(QTY)])


def observed_periods(past: DataFrame) -> DataFrame:
    """The observed cells as a row for each period."""
    pairs = F.array(*[F.struct(F.lit(p).alias("time_period"), F.col(f"yhat_{p}").alias("yhat"), F.col(f"y_{p}").alias("y")) for p in labels.PERIODS])
    return past.select("user_id", "ds", "product", F.inline(pairs)).filter(F.col("y").isNotNull())


def by_period(history: DataFrame, by: list[str] = USER) -> DataFrame:
    """Rows of a period (yhat, y) as columns for each period."""
    pick = lambda c, p: F.max(F.when(F.col("time_period") == p, F.col(c))).alias(f"{c}_{p}")
    return history.groupBy(*by, "ds", "product").agg(*[pick(c, p) for c in ("yhat", "y") for p in labels.PERIODS])


def percentage_error(y: Column, yhat: Column) -> Column:
    error = whole(F.try_divide(F.abs(y - yhat), y.cast("double")) * 100.0)
    return F.concat(F.coalesce(error.cast("string"), F.lit("<NA>")), F.lit("%"))


def with_actuals(past: DataFrame, ahead: DataFrame, by: list[str] = USER) -> DataFrame:
    """Observed cells and the future grid as one table: a row for each day and
    product, predicted and observed quantity and error of each period. ``type``
    tells days with an observation (actual) from those to come (future)."""
    future = ahead.select(*by, "ds", "product", *[F.col(p).alias(f"yhat_{p}") for p in labels.PERIODS],
                          *[F.lit(None).cast("bigint").alias(f"y_{p}") for p in labels.PERIODS])
    rows = past.withColumn("type", F.lit("actual")).unionByName(future.withColumn("type", F.lit("future")))
    return rows.withColumns({f"error_{p}": percentage_error(F.col(f"y_{p}"), F.col(f"yhat_{p}")) for p in labels.PERIODS})
