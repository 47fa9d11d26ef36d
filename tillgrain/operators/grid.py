"""The grid of products and days as arrays, for what needs all days of a product.

The days of a group (a workspace, or a workspace as a fold knew it) are a small
table, bounded by the calendar and sent to every task. A task streams rows of
products, each with its cells, and makes the values of a batch as one array of
products x days: the same arithmetic as ``factored``, digit by digit, without a
row for each product and day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillgrain.functions import labels
from tillgrain.functions.numeric import MICRO
from tillgrain.operators import factored
from tillgrain.operators.forecast import QTY

#: slot codes run from 7 (Monday in the first season) to below this
SLOTS = (len(labels.SEASONS) + 1) * 7
#: products whose values are made at a time
CHUNK = 2048


def rnd(x: np.ndarray, digits: int) -> np.ndarray:
    """``numeric.rnd`` on an array."""
    scale = float(10**digits)
    return np.rint(x * scale) / scale + 0.0


class Groups:
    """Days and shares of every group, padded to one length: ``ds`` and ``yhat`` of
    its days, the quantity and total of its slots, and its totals by period."""

    def __init__(self, table: pa.Table, by: list[str]) -> None:
        rows = table.to_pylist()
        size = max((len(r["days"]) for r in rows), default=0)
        shape = (len(rows), size)
        self.by, self.index = by, {tuple(r[k] for k in by): i for i, r in enumerate(rows)}
        self.ds, self.slot = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        self.yhat, self.there = np.zeros(shape), np.zeros(shape, bool)
        self.slot_sum, self.slot_qty = np.full((len(rows), SLOTS), np.nan), np.full((len(rows), SLOTS), np.nan)
        self.all_qty, self.period = np.full(len(rows), np.nan), np.full((len(rows), len(labels.PERIODS)), np.nan)
        number = lambda v: np.nan if v is None else float(v)
        for i, r in enumerate(rows):
            for j, d in enumerate(r["days"]):
                self.ds[i, j], self.slot[i, j], self.yhat[i, j], self.there[i, j] = d["ds"], d["slot"], number(d["yhat"]), True
                self.slot_sum[i, d["slot"]] = d["slot_sum"]
            for slot, qty in r["slot_qtys"] or []:
                self.slot_qty[i, slot] = number(qty) or np.nan
            self.all_qty[i] = number(r["all_qty"]) or np.nan
            self.period[i] = [number(r[f"period_{p}"]) for p in labels.PERIODS]
        if (self.slot_sum == 0).any():
            raise ZeroDivisionError("the shares of a slot add up to 0")

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The group of every row, -1 for one without days."""
        keys = zip(*[batch.column(k).to_pylist() for k in self.by])
        return np.fromiter((self.index.get(k, -1) for k in keys), np.int64, batch.num_rows)


def groups(daily: DataFrame, cells: DataFrame, by: list[str]) -> Groups:
    """Group table of ``daily`` (ds, yhat): a row a group, days bounded by the calendar."""
    days = factored.slot_days(daily, cells, by).select(*by, F.struct(F.datediff("ds", F.lit("1970-01-01").cast("date")).alias("ds"), "slot", "slot_sum", "yhat").alias("d"))
    ahead = days.groupBy(*by).agg(F.array_sort(F.collect_list("d")).alias("days"))
    return Groups(factored.group_shares(cells, by).join(ahead, by).toArrow(), by)


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NULL as NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _list(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Row of each element of a list column, and the elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def shares(batch: pa.RecordBatch, g: np.ndarray, known: Groups) -> np.ndarray:
    """Share of every product of the batch in every slot of its group, all periods:
    that of an observed cell, else the fallback, over the slot's total."""
    at, held = _list(batch.column("cells"))
    slot = held.field("slot")
    named = batch.column("product").is_valid().to_numpy(zero_copy_only=False)[at] & slot.is_valid().to_numpy(zero_copy_only=False)
    slot = np.where(named, slot.fill_null(0).to_numpy(zero_copy_only=False), 0)
    ratio = _numbers(batch.column("product_qty")) / known.all_qty[g]
    total = None
    for i, q in enumerate(QTY):
        part = np.repeat((ratio * known.period[g, i])[:, None], SLOTS, axis=1)
        seen = _numbers(held.field(q)) / known.slot_qty[g[at], slot]
        ok = named & (seen > 0)
        part[at[ok], slot[ok]] = seen[ok]
        part /= known.slot_sum[g]
        total = part if total is None else total + part
    return total


def chunks(batches: Iterator[pa.RecordBatch], known: Groups) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with the group of each product and its value on every
    day of the group (see ``factored.cell``); beyond the group's days it is 0."""
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(start, CHUNK)
            g = known.of(piece)
            if (g < 0).any():
                piece = piece.filter(pa.array(g >= 0))
                g = g[g >= 0]
            if not len(g):
                continue
            with np.errstate(invalid="ignore"):
                share = np.take_along_axis(shares(piece, g, known), known.slot[g], 1)
                value = rnd(rnd(np.fmax(known.yhat[g] * share, 0.0), 10), 6)
            yield piece, g, np.where(known.there[g], value, 0.0)


def micro(x: np.ndarray) -> np.ndarray:
    """On the grid of six places, as integers."""
    return np.rint(x * float(MICRO)).astype(np.int64)


def listed(rows: int, there: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
    """A list of structs for each row, of the elements that are there."""
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


# -- whole units of every day ------------------------------------------------------


def largest_remainder(value: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Integers of each row that add up to its rounded sum: what is left goes to
    the largest fractions, the earlier day first (``forecast.round_to_total``)."""
    size = value.shape[1]
    floor = np.floor(value)
    left = np.maximum(np.rint(micro(value).sum(axis=1) / float(MICRO)), 0.0).astype(np.int64) - floor.astype(np.int64).sum(axis=1)
    # one number a day orders it: its fraction on the grid, then its place
    order = np.where(there, micro(rnd(value - floor, 6)) * size + (size - 1 - np.arange(size)), -1)
    k = np.clip(left, 0, there.sum(axis=1))
    least = np.take_along_axis(np.sort(order, axis=1), np.maximum(size - k, 0).clip(max=size - 1)[:, None], 1)
    return floor.astype(np.int64) + ((order >= least) & (k > 0)[:, None] & there)


def product_units(daily: DataFrame, cells: DataFrame, price: str) -> DataFrame:
    """(user_id, product, ds, units, revenue, is_peak) of every product's days:
    integers by largest remainder, revenue from the ``price`` column of ``cells``
    (0 when unknown), and the first day with most units."""
    known = groups(daily, cells, ["user_id"])
    inner = pa.struct([("ds", pa.date32()), ("units", pa.int64()), ("revenue", pa.float64()), ("is_peak", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, g, value in chunks(batches, known):
            there = known.there[g]
            units = largest_remainder(value, there)
            peak = np.arange(value.shape[1]) == np.argmax(np.where(there, units, -1), axis=1)[:, None]
            revenue = rnd(value * np.nan_to_num(_numbers(piece.column(price)))[:, None], 2)
            days = listed(len(g), there, {"ds": pa.array(known.ds[g][there]).cast(pa.date32()), "units": pa.array(units[there]),
                                          "revenue": pa.array(revenue[there]), "is_peak": pa.array(peak[there])})
            yield pa.record_batch([piece.column("user_id"), piece.column("product"), days.cast(pa.list_(inner))], names=["user_id", "product", "days"])

    kind = cells.schema
    done = cells.select("user_id", "product", "product_qty", "cells", price).mapInArrow(
        run, f"user_id {kind['user_id'].dataType.simpleString()}, product string, days array<struct<ds: date, units: bigint, revenue: double, is_peak: boolean>>")
    return done.select("user_id", "product", F.inline("days"))


# -- errors of every day -------------------------------------------------------------

#: sums of a product's days that its metrics are made of
SUMS = "n bigint, abs_e bigint, square double, abs_y bigint, ape double, n_ape bigint, e bigint, y bigint, yhat bigint"


def product_errors(daily: DataFrame, cells: DataFrame, sold_cells: DataFrame, by: list[str]) -> DataFrame:
    """For each group and product the sums (``SUMS``) of its forecast errors over the
    group's days. ``sold_cells`` are the rows of ``cells`` with ``sold``: the product's
    days with sales (ds, y), NULL without any; what is not sold on a day is 0."""
    known = groups(daily, cells, by)
    first = int(known.ds[known.there].min()) if known.there.any() else 0
    span = int(known.ds[known.there].max()) - first + 1 if known.there.any() else 1
    place = np.full((len(known.ds), span), -1, np.int32)
    for i, days in enumerate(known.ds):
        place[i, days[known.there[i]] - first] = np.flatnonzero(known.there[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, g, value in chunks(batches, known):
            there = known.there[g]
            at, sold = _list(piece.column("sold"))
            day = sold.field("ds").cast(pa.int32()).to_numpy(zero_copy_only=False) - first
            inside = (day >= 0) & (day < span)
            to = np.where(inside, place[g[at], np.where(inside, day, 0)], -1)
            hit = to >= 0
            y = np.zeros(value.shape)
            y[at[hit], to[hit]] = _numbers(sold.field("y"))[hit]
            e = np.where(there, value - y, 0.0)
            some = there & (y > 0)
            ape = np.divide(np.abs(e), y, out=np.zeros_like(e), where=some)
            sums = [there.sum(axis=1), micro(np.abs(e)).sum(axis=1), (e * e).sum(axis=1), micro(np.abs(y)).sum(axis=1), ape.sum(axis=1), some.sum(axis=1),
                    micro(e).sum(axis=1), micro(y).sum(axis=1), micro(value).sum(axis=1)]
            yield pa.record_batch([piece.column("product"), *(pa.array(s) for s in sums)], names=["product", *(c.split()[0] for c in SUMS.split(", "))])

    return sold_cells.select(*by, "product", "product_qty", "cells", "sold").mapInArrow(run, f"product string, {SUMS}")
