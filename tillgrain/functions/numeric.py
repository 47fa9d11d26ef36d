"""Rounding, division and exact sums shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: fixed-point scale of summed forecast quantities
MICRO = 1_000_000


def rnd(value: Column, digits: int = 2) -> Column:
    """Half-even rounding of a double to ``digits`` places."""
    scale = F.lit(float(10**digits))
    return F.rint(value.cast("double") * scale) / scale + F.lit(0.0)


def whole(value: Column) -> Column:
    """Half-even rounding of a double to a BIGINT."""
    return F.rint(value.cast("double")).cast("bigint")


def money(cents: Column) -> Column:
    """Integer cents as a currency amount."""
    return cents / F.lit(100.0)


def share(part: Column, total: Column) -> Column:
    """``part / total`` as a double, NULL when the total is 0."""
    return F.try_divide(part.cast("double"), total.cast("double"))


def pct_change(old: Column, new: Column, digits: int = 1) -> Column:
    """Change from ``old`` to ``new`` in %, NULL when ``old`` is 0."""
    return rnd(F.try_divide((new - old).cast("double"), old.cast("double")) * 100.0, digits)


def micro_sum(value: Column, digits: int = 6) -> Column:
    """Sum of a double with ``digits`` places kept exact: the result does not
    depend on the order in which partial sums meet. Money takes 4 digits, which
    leaves room for totals up to 10**14."""
    scale = float(10**digits)
    return F.sum(F.rint(value * scale).cast("bigint")) / scale


def micro_mean(value: Column) -> Column:
    """Mean on the same fixed-point grid; NULLs do not count."""
    return F.try_divide(
        F.sum(F.rint(value * float(MICRO)).cast("bigint")).cast("double"),
        F.count(value).cast("double"),
    ) / float(MICRO)
