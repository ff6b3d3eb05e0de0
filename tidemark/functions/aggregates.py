"""Aggregate expressions: usable in groupBy().agg() and, where noted, over frames."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import ratio


def vwap(value: Column, weight: Column) -> Column:
    """Sum of value * weight over the sum of weight, rows with both non-null only; null for none or weight 0."""
    both = value.isNotNull() & weight.isNotNull()
    return ratio(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def wavg(weight: Column, value: Column) -> Column:
    return vwap(value, weight)


def first_by(x: Column, *order: Column) -> Column:
    """x of the first row in order; the order should be total."""
    return F.min_by(x, F.struct(*order))


def last_by(x: Column, *order: Column) -> Column:
    return F.max_by(x, F.struct(*order))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation of rows with both; null with fewer than two of them or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((va > 0) & (vb > 0), F.covar_pop(a, b) / F.sqrt(va * vb))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x; null for a constant x."""
    both = x.isNotNull() & y.isNotNull()
    vx = F.var_pop(F.when(both, x))
    return F.when(vx > 0, F.covar_pop(F.when(both, x), F.when(both, y)) / vx)
