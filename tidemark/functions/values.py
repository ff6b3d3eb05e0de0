"""Value semantics that differ from Spark's defaults: NaN as missing, guarded division, integer division."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def col(name: str) -> Column:
    """A column by its exact name; dots do not reach into structs."""
    return F.col("`" + name.replace("`", "``") + "`")


def lit(value) -> Column:
    """A literal; NaN and infinities are refused."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("literals must be finite")
    return F.lit(value)


def clean(x: Column) -> Column:
    """NaN becomes null: rolling and cross-sectional operators leave both out."""
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return a / F.nullif(b, F.lit(0))


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero, null where b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def is_in(x: Column, values: list) -> Column:
    """Membership in a list; never true for null, false for an empty list."""
    return x.isin(values) if values else F.lit(False)


def log_growth(r: Column) -> Column:
    """ln(1 + r), minus infinity at a total loss or worse."""
    return F.when(r <= -1, F.lit(float("-inf"))).otherwise(F.log1p(r))
