"""Rolling and cross-sectional statistics as column expressions over windows.

Null and NaN are left out of all of them. Frames are row counts, row offsets or durations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .time import parse_width
from .values import clean


def frame(partition_by=(), order_by=(), rows: int | tuple[int | None, int | None] | None = None, duration: str | None = None) -> WindowSpec:
    """rows=n: the current row and n - 1 before; rows=(p, f): p before to f after, None being unbounded;
    duration='30m': from that long before the current row's time, order_by being one timestamp."""
    as_list = lambda x: list(x) if isinstance(x, (list, tuple)) else [x]
    w = Window.partitionBy(*as_list(partition_by))
    if rows is None and duration is None:
        return w.orderBy(*as_list(order_by)) if order_by != () else w
    if order_by == ():
        raise ValueError("a frame needs an order")
    if duration is not None:
        width = parse_width(duration)
        if width.months:
            raise ValueError("a rolling duration must have a fixed width")
        [by] = as_list(order_by)
        micros = F.unix_micros((F.col(by) if isinstance(by, str) else by).cast("timestamp"))
        return w.orderBy(micros).rangeBetween(-width.micros, 0)
    before, after = (rows - 1, 0) if isinstance(rows, int) else rows
    if isinstance(rows, int) and rows < 1:
        raise ValueError("a frame holds a row at least")
    return w.orderBy(*as_list(order_by)).rowsBetween(Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after)


def rolling_mean(x: Column, w: WindowSpec) -> Column:
    return F.avg(clean(x)).over(w)


def rolling_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(clean(x)).over(w)


def rolling_min(x: Column, w: WindowSpec) -> Column:
    return F.min(clean(x)).over(w)


def rolling_max(x: Column, w: WindowSpec) -> Column:
    return F.max(clean(x)).over(w)


def rolling_std(x: Column, w: WindowSpec) -> Column:
    return F.when(F.count(clean(x)).over(w) > 1, F.stddev_samp(clean(x)).over(w))


def rolling_var(x: Column, w: WindowSpec) -> Column:
    return F.when(F.count(clean(x)).over(w) > 1, F.var_samp(clean(x)).over(w))


def rolling_count(x: Column, w: WindowSpec) -> Column:
    return F.count(clean(x)).over(w)


def rolling_vwap(value: Column, weight: Column, w: WindowSpec) -> Column:
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)).over(w) / F.nullif(F.sum(F.when(both, weight)).over(w), F.lit(0))


def rolling_distinct(x: Column, w: WindowSpec) -> Column:
    return F.size(F.collect_set(x).over(w))


def mad(x: Column, w: WindowSpec) -> Column:
    """Mean absolute deviation from the frame's mean."""
    mean = F.avg(clean(x)).over(w)
    away = F.transform(F.collect_list(clean(x)).over(w), lambda v: F.abs(v - mean))
    return F.when(F.count(clean(x)).over(w) > 0, F.aggregate(away, F.lit(0.0), lambda a, v: a + v) / F.size(away))


def skew(x: Column, w: WindowSpec) -> Column:
    """Bias-corrected skewness; null under three values or without variance."""
    v = clean(x)
    n, spread = F.count(v).over(w), F.var_pop(v).over(w)
    return F.when((n >= 3) & (spread > 0), F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * F.skewness(v).over(w))


def kurt(x: Column, w: WindowSpec) -> Column:
    """Bias-corrected excess kurtosis; null under four values or without variance."""
    v = clean(x)
    n, spread = F.count(v).over(w), F.var_pop(v).over(w)
    return F.when((n >= 4) & (spread > 0), (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v).over(w) + 6))


def _slots(x: Column, w: WindowSpec) -> Column:
    """The frame's values in order, nulls included."""
    return F.transform(F.collect_list(F.struct(clean(x).alias("v"))).over(w), lambda s: s["v"])


def idxmax(x: Column, w: WindowSpec) -> Column:
    """Place in the frame, from 1, of the first greatest value."""
    s = _slots(x, w)
    return F.when(F.array_max(s).isNotNull(), F.array_position(s, F.array_max(s)).cast("double"))


def idxmin(x: Column, w: WindowSpec) -> Column:
    s = _slots(x, w)
    return F.when(F.array_min(s).isNotNull(), F.array_position(s, F.array_min(s)).cast("double"))


def ts_rank(x: Column, w: WindowSpec) -> Column:
    """Average-rank percentile of the current value in its frame; null for null."""
    f, v = F.collect_list(clean(x)).over(w), clean(x)
    less, same = F.size(F.filter(f, lambda y: y < v)), F.size(F.filter(f, lambda y: y == v))
    return F.when(v.isNotNull(), (less + (same + 1) / 2) / F.size(f))


def _both(x: Column, y: Column) -> tuple[Column, Column]:
    a, b = clean(x), clean(y)
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok, a), F.when(ok, b)


def ts_cov(x: Column, y: Column, w: WindowSpec) -> Column:
    a, b = _both(x, y)
    return F.when(F.count(a).over(w) >= 2, F.covar_samp(a, b).over(w))


def ts_corr(x: Column, y: Column, w: WindowSpec) -> Column:
    a, b = _both(x, y)
    va, vb = F.var_pop(a).over(w), F.var_pop(b).over(w)
    return F.when((va > 0) & (vb > 0), F.covar_pop(a, b).over(w) / F.sqrt(va * vb))


def cs_rank(x: Column, *bucket) -> Column:
    """Average-rank percentile within a bucket: mean rank of ties over the number of values."""
    v = clean(x)
    ties, all_ = F.count(v).over(Window.partitionBy(*bucket, v)), F.count(v).over(Window.partitionBy(*bucket))
    return F.when(v.isNotNull(), (F.rank().over(Window.partitionBy(*bucket).orderBy(v.asc_nulls_last())) + (ties - 1) / 2) / all_)


def with_winsorized(df: DataFrame, name: str, x: Column, lower: float, upper: float, *bucket) -> DataFrame:
    """df with x winsorised within buckets: values ranked below floor(lower * n) become the value
    there, those from ceil(upper * n) on the one just before. lower 0 and upper 1 change nothing on their
    side, nor does a cut beyond the values."""
    if not 0 <= lower <= upper <= 1:
        raise ValueError("quantiles must be ordered and from 0 to 1")
    whole = Window.partitionBy(*bucket)
    step = df.withColumn("__v", clean(x)).withColumns({
        "__at": F.row_number().over(whole.orderBy(F.col("__v").asc_nulls_last())) - 1,
        "__n": F.count("__v").over(whole),
    }).withColumns({"__lo": F.floor(F.lit(lower) * F.col("__n")), "__hi": F.ceil(F.lit(upper) * F.col("__n"))})
    low = F.max(F.when(F.col("__at") == F.col("__lo"), F.col("__v"))).over(whole)
    high = F.max(F.when(F.col("__at") == F.col("__hi") - 1, F.col("__v"))).over(whole)
    out = F.col("__v")
    if upper < 1:
        out = F.when((F.col("__at") >= F.col("__hi")) & (F.col("__hi") > 0), high).otherwise(out)
    if lower > 0:
        out = F.when((F.col("__at") < F.col("__lo")) & (F.col("__lo") < F.col("__n")), low).otherwise(out)
    return step.withColumn(name, F.when(F.col("__v").isNotNull(), out)).drop("__v", "__at", "__n", "__lo", "__hi")


def cs_demean(x: Column, *bucket) -> Column:
    return clean(x) - F.avg(clean(x)).over(Window.partitionBy(*bucket))


def cs_zscore(x: Column, *bucket) -> Column:
    w = Window.partitionBy(*bucket)
    spread = F.when(F.count(clean(x)).over(w) > 1, F.stddev_samp(clean(x)).over(w))
    return F.when(spread > 0, cs_demean(x, *bucket) / spread)

