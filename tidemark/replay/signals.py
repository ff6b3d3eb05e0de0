"""Signal generators over price series (ts, instrument_id, price, ...): indicators by windows, positions by crossings.

Each gives ts, instrument_id, signal: +1 when its condition begins to hold, -1 when it ends. The state is the last
sign that wasn't 0, so that flat stretches neither enter nor leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import ratio
from ..operators.ewma import ewma

def _by():
    return Window.partitionBy("instrument_id").orderBy("ts")


def crossings(df: DataFrame, enter: Column, leave: Column) -> DataFrame:
    """Rows where a position opens (+1) or closes (-1): enter and leave set the state, all else keeps it."""
    sign = F.when(leave, F.lit(0)).when(enter, F.lit(1))
    state = F.coalesce(F.last(sign, ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = df.withColumn("__sign", sign).withColumn("__s", state)
    rows = rows.withColumn("signal", F.col("__s") - F.coalesce(F.lag("__s").over(_by()), F.lit(0)))
    return rows.where("signal <> 0").select("ts", "instrument_id", "signal")


def _mean(n: int, x: str = "price") -> Column:
    w = _by().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def ema_crossover(df: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    for name, n in (("__fast", fast), ("__slow", slow)):
        df = ewma(df, name, "price", 2 / (n + 1), ["instrument_id"], ["ts"])
    return crossings(df, F.col("__fast") > F.col("__slow"), F.col("__fast") < F.col("__slow"))


def threshold_momentum(df: DataFrame, n: int = 5, threshold: float = 0.02) -> DataFrame:
    m = df.withColumn("__m", ratio(F.col("price"), F.lag("price", n).over(_by())) - 1)
    return crossings(m, F.col("__m") > threshold, F.col("__m") < -threshold)


def breakout(df: DataFrame, n: int = 20) -> DataFrame:
    before = _by().rowsBetween(-n, -1)
    b = df.withColumns({"__hi": F.when(F.count("price").over(before) == n, F.max("price").over(before)), "__lo": F.when(F.count("price").over(before) == n, F.min("price").over(before))})
    return crossings(b, F.col("price") > F.col("__hi"), F.col("price") < F.col("__lo"))


def final_period_momentum(df: DataFrame, end: Column, window: int, threshold: float = 0.0) -> DataFrame:
    """Momentum since the last `window` units before `end` began."""
    late = F.col("ts") >= end - window
    first = F.first(F.when(late, F.col("price")), ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0))
    m = df.withColumn("__m", F.when(late, F.col("price") - first))
    return crossings(m, F.col("__m") > threshold, F.col("__m") < -threshold)


def mean_reversion(df: DataFrame, n: int = 20, z: float = 1.0) -> DataFrame:
    w = _by().rowsBetween(1 - n, 0)
    sd = F.when(F.count("price").over(w) == n, F.stddev_samp("price").over(w))
    s = df.withColumn("__z", (F.col("price") - _mean(n)) / F.nullif(sd, F.lit(0.0)))
    return crossings(s, F.col("__z") < -z, F.col("__z") > 0)


def rsi_reversion(df: DataFrame, n: int = 14, low: float = 30, high: float = 70) -> DataFrame:
    step = df.withColumn("__d", F.col("price") - F.lag("price").over(_by()))
    w = _by().rowsBetween(1 - n, 0)
    up, down = F.sum(F.greatest("__d", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("__d"), F.lit(0.0))).over(w)
    rsi = F.when(F.count("__d").over(w) == n, 100 * up / F.nullif(up + down, F.lit(0.0)))
    s = step.withColumn("__rsi", rsi)
    return crossings(s, F.col("__rsi") < low, F.col("__rsi") > high)


def vwap_reversion(df: DataFrame, n: int = 20, away: float = 0.01) -> DataFrame:
    w = _by().rowsBetween(1 - n, 0)
    v = F.sum(F.col("price") * F.col("size")).over(w) / F.nullif(F.sum("size").over(w), F.lit(0))
    s = df.withColumn("__v", v)
    return crossings(s, F.col("price") < F.col("__v") * (1 - away), F.col("price") >= F.col("__v"))


def panic_fade(df: DataFrame, n: int = 5, drop: float = 0.1, recover: float = 0.05) -> DataFrame:
    m = df.withColumn("__m", ratio(F.col("price"), F.max("price").over(_by().rowsBetween(-n, 0))) - 1)
    return crossings(m, F.col("__m") <= -drop, F.col("__m") >= -recover)


def microprice_imbalance(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Rows have bid_size and ask_size: in above the threshold's share of bids, out below its complement."""
    s = df.withColumn("__i", F.col("bid_size") / F.nullif(F.col("bid_size") + F.col("ask_size"), F.lit(0)))
    return crossings(s, F.col("__i") > threshold, F.col("__i") < 1 - threshold)


def deep_value(df: DataFrame, below: float = 0.1, above: float = 0.5) -> DataFrame:
    return crossings(df, F.col("price") <= below, F.col("price") >= above)


def late_favorite_hold(df: DataFrame, end: Column, window: int, favourite: float = 0.8) -> DataFrame:
    """In late and above `favourite`; held to the end."""
    return crossings(df, (F.col("ts") >= end - window) & (F.col("price") >= favourite), F.lit(False))


def pair_arbitrage(df: DataFrame, a: str, b: str, n: int = 20, z: float = 2.0) -> DataFrame:
    """ts, signal (+1 long a short b, -1 the other way, 0 flat) where it changes: the z-score of log price ratios."""
    pa, pb = (df.where(F.col("instrument_id") == x).select("ts", F.col("price").alias(name)) for x, name in ((a, "pa"), (b, "pb")))
    w = Window.orderBy("ts")
    both = pa.join(pb, "ts").withColumn("r", F.ln(ratio(F.col("pa"), F.col("pb"))))
    f = w.rowsBetween(1 - n, 0)
    sd = F.when(F.count("r").over(f) == n, F.stddev_samp("r").over(f))
    both = both.withColumn("z", (F.col("r") - F.avg("r").over(f)) / F.nullif(sd, F.lit(0.0)))
    sign = F.when(F.col("z") > z, -1).when(F.col("z") < -z, 1).when(F.abs("z") < z / 4, 0)
    both = both.withColumn("sign", sign).withColumn("signal", F.coalesce(F.last("sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return _changes(both)


def _changes(rows: DataFrame) -> DataFrame:
    w = Window.orderBy("ts")
    return rows.withColumn("__b", F.coalesce(F.lag("signal").over(w), F.lit(0))).where("signal <> __b").select("ts", "signal")
