"""Factor analytics: panels of factors and forward returns, and what they tell about each other.

A panel has a row for each date and asset: date, asset, factor, group?, fwd_<p> for each period p, bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.aggregates import corr
from ..functions.values import clean, ratio
from ..functions.windows import cs_rank


class LossTooHigh(Exception):
    """More rows were lost on the way to the panel than max_loss allows."""


def forward_returns(prices: DataFrame, periods: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """date, asset, fwd_<p>: the return over the asset's next p rows."""
    w = Window.partitionBy("asset").orderBy("date")
    return prices.select("date", "asset", *[(ratio(F.lead("price", p).over(w), F.col("price")) - 1).alias(f"fwd_{p}") for p in periods])


def buckets(panel: DataFrame, n: int = 5, how: str = "quantile", by_group: bool = False, zero_aware: bool = False) -> DataFrame:
    """bucket from 1 to n within each date: quantiles (ties by asset), equal widths, or either on each side of zero."""
    keys = ["date", *(["group"] if by_group else [])]
    side, base, parts = [], F.lit(0), n
    if zero_aware:
        panel = panel.withColumn("__pos", (F.col("factor") >= 0).cast("int"))
        side, base, parts = ["__pos"], F.col("__pos") * (n // 2), n // 2
    w = Window.partitionBy(*keys, *side)
    if how == "quantile":
        b = F.ntile(parts).over(w.orderBy("factor", "asset"))
    else:
        lo, hi = F.min("factor").over(w), F.max("factor").over(w)
        width = (hi - lo) / parts
        b = F.least(F.lit(parts), F.greatest(F.lit(1), F.ceil(ratio(F.col("factor") - lo, width))))
        b = F.when(width == 0, F.lit(1)).otherwise(b)
    return panel.withColumn("bucket", (b + base).cast("int")).drop("__pos")


def build_panel(prices: DataFrame, signals: DataFrame, periods: tuple[int, ...] = (1, 5, 10), n: int = 5, max_z: float | None = 20, max_loss: float = 0.35, how: str = "quantile", by_group: bool = False, zero_aware: bool = False) -> DataFrame:
    """Prices of the signals' assets to forward returns, outliers out, joined with the factor, bucketed.

    prices: date, asset, price; signals: date, asset, factor, group?. Forward returns are made on all of an asset's
    dates, then restricted to the factor's; beyond max_z of the asset's spread they become null; rows
    without a finite factor, all returns and a group are dropped.
    """
    panel = _bucketed(prices, signals, periods, n, max_z, how, by_group, zero_aware)
    if max_loss < 1:
        lost = _losses(signals, panel).first()
        if lost["total"] > max_loss:
            raise LossTooHigh(f"{lost['total']:.1%} of rows were lost ({lost['forward_returns']:.1%} to returns, {lost['binning']:.1%} to buckets), {max_loss:.1%} are allowed")
    return panel.where("bucket is not null")


def loss_report(prices: DataFrame, signals: DataFrame, periods: tuple[int, ...] = (1, 5, 10), n: int = 5, max_z: float | None = 20, how: str = "quantile", by_group: bool = False, zero_aware: bool = False) -> DataFrame:
    """One row: initial, after_forward_returns and after_binning count rows; forward_returns, binning and total are shares lost."""
    return _losses(signals, _bucketed(prices, signals, periods, n, max_z, how, by_group, zero_aware))


def _losses(signals: DataFrame, panel: DataFrame) -> DataFrame:
    given = signals.select(F.lit(1).alias("i"), F.lit(0).alias("r"), F.lit(0).alias("b"))
    kept = panel.select(F.lit(0), F.lit(1), F.col("bucket").isNotNull().cast("int"))
    counts = given.union(kept).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "irb"))
    share = lambda x: F.when(F.col("i") > 0, x / F.col("i")).otherwise(F.lit(0.0))
    total, returns = share(F.col("i") - F.col("b")), share(F.col("i") - F.col("r"))
    return counts.select(
        F.col("i").alias("initial"), F.col("r").alias("after_forward_returns"), F.col("b").alias("after_binning"),
        returns.alias("forward_returns"), (total - returns).alias("binning"), total.alias("total"),
    )


def _bucketed(prices: DataFrame, signals: DataFrame, periods: tuple[int, ...], n: int, max_z: float | None, how: str, by_group: bool, zero_aware: bool) -> DataFrame:
    """The panel before rows without a bucket go."""
    fwd = [f"fwd_{p}" for p in periods]
    r = forward_returns(prices.join(signals.select("asset").distinct(), "asset", "left_semi"), periods)
    r = r.join(signals.select("date").distinct(), "date", "left_semi")
    if max_z is not None:
        w = Window.partitionBy("asset")
        for c in fwd:
            away = F.abs(F.col(c) - F.avg(c).over(w)) > max_z * F.when(F.count(c).over(w) > 1, F.stddev_samp(c).over(w))
            r = r.withColumn(c, F.when(~F.coalesce(away, F.lit(False)), F.col(c)))
    ok = clean(F.col("factor")).isNotNull() & (F.abs("factor") < float("inf"))
    for c in [*fwd, *(["group"] if "group" in signals.columns else [])]:
        ok = ok & F.col(c).isNotNull()
    return buckets(r.join(signals, ["date", "asset"]).where(ok), n, how, by_group, zero_aware)


def information_coefficient(panel: DataFrame, period: int) -> DataFrame:
    """date, ic: the rank correlation of factor and forward return."""
    ranked = panel.withColumns({"__f": cs_rank(F.col("factor"), "date"), "__r": cs_rank(F.col(f"fwd_{period}"), "date")})
    return ranked.groupBy("date").agg(corr(F.col("__f"), F.col("__r")).alias("ic"))


def mean_ic(panel: DataFrame, period: int) -> DataFrame:
    """period, mean, sd, n, icir, t over dates."""
    ic = information_coefficient(panel, period)
    s = ic.agg(F.avg("ic").alias("mean"), F.when(F.count("ic") > 1, F.stddev_samp("ic")).alias("sd"), F.count("ic").alias("n"))
    return s.select(F.lit(period).alias("period"), "mean", "sd", "n", ratio(F.col("mean"), F.col("sd")).alias("icir"), (ratio(F.col("mean"), F.col("sd")) * F.sqrt("n")).alias("t"))


def ic_decay(panel: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    out = mean_ic(panel, periods[0])
    for p in periods[1:]:
        out = out.unionByName(mean_ic(panel, p))
    return out


def quantile_returns(panel: DataFrame, period: int) -> DataFrame:
    """bucket, mean, stderr, n: of each bucket's daily mean returns."""
    daily = panel.groupBy("bucket", "date").agg(F.avg(f"fwd_{period}").alias("m"))
    s = daily.groupBy("bucket").agg(F.avg("m").alias("mean"), F.when(F.count("m") > 1, F.stddev_samp("m")).alias("sd"), F.count("m").alias("n"))
    return s.select("bucket", "mean", (F.col("sd") / F.sqrt("n")).alias("stderr"), "n")


def spread(panel: DataFrame, period: int) -> DataFrame:
    """mean, stderr: of the top bucket's return less the bottom one's."""
    q = quantile_returns(panel, period)
    top, bottom = F.max_by(F.struct("mean", "stderr"), "bucket"), F.min_by(F.struct("mean", "stderr"), "bucket")
    return q.agg(top.alias("t"), bottom.alias("b")).select((F.col("t.mean") - F.col("b.mean")).alias("mean"), F.sqrt(F.pow("t.stderr", F.lit(2)) + F.pow("b.stderr", F.lit(2))).alias("stderr"))


def _date_places(panel: DataFrame) -> DataFrame:
    """date, place: one row a date, numbered in one small task."""
    return panel.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("place"))


def turnover(panel: DataFrame, period: int = 1) -> DataFrame:
    """date, bucket, turnover: the share of a bucket's names that weren't in it `period` dates before."""
    rows = panel.select("date", "asset", "bucket").join(_date_places(panel), "date")
    before = rows.select((F.col("place") + period).alias("place"), "asset", "bucket", F.lit(1).alias("was"))
    both = rows.join(before, ["place", "asset", "bucket"], "left").where(F.col("place") > period)
    return both.groupBy("date", "bucket").agg((1 - F.count("was") / F.count(F.lit(1))).alias("turnover"))


def rank_autocorrelation(panel: DataFrame, period: int = 1) -> DataFrame:
    """date, autocorr: of factor ranks with those `period` dates before."""
    rows = panel.withColumn("r", cs_rank(F.col("factor"), "date")).select("date", "asset", "r").join(_date_places(panel), "date")
    before = rows.select((F.col("place") + period).alias("place"), "asset", F.col("r").alias("r0"))
    return rows.join(before, ["place", "asset"]).groupBy("date").agg(corr(F.col("r"), F.col("r0")).alias("autocorr"))


def weights(panel: DataFrame, demean: bool = True, equal: bool = False, by_group: bool = False) -> DataFrame:
    """panel with weight: the factor, demeaned, over the sum of its absolute values each date.

    equal: the sign of the distance from the median instead. by_group: within groups, then over all.
    """
    keys = ["date", *(["group"] if by_group else [])]
    w, day = Window.partitionBy(*keys), Window.partitionBy("date")
    f = F.col("factor")
    if equal:
        x = F.signum(f - F.percentile("factor", 0.5).over(w)) if demean else F.signum(f)
    else:
        x = f - F.avg("factor").over(w) if demean else f
    out = panel.withColumn("__x", x).withColumn("weight", ratio(F.col("__x"), F.sum(F.abs("__x")).over(w)))
    if by_group:
        out = out.withColumn("weight", ratio(F.col("weight"), F.sum(F.abs("weight")).over(day)))
    return out.drop("__x")


def factor_returns(panel: DataFrame, period: int, **kw) -> DataFrame:
    """date, ret: of the portfolio held with `weights`."""
    return weights(panel, **kw).groupBy("date").agg(F.sum(F.col("weight") * F.col(f"fwd_{period}")).alias("ret"))


def alpha_beta(panel: DataFrame, period: int, per_year: int = 252, **kw) -> DataFrame:
    """alpha (annual) and beta of factor returns against the equal-weight universe."""
    universe = panel.groupBy("date").agg(F.avg(f"fwd_{period}").alias("u"))
    both = factor_returns(panel, period, **kw).join(universe, "date")
    s = both.agg(F.covar_pop("ret", "u").alias("c"), F.var_pop("u").alias("v"), F.avg("ret").alias("r"), F.avg("u").alias("m"))
    beta = ratio(F.col("c"), F.col("v"))
    return s.select((F.pow(1 + F.col("r") - beta * F.col("m"), F.lit(per_year / period)) - 1).alias("alpha"), beta.alias("beta"))


def cumulative_returns(returns: DataFrame) -> DataFrame:
    """date, cum: compounded; one row a date."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.select("date", (F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).over(w)) - 1).alias("cum"))
