"""Calibration of forecasts, trading costs, and guards against overfitting."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from ..functions.values import ratio

_NORMAL = NormalDist()


# --- calibration: rows (p, won) ---------------------------------------------------------------------------------------

def _bucket(n: int):
    """Half-open (low, high] of equal width, the first one closed; anything outside 0 to 1 is an error."""
    p = F.col("p")
    inside = F.greatest(F.lit(1), F.ceil(p * n)).cast("int")
    return F.when((p >= 0) & (p <= 1), inside).otherwise(F.raise_error(F.lit("a probability is out of range")).cast("int"))


def reliability_curve(rows: DataFrame, n: int = 10) -> DataFrame:
    """bucket, n, mean_p, rate."""
    return rows.groupBy(_bucket(n).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("won").cast("double")).alias("rate"))


def brier(rows: DataFrame, n: int = 10) -> DataFrame:
    """brier, reliability, resolution, uncertainty: the decomposition over buckets."""
    y = F.col("won").cast("double")
    per = rows.groupBy(_bucket(n).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("f"), F.avg(y).alias("o"), F.sum(y).alias("s"), F.sum(F.pow(F.col("p") - y, F.lit(2))).alias("e"))
    total = per.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("base"), (F.sum("e") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.pow(F.col("f") - F.col("o"), F.lit(2))) / F.sum("n")).alias("reliability"), (F.sum(F.col("n") * F.pow("o", F.lit(2))) / F.sum("n")).alias("second"))
    return total.select("brier", "reliability", (F.col("second") - F.pow("base", F.lit(2))).alias("resolution"), (F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def brier_advantage(rows: DataFrame) -> DataFrame:
    """How much lower the score of p is than that of a reference q; rows (p, q, won)."""
    y = F.col("won").cast("double")
    score = lambda c: F.avg(F.pow(F.col(c) - y, F.lit(2)))
    return rows.agg(score("p").alias("model"), score("q").alias("reference"), (score("q") - score("p")).alias("advantage"))


# --- costs: fills (side +1/-1, price, mid, size) ----------------------------------------------------------------------

def effective_spread(fills: DataFrame) -> DataFrame:
    """Twice the signed distance from the mid, relative to it, weighed by size."""
    return fills.agg(ratio(F.sum(2 * F.col("side") * (F.col("price") - F.col("mid")) / F.col("mid") * F.col("size")), F.sum("size")).alias("spread"))


def implementation_shortfall(fills: DataFrame) -> DataFrame:
    """Signed slippage from the arrival price, relative to it, weighed by size; fills have `arrival`."""
    return fills.agg(ratio(F.sum(F.col("side") * (F.col("price") - F.col("arrival")) / F.col("arrival") * F.col("size")), F.sum("size")).alias("shortfall"))


def fit_impact(fills: DataFrame, shape: str = "sqrt") -> DataFrame:
    """slope, intercept, r2 of slippage on participation (or its square root); fills have slippage and participation."""
    x = F.sqrt("participation") if shape == "sqrt" else F.col("participation")
    rows = fills.select(x.alias("x"), F.col("slippage").alias("y")).where("x is not null and y is not null")
    s = rows.agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = ratio(F.col("c"), F.col("vx"))
    return s.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), ratio(F.pow("c", F.lit(2)), F.col("vx") * F.col("vy")).alias("r2"))


# --- overfitting ------------------------------------------------------------------------------------------------------

def expected_maximum_sharpe(trials: int, spread: float) -> float:
    """The expected greatest of `trials` Sharpe ratios that are noise of that standard deviation."""
    if trials < 2:
        return 0.0
    euler = 0.5772156649015329
    return spread * ((1 - euler) * _NORMAL.inv_cdf(1 - 1 / trials) + euler * _NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def probabilistic_sharpe(sharpe: float, n: int, skew: float = 0.0, kurtosis: float = 3.0, against: float = 0.0) -> float:
    error = math.sqrt(max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2, 1e-12))
    return _NORMAL.cdf((sharpe - against) * math.sqrt(n - 1) / error)


def deflated_sharpe(sharpe: float, n: int, trials: int, spread: float, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    """The probability that a Sharpe ratio (per bar) found among many trials is truly above 0."""
    return probabilistic_sharpe(sharpe, n, skew, kurtosis, expected_maximum_sharpe(trials, spread))


def minimum_track_record_length(sharpe: float, confidence: float = 0.95, skew: float = 0.0, kurtosis: float = 3.0, against: float = 0.0) -> float:
    if sharpe <= against:
        return math.inf
    return 1 + (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) * (_NORMAL.inv_cdf(confidence) / (sharpe - against)) ** 2


def probability_of_overfitting(returns: DataFrame, blocks: int = 8) -> float:
    """Combinatorially symmetric cross-validation of trials; rows (bar, trial, ret), bars numbered from 0.

    Spark reduces returns to moments of each trial and block; splits combine those on the driver.
    """
    span = returns.agg((F.max("bar") + 1).alias("n")).first()["n"]
    block = F.least(F.floor(F.col("bar") * blocks / F.lit(span)), F.lit(blocks - 1)).cast("int")
    rows = returns.groupBy("trial", block.alias("block")).agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") ** 2).alias("q")).collect()
    trials = sorted({r["trial"] for r in rows})
    of = {(r["trial"], r["block"]): (r["n"], r["s"], r["q"]) for r in rows}

    def sharpe(trial, part) -> float:
        n, s, q = (sum(of.get((trial, b), (0, 0.0, 0.0))[k] for b in part) for k in range(3))
        if n < 2:
            return math.nan
        var = (q - s * s / n) / (n - 1)
        return s / n / math.sqrt(var) if var > 1e-18 else math.nan

    low = total = 0
    for inside in itertools.combinations(range(blocks), blocks // 2):
        outside = [b for b in range(blocks) if b not in inside]
        scored = [(x, t) for t in trials if math.isfinite(x := sharpe(t, inside))]
        after = {t: x for t in trials if math.isfinite(x := sharpe(t, outside))}
        if not scored or (best := max(scored, key=lambda p: p[0])[1]) not in after:
            continue
        rank = (sum(x < after[best] for x in after.values()) + (sum(x == after[best] for x in after.values()) + 1) / 2) / (len(after) + 1)
        low, total = low + (rank < 0.5), total + 1
    return low / total if total else math.nan
