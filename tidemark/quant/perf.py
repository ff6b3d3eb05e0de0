"""Performance of a series of returns (date, ret). Series are at the grain of bars: their ordered windows are one small task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import log_growth, ratio

def _up_to_now():
    return Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def from_levels(levels: DataFrame) -> DataFrame:
    """Levels (date, level) to returns; the first bar has none."""
    before = F.lag("level").over(Window.orderBy("date"))
    return levels.select("date", (ratio(F.col("level"), before) - 1).alias("ret")).where("ret is not null")


def equity(returns: DataFrame) -> DataFrame:
    """date, ret, level, peak, drawdown: level starts from 1, and so does the peak."""
    total = F.sum(log_growth(F.col("ret"))).over(_up_to_now())
    rows = returns.select("date", "ret", F.exp(total).alias("level"))
    rows = rows.withColumn("peak", F.greatest(F.lit(1.0), F.max("level").over(_up_to_now())))
    return rows.withColumn("drawdown", F.col("level") / F.col("peak") - 1)


def stats(returns: DataFrame, per_year: int = 252, risk_free: float = 0.0, benchmark: DataFrame | None = None) -> DataFrame:
    """One row of the usual statistics; alpha and beta with a benchmark (date, bench)."""
    rows = equity(returns).withColumn("k", F.row_number().over(Window.orderBy("date")).cast("double"))
    rows = rows.withColumn("lg", F.ln(F.when(F.col("level") > 0, F.col("level"))))
    x, n = F.col("ret") - risk_free, F.count("ret")
    sd = F.when(n > 1, F.stddev_samp("ret"))
    mean = F.avg(x)
    downside = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2)))) * per_year**0.5
    annual = F.pow(F.max_by("level", "date"), per_year / n) - 1
    dd = F.min("drawdown")
    two = (F.var_pop("lg") > 0) & (F.var_pop("k") > 0)
    out = rows.agg(
        n.alias("n"), F.min("date").alias("start"), F.max("date").alias("end"), (F.max_by("level", "date") - 1).alias("cumulative"), annual.alias("annual_return"),
        (sd * per_year**0.5).alias("volatility"), (ratio(mean, sd) * per_year**0.5).alias("sharpe"), ratio(mean * per_year, downside).alias("sortino"), downside.alias("downside_risk"),
        dd.alias("max_drawdown"), ratio(annual, -dd).alias("calmar"), ratio(F.sum(F.greatest(x, F.lit(0.0))), -F.sum(F.least(x, F.lit(0.0)))).alias("omega"),
        F.when(two, F.pow(F.covar_pop("lg", "k"), F.lit(2)) / (F.var_pop("lg") * F.var_pop("k"))).alias("stability"),
        F.when(F.var_pop("ret") > 0, F.skewness("ret")).alias("skew"), F.when(F.var_pop("ret") > 0, F.kurtosis("ret")).alias("kurtosis"),
        (F.avg("ret") - 2 * sd).alias("value_at_risk"), ratio(F.abs(F.percentile("ret", 0.95)), F.abs(F.percentile("ret", 0.05))).alias("tail_ratio"))
    if benchmark is None:
        return out
    both = returns.join(benchmark, "date").agg(F.covar_pop("ret", "bench").alias("c"), F.var_pop("bench").alias("v"), F.avg("ret").alias("r"), F.avg("bench").alias("m"))
    beta = ratio(F.col("c"), F.col("v"))
    ab = both.select((F.pow(1 + F.col("r") - risk_free - beta * (F.col("m") - risk_free), F.lit(per_year)) - 1).alias("alpha"), beta.alias("beta"))
    return out.crossJoin(F.broadcast(ab))  # one row with one row


def drawdown_table(returns: DataFrame, top: int = 5) -> list[dict]:
    """The worst drawdowns that don't overlap: peak, valley, recovery dates and depth. One row a bar goes to the driver."""
    rows = equity(returns).select("date", "drawdown").orderBy("date").collect()
    spells, now = [], None
    for i, r in enumerate(rows):
        if r["drawdown"] < 0:
            if now is None:
                now = {"peak": rows[i - 1]["date"] if i else None, "valley": r["date"], "recovery": None, "depth": r["drawdown"]}
            if r["drawdown"] < now["depth"]:
                now |= {"valley": r["date"], "depth": r["drawdown"]}
        elif now is not None:
            spells.append(now | {"recovery": r["date"]})
            now = None
    if now is not None:
        spells.append(now)
    return sorted(spells, key=lambda s: s["depth"])[:top]


def _full(w, n: int, x: Column) -> Column:
    return F.when(F.count("ret").over(w) >= n, x)


def rolling_volatility(returns: DataFrame, n: int, per_year: int = 252) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(1 - n, 0)
    return returns.select("date", _full(w, n, F.stddev_samp("ret").over(w) * per_year**0.5).alias("volatility"))


def rolling_sharpe(returns: DataFrame, n: int, per_year: int = 252) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(1 - n, 0)
    sd = F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0))
    return returns.select("date", _full(w, n, F.avg("ret").over(w) / sd * per_year**0.5).alias("sharpe"))


def rolling_beta(returns: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(1 - n, 0)
    v = F.nullif(F.var_samp("bench").over(w), F.lit(0.0))
    return returns.join(benchmark, "date").select("date", _full(w, n, F.covar_samp("ret", "bench").over(w) / v).alias("beta"))
