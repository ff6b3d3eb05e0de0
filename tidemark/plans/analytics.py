"""Queries: factor and performance analytics, calibration and costs, on prices made from events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..quant import checks, factor, perf, splits
from .registry import Tables, query

_PRICES = """WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS date, event_type || (user_id % 4) AS asset, last(value ORDER BY ts, event_id) + 1 AS price, first(value ORDER BY ts, event_id) AS factor FROM events GROUP BY 1, 2), """
_PANEL = _PRICES + """f AS (SELECT date, asset, factor, lead(price, 1) OVER k / price - 1 AS fwd_1, lead(price, 5) OVER k / price - 1 AS fwd_5 FROM p WINDOW k AS (PARTITION BY asset ORDER BY date)),
    panel AS (SELECT *, ntile(4) OVER (PARTITION BY date ORDER BY factor, asset) AS bucket FROM f WHERE fwd_1 IS NOT NULL AND fwd_5 IS NOT NULL), """


def _prices(t: Tables):
    at = F.struct("ts", "event_id")
    asset = F.concat("event_type", (F.col("user_id") % 4).cast("string"))
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), asset.alias("asset")).agg((F.max_by("value", at) + 1).alias("price"), F.min_by("value", at).alias("factor"))


def _panel(t: Tables):
    p = _prices(t)
    return factor.build_panel(p.select("date", "asset", "price"), p.select("date", "asset", "factor"), (1, 5), 4, max_loss=1)


@query(_PANEL + "x AS (SELECT 1) SELECT date, asset, factor, round(fwd_1, 6) AS fwd_1, round(fwd_5, 6) AS fwd_5, bucket::INTEGER AS bucket FROM panel")
def factor_panel(t: Tables):
    return _panel(t).select("date", "asset", "factor", F.round("fwd_1", 6).alias("fwd_1"), F.round("fwd_5", 6).alias("fwd_5"), "bucket")


@query(_PANEL + """b AS (SELECT *, min(factor) OVER (PARTITION BY date) AS lo, max(factor) OVER (PARTITION BY date) AS hi FROM panel)
    SELECT date, asset, CASE WHEN hi = lo THEN 1 ELSE least(4, greatest(1, ceil((factor - lo) / ((hi - lo) / 4)))) END::INTEGER AS bucket FROM b""")
def factor_buckets(t: Tables):
    return factor.buckets(_panel(t), 4, "width").select("date", "asset", "bucket")


_RANKS = _PANEL + """r AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2) / count(*) OVER (PARTITION BY date) AS rf,
    (rank() OVER (PARTITION BY date ORDER BY fwd_1) + (count(*) OVER (PARTITION BY date, fwd_1) - 1) / 2) / count(*) OVER (PARTITION BY date) AS rr FROM panel), """
_IC = _RANKS + "ic AS (SELECT date, CASE WHEN var_pop(rf) > 0 AND var_pop(rr) > 0 THEN covar_pop(rf, rr) / sqrt(var_pop(rf) * var_pop(rr)) END AS ic FROM r GROUP BY 1) "


@query(_IC + "SELECT date, round(ic, 6) AS ic FROM ic")
def factor_ic(t: Tables):
    return factor.information_coefficient(_panel(t), 1).select("date", F.round("ic", 6).alias("ic"))


@query(_IC + "SELECT 1 AS period, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, count(ic) AS n, round(avg(ic) / stddev_samp(ic), 5) AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 5) AS t FROM ic")
def factor_mean_ic(t: Tables):
    return factor.mean_ic(_panel(t), 1).select("period", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n", F.round("icir", 5).alias("icir"), F.round("t", 5).alias("t"))


@query(_PANEL + "d AS (SELECT bucket, date, avg(fwd_1) AS m FROM panel GROUP BY 1, 2) SELECT bucket::INTEGER AS bucket, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS stderr, count(m) AS n FROM d GROUP BY 1")
def quantile_returns(t: Tables):
    return factor.quantile_returns(_panel(t), 1).select("bucket", F.round("mean", 6).alias("mean"), F.round("stderr", 6).alias("stderr"), "n")


_PLACES = "k AS (SELECT date, row_number() OVER (ORDER BY date) AS place FROM (SELECT DISTINCT date FROM panel)), "


@query(_PANEL + _PLACES + """q AS (SELECT panel.*, place FROM panel JOIN k USING (date))
    SELECT a.date, a.bucket::INTEGER AS bucket, round(1 - count(b.asset) / count(*), 6) AS turnover FROM q a LEFT JOIN q b ON a.place = b.place + 1 AND a.asset = b.asset AND a.bucket = b.bucket WHERE a.place > 1 GROUP BY 1, 2""")
def turnover(t: Tables):
    return factor.turnover(_panel(t), 1).select("date", "bucket", F.round("turnover", 6).alias("turnover"))


@query(_RANKS + _PLACES + """q AS (SELECT r.*, place FROM r JOIN k USING (date)), c AS (SELECT a.date, covar_pop(a.rf, b.rf) AS c, var_pop(a.rf) AS va, var_pop(b.rf) AS vb FROM q a JOIN q b ON a.place = b.place + 1 AND a.asset = b.asset GROUP BY 1)
    SELECT date, CASE WHEN va > 0 AND vb > 0 THEN round(c / sqrt(va * vb), 6) END AS autocorr FROM c""")
def rank_autocorr(t: Tables):
    return factor.rank_autocorrelation(_panel(t), 1).select("date", F.round("autocorr", 6).alias("autocorr"))


_WEIGHTS = _PANEL + "x AS (SELECT *, factor - avg(factor) OVER (PARTITION BY date) AS x FROM panel), w AS (SELECT *, x / nullif(sum(abs(x)) OVER (PARTITION BY date), 0) AS weight FROM x), rets AS (SELECT date, sum(weight * fwd_1) AS ret FROM w GROUP BY 1) "


@query(_WEIGHTS + "SELECT date, asset, round(weight, 6) AS weight FROM w")
def factor_weights(t: Tables):
    return factor.weights(_panel(t)).select("date", "asset", F.round("weight", 6).alias("weight"))


@query(_WEIGHTS + "SELECT date, round(ret, 6) AS ret FROM rets")
def factor_returns(t: Tables):
    return factor.factor_returns(_panel(t), 1).select("date", F.round("ret", 6).alias("ret"))


@query(_WEIGHTS + ", u AS (SELECT date, avg(fwd_1) AS u FROM panel GROUP BY 1) SELECT round(covar_pop(ret, u) / var_pop(u), 6) AS beta, round(avg(ret) - covar_pop(ret, u) / var_pop(u) * avg(u), 6) AS alpha FROM rets JOIN u USING (date)")
def alpha_beta(t: Tables):
    return factor.alpha_beta(_panel(t), 1, per_year=1).select(F.round("beta", 6).alias("beta"), F.round("alpha", 6).alias("alpha"))


# --- performance: daily mean values as levels ---------------------------------------------------------------------

_RET = "WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS date, avg(value) AS level FROM events GROUP BY 1), r AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS ret FROM l QUALIFY ret IS NOT NULL), "
_EQ = _RET + "v AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER w) AS level FROM r WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)), e AS (SELECT *, level / greatest(1, max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd, row_number() OVER (ORDER BY date)::DOUBLE AS k FROM v) "


def _returns(t: Tables):
    return perf.from_levels(t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.avg("value").alias("level")))


@query(_EQ + """SELECT count(*) AS n, min(date) AS start, max(date) AS "end", round(max_by(level, date) - 1, 6) AS cumulative, round(power(max_by(level, date), 252.0 / count(*)) - 1, 6) AS annual_return, round(stddev_samp(ret) * sqrt(252), 6) AS volatility,
    round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(avg(ret) * 252 / (sqrt(avg(power(least(ret, 0), 2))) * sqrt(252)), 6) AS sortino, round(min(dd), 6) AS max_drawdown, round(sum(greatest(ret, 0)) / -sum(least(ret, 0)), 6) AS omega,
    round(power(covar_pop(ln(level), k), 2) / (var_pop(ln(level)) * var_pop(k)), 6) AS stability, round(avg(ret) - 2 * stddev_samp(ret), 6) AS value_at_risk, round(abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05)), 6) AS tail_ratio FROM e""")
def perf_stats(t: Tables):
    s = perf.stats(_returns(t))
    exact = ("n", "start", "end")
    return s.select(*exact, *[F.round(c, 6).alias(c) for c in ("cumulative", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "omega", "stability", "value_at_risk", "tail_ratio")])


@query(_EQ + "SELECT date, round(level, 6) AS level, round(dd, 6) AS drawdown FROM e")
def underwater(t: Tables):
    return perf.equity(_returns(t)).select("date", F.round("level", 6).alias("level"), F.round("drawdown", 6).alias("drawdown"))


@query(_RET + "x AS (SELECT 1) SELECT date, CASE WHEN count(*) OVER w >= 5 THEN round(avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252), 5) END AS sharpe FROM r WINDOW w AS (ORDER BY date ROWS 4 PRECEDING)")
def rolling_sharpe(t: Tables):
    return perf.rolling_sharpe(_returns(t), 5).select("date", F.round("sharpe", 5).alias("sharpe"))


# --- calibration and costs ----------------------------------------------------------------------------------------

_FORECASTS = "WITH f AS (SELECT (event_id * 37 % 101) / 100.0::DOUBLE AS p, event_type = 'purchase' AS won FROM events), b AS (SELECT *, greatest(1, ceil(p * 10))::INTEGER AS bucket FROM f) "


def _forecasts(t: Tables):
    return t.events.select((F.col("event_id") * 37 % 101 / 100.0).alias("p"), (F.col("event_type") == "purchase").alias("won"))


@query(_FORECASTS + "SELECT bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(won::INTEGER), 6) AS rate FROM b GROUP BY 1")
def reliability(t: Tables):
    return checks.reliability_curve(_forecasts(t)).select("bucket", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query(_FORECASTS + ", g AS (SELECT bucket, count(*) AS n, avg(p) AS f, avg(won::INTEGER) AS o FROM b GROUP BY 1), a AS (SELECT avg(won::INTEGER) AS base, avg(power(p - won::INTEGER, 2)) AS brier FROM b) SELECT round(any_value(brier), 6) AS brier, round(sum(n * power(f - o, 2)) / sum(n), 6) AS reliability, round(sum(n * power(o - base, 2)) / sum(n), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM g, a")
def brier(t: Tables):
    return checks.brier(_forecasts(t)).select(*[F.round(c, 6).alias(c) for c in ("brier", "reliability", "resolution", "uncertainty")])


@query("WITH f AS (SELECT sqrt(l_quantity / 50) AS x, l_discount - l_tax AS y FROM lineitem) SELECT round(covar_pop(x, y) / var_pop(x), 6) AS slope, round(avg(y) - covar_pop(x, y) / var_pop(x) * avg(x), 6) AS intercept, round(power(covar_pop(x, y), 2) / (var_pop(x) * var_pop(y)), 8) AS r2 FROM f")
def impact_fit(t: Tables):
    fills = t.lineitem.select((F.col("l_quantity") / 50).alias("participation"), (F.col("l_discount") - F.col("l_tax")).alias("slippage"))
    return checks.fit_impact(fills).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("SELECT round(sum(2 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * l_discount * l_quantity) / sum(l_quantity), 6) AS spread FROM lineitem")
def effective_spread(t: Tables):
    fills = t.lineitem.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("side"), (1 + F.col("l_discount")).alias("price"), F.lit(1.0).alias("mid"), F.col("l_quantity").alias("size"))
    return checks.effective_spread(fills).select(F.round("spread", 6).alias("spread"))




# --- losses on the way to a panel, and validation splits ---------------------------------------------------------------

@query(_PANEL + """c AS (SELECT (SELECT count(*) FROM p) AS initial, (SELECT count(*) FROM panel) AS kept)
    SELECT initial, kept AS after_forward_returns, kept AS after_binning, round(1 - kept / initial, 9) AS forward_returns, 0.0::DOUBLE AS binning, round(1 - kept / initial, 9) AS total FROM c""")
def factor_losses(t: Tables):
    p = _prices(t)
    report = factor.loss_report(p.select("date", "asset", "price"), p.select("date", "asset", "factor"), (1, 5), 4)
    return report.select(*(F.col(c) if "after" in c or c == "initial" else F.round(c, 9).alias(c) for c in report.columns))


#: A bar for each date that has orders; labels look 0 to 6 bars ahead.
_DAYS = """WITH d AS (SELECT DISTINCT o_orderdate AS day FROM orders), b AS (SELECT row_number() OVER (ORDER BY day) - 1 AS place, (row_number() OVER (ORDER BY day) - 1) % 7 AS h FROM d), n AS (SELECT count(*) AS n FROM b), """


def _days(t: Tables):
    days = t.orders.select("o_orderdate").distinct()
    bars = days.select((F.row_number().over(Window.orderBy("o_orderdate")) - 1).cast("long").alias("place"))
    return bars.withColumn("horizon", F.col("place") % 7), days.count()


@query(_DAYS + """k AS (SELECT k, round_even(k * n / 5.0, 0) AS lo, round_even((k + 1) * n / 5.0, 0) AS hi, round_even(n * 0.01::DOUBLE, 0) AS w FROM n, range(5) r(k))
    SELECT k AS fold, place, CASE WHEN place >= lo AND place < hi THEN 'test' WHEN (place >= hi AND place < hi + w) OR (place < hi AND place + h >= lo) THEN 'purged' ELSE 'train' END AS role FROM b, k""")
def split_kfold(t: Tables):
    return splits.purged_kfold(*_days(t), folds=5, embargo=0.01)


@query(_DAYS + """g AS (SELECT k, round_even(k * n / 6.0, 0) AS lo, round_even((k + 1) * n / 6.0, 0) AS hi, round_even(n * 0.01::DOUBLE, 0) AS w FROM n, range(6) r(k)),
    k AS (SELECT row_number() OVER (ORDER BY x.k, y.k) - 1 AS fold, x.lo AS a, x.hi AS b, y.lo AS c, y.hi AS d, x.w FROM g x JOIN g y ON x.k < y.k)
    SELECT fold, place, CASE WHEN (place >= a AND place < k.b) OR (place >= c AND place < d) THEN 'test'
        WHEN (place >= k.b AND place < k.b + w) OR (place >= d AND place < d + w) OR (place < d AND place + h >= a) THEN 'purged' ELSE 'train' END AS role FROM b, k""")
def split_combinatorial(t: Tables):
    return splits.combinatorial_purged(*_days(t), groups=6, test_groups=2, embargo=0.01)


@query(_DAYS + """k AS (SELECT k, k * 50 AS lo, k * 50 + 400 AS first FROM n, range(((n - 500) // 50 + 1)::BIGINT) r(k))
    SELECT k AS fold, place, CASE WHEN place >= first THEN 'test' WHEN place >= first - 25 OR place + h >= first THEN 'purged' ELSE 'train' END AS role FROM b JOIN k ON place >= lo AND place < first + 100""")
def split_walk_forward(t: Tables):
    return splits.walk_forward(*_days(t), train=400, test=100, step=50, embargo=0.05)
