"""Queries: ranking, rolling and cross-sectional windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import windows as W
from ..operators.ewma import ewma as ewma_
from ..operators.rolling import rolling_duration as rolling_duration_
from .registry import Tables, query

_K = "PARTITION BY event_type ORDER BY ts, event_id"
_F5 = f"WINDOW w AS ({_K} ROWS 4 PRECEDING)"


def _by(t: Tables):
    return Window.partitionBy("event_type").orderBy("ts", "event_id")


def _w(rows=5):
    return W.frame("event_type", ["ts", "event_id"], rows=rows)


@query(f"SELECT event_id, row_number() OVER k AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM events WINDOW k AS ({_K}), v AS (PARTITION BY event_type ORDER BY user_id)")
def ranking(t: Tables):
    v = Window.partitionBy("event_type").orderBy("user_id")
    return t.events.select("event_id", F.row_number().over(_by(t)).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"))


@query(f"SELECT event_id, lag(value) OVER k AS p, lead(value, 2) OVER k AS n2, round(value - lag(value) OVER k, 6) AS diff FROM events WINDOW k AS ({_K})")
def lag_lead(t: Tables):
    k = _by(t)
    return t.events.select("event_id", F.lag("value").over(k).alias("p"), F.lead("value", 2).over(k).alias("n2"), F.round(F.col("value") - F.lag("value").over(k), 6).alias("diff"))


@query(f"SELECT event_id, ntile(4) OVER ({_K}) AS q FROM events")
def ntile(t: Tables):
    return t.events.select("event_id", F.ntile(4).over(_by(t)).cast("long").alias("q"))


@query(f"SELECT event_id, round(avg(value) OVER w, 6) AS m, round(sum(value) OVER w, 4) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi, round(stddev_samp(value) OVER w, 6) AS sd, round(var_samp(value) OVER w, 7) AS v, count(value) OVER w AS n FROM events {_F5}")
def rolling_basic(t: Tables):
    x, w = F.col("value"), _w()
    return t.events.select("event_id", F.round(W.rolling_mean(x, w), 6).alias("m"), F.round(W.rolling_sum(x, w), 4).alias("s"), W.rolling_min(x, w).alias("lo"), W.rolling_max(x, w).alias("hi"), F.round(W.rolling_std(x, w), 6).alias("sd"), F.round(W.rolling_var(x, w), 7).alias("v"), W.rolling_count(x, w).alias("n"))


@query("SELECT day, round(avg(s) OVER w, 4) AS a, round(sum(s) OVER w, 4) AS t FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) AS s FROM events GROUP BY 1) WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)")
def rolling_global(t: Tables):
    """A window without keys: over one row a day, not over events."""
    daily = t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum("value").alias("s"))
    w = W.frame((), "day", rows=7)
    return daily.select("day", F.round(W.rolling_mean(F.col("s"), w), 4).alias("a"), F.round(W.rolling_sum(F.col("s"), w), 4).alias("t"))


@query(f"SELECT event_id, round(avg(value) OVER w, 6) AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)")
def rolling_duration(t: Tables):
    e = rolling_duration_(t.events.select("event_id", "event_type", "ts", "value"), "value", "ts", "6h", ["event_type"])
    return e.select("event_id", F.round(F.when(F.col("count") > 0, F.col("total") / F.col("count")), 6).alias("m"), F.col("rows").alias("n"))


@query(f"SELECT event_id, round(sum(value * (user_id + 1)) OVER w / sum(user_id + 1) OVER w, 6) AS v FROM events {_F5}")
def rolling_vwap(t: Tables):
    return t.events.select("event_id", F.round(W.rolling_vwap(F.col("value"), F.col("user_id") + 1, _w()), 6).alias("v"))


@query(f"SELECT event_id, count(DISTINCT user_id) OVER w AS u FROM events {_F5}")
def rolling_distinct(t: Tables):
    return t.events.select("event_id", W.rolling_distinct(F.col("user_id"), _w()).cast("long").alias("u"))


@query(f"""WITH RECURSIVE o AS (SELECT event_id, event_type, value, row_number() OVER ({_K}) AS k FROM events),
    r AS (SELECT event_id, event_type, k, value AS y FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.event_type, o.k, 0.2 * o.value + 0.8 * r.y FROM r JOIN o ON o.event_type = r.event_type AND o.k = r.k + 1)
    SELECT event_id, round(y, 6) AS y FROM r""")
def ewma(t: Tables):
    return ewma_(t.events.select("event_id", "event_type", "ts", "value"), "y", "value", 0.2, ["event_type"], ["ts", "event_id"]).select("event_id", F.round("y", 6).alias("y"))


@query(f"SELECT event_id, round(list_avg(list_transform(list(value) OVER w, lambda v: abs(v - m))), 6) AS mad FROM (SELECT *, avg(value) OVER w AS m FROM events {_F5}) {_F5}")
def rolling_mad(t: Tables):
    return t.events.select("event_id", F.round(W.mad(F.col("value"), _w()), 6).alias("mad"))


@query(f"SELECT event_id, CASE WHEN count(*) OVER w >= 3 AND var_pop(value) OVER w > 0 THEN round(skewness(value) OVER w, 5) END AS sk FROM events {_F5}")
def rolling_skew(t: Tables):
    return t.events.select("event_id", F.round(W.skew(F.col("value"), _w()), 5).alias("sk"))


@query(f"SELECT event_id, CASE WHEN count(*) OVER w >= 4 AND var_pop(value) OVER w > 0 THEN round(kurtosis(value) OVER w, 5) END AS ku FROM events {_F5}")
def rolling_kurt(t: Tables):
    return t.events.select("event_id", F.round(W.kurt(F.col("value"), _w()), 5).alias("ku"))


@query(f"SELECT event_id, list_position(l, list_max(l))::DOUBLE AS hi, list_position(l, list_min(l))::DOUBLE AS lo FROM (SELECT event_id, list(value) OVER w AS l FROM events {_F5})")
def rolling_idx(t: Tables):
    return t.events.select("event_id", W.idxmax(F.col("value"), _w()).alias("hi"), W.idxmin(F.col("value"), _w()).alias("lo"))


@query(f"SELECT event_id, round((len(list_filter(l, lambda v: v < value)) + (len(list_filter(l, lambda v: v = value)) + 1) / 2) / len(l), 6) AS r FROM (SELECT event_id, value, list(value) OVER w AS l FROM events {_F5})")
def ts_rank(t: Tables):
    return t.events.select("event_id", F.round(W.ts_rank(F.col("value"), _w()), 6).alias("r"))


@query(f"SELECT event_id, CASE WHEN var_pop(value) OVER w > 0 AND var_pop(user_id) OVER w > 0 THEN round(covar_pop(value, user_id) OVER w / sqrt(var_pop(value) OVER w * var_pop(user_id) OVER w), 6) END AS r FROM events {_F5}")
def ts_corr(t: Tables):
    return t.events.select("event_id", F.round(W.ts_corr(F.col("value"), F.col("user_id").cast("double"), _w()), 6).alias("r"))


@query(f"SELECT event_id, round(covar_samp(value, user_id) OVER w, 4) AS c FROM events {_F5}")
def ts_cov(t: Tables):
    return t.events.select("event_id", F.round(W.ts_cov(F.col("value"), F.col("user_id").cast("double"), _w()), 4).alias("c"))


@query(f"SELECT event_id, round(regr_slope(value, k) OVER w, 6) AS b FROM (SELECT *, row_number() OVER ({_K})::DOUBLE AS k FROM events) {_F5} QUALIFY count(*) OVER w > 1")
def rolling_regr(t: Tables):
    from ..functions.values import clean

    w = _w()
    rows = t.events.withColumn("k", F.row_number().over(_by(t)).cast("double"))
    slope = F.covar_pop("value", "k").over(w) / F.nullif(F.var_pop("k").over(w), F.lit(0.0))
    return rows.select("event_id", F.round(slope, 6).alias("b"), W.rolling_count(F.col("value"), w).alias("n"), clean(F.col("k")).alias("kk")).where("n > 1").drop("n", "kk")


@query("SELECT event_id, round((rank() OVER (PARTITION BY ts::DATE ORDER BY user_id) + (count(*) OVER (PARTITION BY ts::DATE, user_id) - 1) / 2) / count(*) OVER (PARTITION BY ts::DATE), 9) AS r FROM events")
def cs_rank(t: Tables):
    return t.events.withColumn("day", F.to_date("ts")).select("event_id", F.round(W.cs_rank(F.col("user_id").cast("double"), "day"), 9).alias("r"))


@query("""WITH s AS (SELECT event_id, value, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY ts::DATE) AS n FROM events),
    e AS (SELECT day, max(CASE WHEN k = floor(0.1 * n) THEN value END) AS lo, max(CASE WHEN k = ceil(0.9 * n) - 1 THEN value END) AS hi FROM s GROUP BY 1)
    SELECT event_id, CASE WHEN k < floor(0.1 * n) THEN lo WHEN k >= ceil(0.9 * n) THEN hi ELSE value END AS x FROM s JOIN e USING (day)""")
def cs_winsorize(t: Tables):
    return W.with_winsorized(t.events.withColumn("day", F.to_date("ts")), "x", F.col("value"), 0.1, 0.9, "day").select("event_id", "x")


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY ts::DATE), 6) AS x FROM events")
def cs_demean(t: Tables):
    return t.events.withColumn("day", F.to_date("ts")).select("event_id", F.round(W.cs_demean(F.col("value"), "day"), 6).alias("x"))


@query("SELECT event_id, round((value - avg(value) OVER d) / nullif(stddev_samp(value) OVER d, 0), 6) AS x FROM events WINDOW d AS (PARTITION BY ts::DATE)")
def cs_zscore(t: Tables):
    return t.events.withColumn("day", F.to_date("ts")).select("event_id", F.round(W.cs_zscore(F.col("value"), "day"), 6).alias("x"))


@query(f"SELECT event_id, round(sum(value) OVER w, 3) AS s, max(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS ({_K} ROWS UNBOUNDED PRECEDING)")
def expanding(t: Tables):
    x, w = F.col("value"), _w(rows=(None, 0))
    return t.events.select("event_id", F.round(W.rolling_sum(x, w), 3).alias("s"), W.rolling_max(x, w).alias("m"), W.rolling_count(x, w).alias("n"))
