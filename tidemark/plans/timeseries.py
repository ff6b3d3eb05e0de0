"""Queries: bars, buckets, as-of joins, gap filling and pipelines of them, on events as trades."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window, functions as F

from ..functions.time import time_bucket
from ..functions.values import ratio
from ..operators import bars
from ..operators.asof import asof_join
from ..operators.gapfill import gapfill
from .registry import Tables, query
from .sql import sql as sql_

_OHLCV = """SELECT time_bucket(INTERVAL {width}, ts) AS bucket, event_type, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, sum(user_id + 1)::BIGINT AS volume, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS vwap, count(*) AS n FROM events GROUP BY 1, 2"""


@query(_OHLCV.format(width="1 DAY"))
def ohlcv(t: Tables):
    return bars.ohlcv(t.events, "1d", "ts", "value", F.col("user_id") + 1, ["event_type"], seq="event_id").withColumn("vwap", F.round("vwap", 6))


@query(_OHLCV.format(width="1 HOUR"))
def ohlcv_hourly(t: Tables):
    return bars.ohlcv(t.events, "1h", "ts", "value", F.col("user_id") + 1, ["event_type"], seq="event_id").withColumn("vwap", F.round("vwap", 6))


@query("""SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, sum(user_id + 1)::BIGINT AS volume, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS vwap FROM events GROUP BY 1""")
def finance_rollup(t: Tables):
    """A state for each day, as it could be kept for each immutable file, merged."""
    days = t.events.withColumn("day", F.to_date("ts"))
    state = bars.rollup_state(days, ["day", "event_type"], "ts", "value", F.col("user_id") + 1, "event_id")
    return bars.finish_rollup(bars.merge_rollups(state, ["event_type"]), ["event_type"]).withColumn("vwap", F.round("vwap", 6))


@query("""SELECT (e // 3600 + 1) * 3600 AS ts_init, e // 3600 * 3600 AS ts_event, event_type AS instrument_id, 0 AS outcome, first(value ORDER BY e, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY e, event_id) AS close, sum(user_id)::BIGINT AS volume FROM (SELECT *, epoch(ts)::BIGINT AS e FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)) GROUP BY 1, 2, 3""")
def bars_from_trades(t: Tables):
    trades = t.events.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_init"), F.col("event_type").alias("instrument_id"), F.lit(0).alias("outcome"), F.col("value").alias("price"), F.col("user_id").alias("size"), "event_id")
    return bars.bars_from_trades(trades, 3600, seq="event_id")


@query("SELECT event_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_on(t: Tables):
    return bars.latest_on(t.events, "event_type", "ts", "event_id").select("event_id", "event_type", "ts", "value")


# --- buckets ------------------------------------------------------------------------------------------------------


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events", name="time_bucket")
def time_bucket_(t: Tables):
    return t.events.select("event_id", time_bucket("15m", F.col("ts")).alias("b"))


@query("SELECT event_id, time_bucket(INTERVAL 1 WEEK, ts) AS b FROM events")
def time_bucket_week(t: Tables):
    return t.events.select("event_id", time_bucket("1w", F.col("ts")).alias("b"))


@query("SELECT o_orderkey, time_bucket(INTERVAL 3 MONTH, o_orderdate) AS b FROM orders")
def time_bucket_month(t: Tables):
    return t.orders.select("o_orderkey", time_bucket("3mo", F.col("o_orderdate")).alias("b"))


@query("SELECT event_id, time_bucket(INTERVAL 7 HOUR, ts, TIMESTAMP '2024-01-01 02:00:00') AS b FROM events")
def time_bucket_origin(t: Tables):
    return t.events.select("event_id", time_bucket("7h", F.col("ts"), origin=datetime(2024, 1, 1, 2)).alias("b"))


@query("SELECT event_id, time_bucket(INTERVAL 1 DAY, ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS b FROM events")
def time_bucket_tz(t: Tables):
    """New York is five hours behind UTC throughout the events' January."""
    return t.events.select("event_id", time_bucket("1d", F.col("ts"), tz="America/New_York").alias("b"))


# --- as-of joins: purchases to the same user's clicks -------------------------------------------------------------

_SIDES = "WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'click') "


def _sides(t: Tables):
    return t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), t.events.where("event_type = 'click'").select("user_id", "ts", "value", "event_id")


def _out(df):
    return df.select("event_id", "ts_right", "value_right")


@query(_SIDES + "SELECT l.event_id, r.ts AS ts_right, r.value AS value_right FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_backward(t: Tables):
    left, right = _sides(t)
    return _out(asof_join(left, right, "ts", ["user_id"], seq="event_id"))


@query(_SIDES + "SELECT l.event_id, r.ts AS ts_right, r.value AS value_right FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts")
def asof_forward(t: Tables):
    left, right = _sides(t)
    return _out(asof_join(left, right, "ts", ["user_id"], direction="forward", seq="event_id"))


@query(_SIDES + "SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.ts END AS ts_right, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.value END AS value_right FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_tolerance(t: Tables):
    left, right = _sides(t)
    return _out(asof_join(left, right, "ts", ["user_id"], tolerance="6h", seq="event_id"))


@query(_SIDES + "SELECT l.event_id, r.ts AS ts_right, r.value AS value_right FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_inner(t: Tables):
    left, right = _sides(t)
    return _out(asof_join(left, right, "ts", ["user_id"], how="inner", seq="event_id"))


@query(_SIDES + ", u AS (SELECT ts, last(value ORDER BY event_id) AS value FROM r GROUP BY 1) SELECT l.event_id, u.ts AS ts_right, u.value AS value_right FROM l ASOF LEFT JOIN u ON l.ts >= u.ts")
def asof_no_by(t: Tables):
    """No key: time slices share the work."""
    left, right = _sides(t)
    return _out(asof_join(left, right, "ts", seq="event_id", slice="1d"))


# --- gap filling --------------------------------------------------------------------------------------------------

_GRID = """WITH o AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, last(value ORDER BY event_id) AS value, last(event_id ORDER BY event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(ts) FROM o), (SELECT max(ts) FROM o), INTERVAL 1 HOUR)) AS ts),
    b AS (SELECT coalesce(o.ts, g.ts) AS ts, o.value, o.event_id, g.ts IS NOT NULL AS grid FROM o FULL JOIN g ON o.ts = g.ts), """
_FILLED = """p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS t0, last_value(value IGNORE NULLS) OVER w AS v0, last_value(event_id IGNORE NULLS) OVER w AS e0,
    first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t1, first_value(value IGNORE NULLS) OVER a AS v1, first_value(event_id IGNORE NULLS) OVER a AS e1 FROM b
    WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING), a AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) """


def _observed(t: Tables):
    e = t.events.where("event_type = 'error'")
    return e.select(time_bucket("10m", F.col("ts")).alias("ts"), "value", "event_id")


@query(_GRID + "x AS (SELECT 1) SELECT ts, value, event_id FROM b WHERE grid")
def gapfill_null(t: Tables):
    return gapfill(_observed(t), "ts", "1h", seq="event_id")


@query(_GRID + _FILLED + "SELECT ts, v0 AS value, e0 AS event_id FROM p WHERE grid")
def gapfill_locf(t: Tables):
    return gapfill(_observed(t), "ts", "1h", "locf", seq="event_id")


@query(_GRID + _FILLED + "SELECT ts, round(coalesce(value, v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))), 6) AS value FROM p WHERE grid")
def gapfill_linear(t: Tables):
    return gapfill(_observed(t), "ts", "1h", "linear", seq="event_id").select("ts", F.round("value", 6).alias("value"))


@query(_GRID + "x AS (SELECT 1) SELECT ts, coalesce(value, -1) AS value, coalesce(event_id, -1) AS event_id FROM b WHERE grid")
def gapfill_value(t: Tables):
    return gapfill(_observed(t), "ts", "1h", "value", -1, seq="event_id")


# --- compositions -------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2),
    r AS (SELECT *, close / lag(close) OVER k - 1 AS simple, ln(close / lag(close) OVER k) AS logret FROM d WHERE close > 0 WINDOW k AS (PARTITION BY event_type ORDER BY day))
    SELECT day, event_type, round(simple, 6) AS simple, round(logret, 6) AS logret, round(stddev_samp(logret) OVER (PARTITION BY event_type ORDER BY day ROWS 4 PRECEDING), 6) AS vol FROM r""")
def returns_vol(t: Tables):
    daily = bars.ohlcv(t.events, "1d", "ts", "value", F.lit(1), ["event_type"], seq="event_id").where("close > 0")
    k = Window.partitionBy("event_type").orderBy("bucket")
    r = daily.withColumn("before", F.lag("close").over(k)).withColumns({"simple": ratio(F.col("close"), F.col("before")) - 1, "logret": F.ln(ratio(F.col("close"), F.col("before")))})
    w = k.rowsBetween(-4, 0)
    vol = F.when(F.count("logret").over(w) > 1, F.stddev_samp("logret").over(w))
    return r.select(F.col("bucket").alias("day"), "event_type", F.round("simple", 6).alias("simple"), F.round("logret", 6).alias("logret"), F.round(vol, 6).alias("vol"))


@query(_SIDES + """, j AS (SELECT l.ts, l.user_id, l.event_id, l.value - r.value AS edge, l.value FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts),
    d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, last(value ORDER BY ts, event_id) AS close, avg(edge) AS edge, count(*) AS n FROM j GROUP BY 1)
    SELECT day, round(ln(close / nullif(lag(close) OVER (ORDER BY day), 0)), 6) AS logret, round(edge, 6) AS edge, n FROM d""")
def quant_pipeline(t: Tables):
    """As-of join, then daily bars, then returns."""
    left, right = _sides(t)
    j = asof_join(left, right, "ts", ["user_id"], how="inner", seq="event_id").withColumn("day", time_bucket("1d", F.col("ts")))
    d = j.groupBy("day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.avg(F.col("value") - F.col("value_right")).alias("edge"), F.count(F.lit(1)).alias("n"))
    return d.select("day", F.round(F.ln(ratio(F.col("close"), F.lag("close").over(Window.orderBy("day")))), 6).alias("logret"), F.round("edge", 6).alias("edge"), "n")


# --- windows of time, as batch forms of streaming ones ------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")
def tumbling(t: Tables):
    return t.events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("s")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "s")


@query("""WITH h AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start FROM events, range(3) AS r(k))
    SELECT start, count(*) AS n FROM h WHERE start <= ts AND ts < start + INTERVAL 3 HOUR GROUP BY 1""")
def sliding(t: Tables):
    return t.events.groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER k + INTERVAL 12 HOUR OR lag(ts) OVER k IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS finish, count(*) AS n FROM s GROUP BY user_id, sess""")
def session(t: Tables):
    w = F.session_window("ts", "12 hours").alias("w")
    return t.events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), "n")


@query("SELECT a.event_id, a.user_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.event_id <= a.event_id) AS event_id_right FROM events a WHERE a.event_type = 'purchase'")
def asof_sql(t: Tables):
    """An as-of join written as SQL: each purchase with the user's last view before it."""
    t.events.where("event_type = 'purchase'").select("event_id", "user_id").createOrReplaceTempView("tm_purchases")
    t.events.where("event_type = 'view'").select("event_id", "user_id").createOrReplaceTempView("tm_views")
    return sql_(t.spark, "SELECT event_id, user_id, event_id_right FROM tm_purchases ASOF LEFT JOIN tm_views MATCH_CONDITION (tm_purchases.event_id >= tm_views.event_id) ON tm_purchases.user_id = tm_views.user_id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS mean FROM events")
def rolling_sql(t: Tables):
    """Rolling shorthands in SQL text."""
    t.events.createOrReplaceTempView("tm_events")
    return sql_(t.spark, "SELECT event_id, round(rolling_avg(value, event_id, 10, event_type), 8) AS mean FROM tm_events")
