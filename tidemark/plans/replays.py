"""Queries: event replay, signals and settlement, on events as trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..replay import signals as S, streams as R
from .registry import Tables, query

_TRADES = "t AS (SELECT epoch_us(ts) AS ts, event_type AS instrument_id, value + 1 AS price, user_id + 1 AS size, event_id FROM events)"
_BARS = "WITH b AS (SELECT strftime(ts, '%Y-%m-%d %H') AS ts, event_type AS instrument_id, avg(value) AS price, sum(user_id + 1) AS size FROM events GROUP BY 1, 2)"


def _bars(t: Tables):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("ts"), F.col("event_type").alias("instrument_id")).agg(F.avg("value").alias("price"), F.sum(F.col("user_id") + 1).alias("size"))


def _signals(enter: str, leave: str, columns: str) -> str:
    return _BARS + f""", i AS (SELECT *, {columns}), s AS (SELECT *, CASE WHEN {leave} THEN 0 WHEN {enter} THEN 1 END AS sign FROM i),
        h AS (SELECT *, coalesce(last_value(sign IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS st FROM s),
        c AS (SELECT ts, instrument_id, st - coalesce(lag(st) OVER (PARTITION BY instrument_id ORDER BY ts), 0) AS signal FROM h) SELECT ts, instrument_id, signal::INTEGER AS signal FROM c WHERE signal <> 0"""


_K = "PARTITION BY instrument_id ORDER BY ts"


@query(_signals("m > 0.02", "m < -0.02", f"price / lag(price, 5) OVER ({_K}) - 1 AS m FROM b"))
def signals_momentum(t: Tables):
    return S.threshold_momentum(_bars(t)).select("ts", "instrument_id", F.col("signal").cast("int").alias("signal"))


@query(_signals("z < -1", "z > 0", f"(price - avg(price) OVER w) / nullif(CASE WHEN count(price) OVER w = 20 THEN stddev_samp(price) OVER w END, 0) AS z FROM b WINDOW w AS ({_K} ROWS 19 PRECEDING)"))
def signals_meanrev(t: Tables):
    return S.mean_reversion(_bars(t)).select("ts", "instrument_id", F.col("signal").cast("int").alias("signal"))


@query(_signals("price > hi", "price < lo", f"CASE WHEN count(price) OVER w = 20 THEN max(price) OVER w END AS hi, CASE WHEN count(price) OVER w = 20 THEN min(price) OVER w END AS lo FROM b WINDOW w AS ({_K} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"))
def signals_breakout(t: Tables):
    return S.breakout(_bars(t)).select("ts", "instrument_id", F.col("signal").cast("int").alias("signal"))


@query(_signals("price < v * 0.99", "price >= v", f"sum(price * size) OVER w / sum(size) OVER w AS v FROM b WINDOW w AS ({_K} ROWS 19 PRECEDING)"))
def signals_vwap_reversion(t: Tables):
    return S.vwap_reversion(_bars(t)).select("ts", "instrument_id", F.col("signal").cast("int").alias("signal"))


@query(_BARS + """, r AS (SELECT ts, ln(a.price / b.price) AS r FROM (SELECT * FROM b WHERE instrument_id = 'click') a JOIN (SELECT * FROM b WHERE instrument_id = 'view') b USING (ts) WHERE a.price > 0 AND b.price > 0),
    z AS (SELECT ts, (r - avg(r) OVER w) / nullif(CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END, 0) AS z FROM r WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING)),
    s AS (SELECT ts, coalesce(last_value(CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 WHEN abs(z) < 0.5 THEN 0 END IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS signal FROM z)
    SELECT ts, signal::INTEGER AS signal FROM (SELECT *, coalesce(lag(signal) OVER (ORDER BY ts), 0) AS b FROM s) WHERE signal <> b""")
def pair_arbitrage(t: Tables):
    return S.pair_arbitrage(_bars(t).where("price > 0"), "click", "view").select("ts", F.col("signal").cast("int").alias("signal"))


@query(f"""WITH {_TRADES}, f AS (SELECT ts, instrument_id, size FROM t WHERE event_id % 10 = 0), m AS (SELECT ts, 30 AS priority, 0 AS stream, event_id AS arrival FROM t UNION ALL SELECT ts, 35, 1, event_id FROM t WHERE event_id % 10 = 0)
    SELECT ts AS ts_init, priority, stream, arrival, row_number() OVER (ORDER BY ts, priority, stream, arrival) AS place FROM m""")
def replay_merge(t: Tables):
    trades = t.events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_init"), F.lit("trade").alias("kind"), F.col("event_id").alias("arrival"))
    funding = trades.where("arrival % 10 = 0").withColumn("kind", F.lit("funding"))
    return R.placed([trades, funding], 3_600_000_000, check=False).select("ts_init", "priority", "stream", "arrival", "place")


@query("SELECT event_type AS instrument_id, ts, max(value) FILTER (user_id % 2 = 0) AS bid, min(value) FILTER (user_id % 2 = 1) AS ask, round((max(value) FILTER (user_id % 2 = 0) + min(value) FILTER (user_id % 2 = 1)) / 2, 6) AS mid FROM (SELECT event_type, user_id, value, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events WHERE value > 5) GROUP BY 1, 2")
def quote_panel(t: Tables):
    deltas = t.events.select(F.col("event_type").alias("instrument_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("value").alias("price"), F.when(F.col("value") > 5, 1).otherwise(0).alias("size"), F.lit("set").alias("action"))
    return R.quote_panel(deltas).withColumn("mid", F.round("mid", 6))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_quantity * 0.001, 5) AS proportional, round(CASE WHEN l_returnflag = 'R' THEN l_discount * (1 - l_discount) * l_quantity * 0.07 ELSE 0 - l_discount * (1 - l_discount) * l_quantity * 0.07 * 0.5 END, 9) AS prediction FROM lineitem")
def fees(t: Tables):
    taker = F.col("l_returnflag") == "R"
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(R.fee("proportional", F.col("l_extendedprice"), F.col("l_quantity"), taker, 0.001), 5).alias("proportional"), F.round(R.fee("prediction", F.col("l_discount"), F.col("l_quantity"), taker, 0.07, 0.5), 9).alias("prediction"))


@query("""WITH RECURSIVE f AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END * (user_id % 7 + 1))::HUGEINT * 1000000000 AS d, round(value * 1000000000)::HUGEINT AS p, (user_id % 3)::HUGEINT * 1000 AS c FROM events),
    s(k, n, q, a, r, fee) AS (SELECT DISTINCT k, 0::BIGINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT FROM f
        UNION ALL SELECT s.k, f.n, q + d,
            CASE WHEN q + d = 0 THEN 0 WHEN q = 0 OR sign(q) = sign(d) THEN (a * abs(q) + p * abs(d)) // abs(q + d) WHEN abs(d) > abs(q) THEN p ELSE a END,
            r + CASE WHEN q = 0 OR sign(q) = sign(d) THEN 0 ELSE (p - a) * least(abs(d), abs(q)) * sign(q) // 1000000000 END - c, fee + c
        FROM s JOIN f ON f.k = s.k AND f.n = s.n + 1)
    SELECT k AS instrument_id, 0 AS outcome, q::BIGINT AS quantity, a::BIGINT AS average_price, r::BIGINT AS realized_pnl, fee::BIGINT AS commissions FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1""")
def position_fold(t: Tables):
    e = t.events
    side = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    fills = e.select(F.col("event_type").alias("instrument_id"), F.lit(0).alias("outcome"), F.col("event_id").alias("seq"), (side * (F.col("user_id") % 7 + 1) * R.SCALE).alias("quantity"), F.round(F.col("value") * R.SCALE).cast("long").alias("price"), (F.col("user_id") % 3 * 1000).alias("commission"))
    return R.fold_positions(fills)


@query("WITH t AS (SELECT ts, event_type AS instrument_id, event_id, (user_id % 5)::BIGINT AS target FROM events), d AS (SELECT ts, instrument_id, target - coalesce(lag(target) OVER (PARTITION BY instrument_id ORDER BY ts), 0) AS quantity FROM t) SELECT * FROM d WHERE quantity <> 0")
def target_positions(t: Tables):
    return R.target_positions(t.events.select("ts", F.col("event_type").alias("instrument_id"), (F.col("user_id") % 5).alias("target")))


@query("""SELECT c_custkey AS position_id, c_nationkey AS instrument_id, round(CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 1 THEN 1.0 ELSE 0.0 END WHEN n_nationkey % 3 = 1 THEN 0.5 ELSE 0.4 END * 10 - 4, 6) AS settlement
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 WHERE n_nationkey IS NOT NULL
    UNION ALL SELECT c_custkey, c_nationkey, NULL FROM customer WHERE c_nationkey >= 20""")
def settlement(t: Tables):
    positions = t.customer.select(F.col("c_custkey").alias("position_id"), F.col("c_nationkey").alias("instrument_id"), (F.col("c_custkey") % 2).alias("outcome"), F.lit(10.0).alias("quantity"), F.lit(0.4).alias("average_price"), F.lit(0.45).alias("mark"))
    k = F.col("n_nationkey") % 3
    resolutions = t.nation.select(F.col("n_nationkey").alias("instrument_id"), F.when(k == 0, "winner").when(k == 1, "split").otherwise("void").alias("kind"), F.lit(1).alias("outcome"), F.lit(0.5).alias("payout"), F.col("n_nationkey").alias("observable_at"))
    return R.settle(positions, resolutions, 19).select("position_id", "instrument_id", F.round("settlement", 6).alias("settlement"))


@query("""WITH s AS (SELECT event_type AS instrument_id, epoch(date_trunc('minute', ts))::BIGINT AS a, epoch(date_trunc('minute', ts))::BIGINT + 600 AS b FROM events),
    c AS (SELECT instrument_id, greatest(a, 1704067200) AS a, least(b, 1704672000) AS b FROM s), k AS (SELECT * FROM c WHERE b > a),
    o AS (SELECT *, greatest(0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY instrument_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1704067200))) AS own FROM k)
    SELECT instrument_id, sum(own)::BIGINT AS covered, (604800 - sum(own))::BIGINT AS missing, round(sum(own) / 604800, 6) AS ratio FROM o GROUP BY 1""")
def coverage(t: Tables):
    at = F.unix_timestamp(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    spans = t.events.select(F.col("event_type").alias("instrument_id"), at.alias("start"), (at + 600).alias("end"))
    return R.coverage(spans, 1704067200, 1704672000).withColumn("ratio", F.round("ratio", 6))


@query("WITH m AS (SELECT user_id % 50 AS trial, day(ts) AS fold, avg(value) AS score FROM events GROUP BY 1, 2), p AS (SELECT trial, median(score) AS score FROM m GROUP BY 1) SELECT trial, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, trial) AS rank FROM p QUALIFY rank <= 10")
def leaderboard(t: Tables):
    trials = t.events.groupBy((F.col("user_id") % 50).alias("trial"), F.day("ts").alias("fold")).agg(F.avg("value").alias("score"))
    return R.leaderboard(trials, "score", top=10).select("trial", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH r AS (SELECT l_partkey AS symbol, l_orderkey AS a, l_orderkey + l_quantity::BIGINT * 20 AS b FROM lineitem), m AS (SELECT o_orderkey AS t FROM orders) SELECT t, count(*) AS members, sum(symbol)::BIGINT AS symbols FROM m JOIN r ON a <= t AND t < b GROUP BY t")
def universe_asof(t: Tables):
    """All spans at all moments: how many members each moment has, and the sum of their symbols."""
    registry = t.lineitem.select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") * 20).alias("end"))
    moments = t.orders.select(F.col("o_orderkey").alias("t"))
    return R.members_total(registry, moments, "symbol", 16_384).withColumnRenamed("total", "symbols")


@query("""WITH s AS (SELECT event_type AS instrument_id, event_id AS ts, CASE WHEN user_id % 5 = 0 THEN 2.0 WHEN user_id % 5 = 1 THEN 0.0 END AS state FROM events),
    p AS (SELECT ts, instrument_id, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS target FROM s),
    d AS (SELECT ts, instrument_id, target - coalesce(lag(target) OVER (PARTITION BY instrument_id ORDER BY ts), 0) AS quantity FROM p)
    SELECT ts, instrument_id, quantity::DOUBLE AS quantity FROM d WHERE quantity <> 0""")
def from_signals(t: Tables):
    e, k = t.events, F.col("user_id") % 5
    return R.from_signals(e.select(F.col("event_id").alias("ts"), F.col("event_type").alias("instrument_id"), (k == 0).alias("entry"), (k == 1).alias("exit")), 2.0)
