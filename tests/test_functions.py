from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import aggregates as A, windows as W
from tidemark.functions.time import parse_width, time_bucket
from tidemark.functions.values import int_div, is_in, log_growth
from tidemark.operators.asof import asof_join
from tidemark.operators.bars import latest_on, ohlcv
from tidemark.operators.ewma import ewma
from tidemark.operators.gapfill import gapfill
from tidemark.operators.rolling import rolling_duration


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_rolling_golden_values(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 10])], "t int, x double")
    w = W.frame((), "t", rows=5)
    x = F.col("x")
    last = df.select("t", W.idxmax(x, w), W.idxmin(x, w), W.mad(x, w), W.skew(x, w), W.kurt(x, w), W.ts_rank(x, w)).orderBy(F.col("t").desc()).first()
    assert tuple(last)[1:] == pytest.approx((5, 1, 2.4, 1.697056274847714, 3.152, 1.0))
    assert [r[0] for r in values(df.orderBy("t"), W.idxmax(x, W.frame((), "t", rows=3)).alias("i"))] == [1, 2, 3, 3, 3]


def test_rolling_duration_is_linear(spark):
    """Frames over slices, ties, gaps, nulls and rows without a time equal brute force; no window slides over a frame."""
    rows = [(i, "ab"[i % 2], i * 7 % 40 * 3 if i % 11 else None, [1.0, None, float("nan"), 2.5][i % 4] if i % 3 else float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k string, s int, x double").withColumn("ts", F.timestamp_seconds("s"))
    out = rolling_duration(df, "x", "ts", "10s", ["k"])
    got = {r["id"]: (r["total"], r["count"], r["rows"]) for r in out.collect()}
    for i, k, s, _ in rows:
        inside = [x for _, k2, s2, x in rows if k2 == k and (s2 is None if s is None else s2 is not None and s - 10 <= s2 <= s)]
        known = [x for x in inside if x is not None and x == x]
        assert got[i] == (pytest.approx(sum(known)) if known else None, len(known), len(inside))
    assert len(got) == len(rows)
    plan = entry.queries()["rolling_duration"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" in plan and "RangeFrame, -" not in plan


def test_ts_rank_falls(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([4, 3, 2, 1])], "t int, x double")
    got = [r[1] for r in sorted(values(df, "t", W.ts_rank(F.col("x"), W.frame((), "t", rows=3)).alias("r")))]
    assert got == pytest.approx([1, 1 / 2, 1 / 3, 1 / 3])


def test_nan_and_null_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 3.0)], "t int, x double")
    w = W.frame((), "t", rows=(None, 0))
    got = sorted(values(df, "t", W.rolling_mean(F.col("x"), w).alias("m"), W.idxmax(F.col("x"), w).alias("i"), W.ts_rank(F.col("x"), w).alias("r")))
    assert got == [(1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, None), (3, 1.0, 1.0, None), (4, 2.0, 4.0, 1.0)]


def test_constant_sides_have_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0)], "t int, x double, y double")
    w = W.frame((), "t", rows=2)
    assert {r[0] for r in values(df, W.ts_corr(F.col("x"), F.col("y"), w).alias("c"))} == {None}
    assert values(df, A.corr(F.col("x"), F.col("y")).alias("c"), A.slope(F.col("x"), F.col("y")).alias("s")) == [(None, None)]


def test_cross_section(spark):
    df = spark.createDataFrame([(1, "A", 10.0), (1, "B", 20.0), (1, "C", 20.0), (1, "D", 40.0), (1, "E", None), (2, "A", 1.0), (2, "B", 2.0), (2, "C", 3.0), (2, "D", 4.0)], "t int, s string, f double")
    ranks = {(t, s): r for t, s, r in values(df, "t", "s", W.cs_rank(F.col("f"), "t").alias("r"))}
    assert [ranks[1, s] for s in "ABCDE"] == [0.25, 0.625, 0.625, 1.0, None]
    low = {(t, s): x for t, s, x in values(W.with_winsorized(df, "x", F.col("f"), 0.25, 1, "t"), "t", "s", "x")}
    assert low[1, "A"] == 20 and low[1, "D"] == 40 and low[1, "E"] is None
    high = {(t, s): x for t, s, x in values(W.with_winsorized(df, "x", F.col("f"), 0, 0.75, "t"), "t", "s", "x")}
    assert high[1, "D"] == 20 and high[2, "D"] == 3 and high[1, "A"] == 10
    with pytest.raises(ValueError):
        W.with_winsorized(df, "x", F.col("f"), 0.9, 0.1, "t")


def test_vwap_and_ewma(spark):
    df = spark.createDataFrame([(1, "A", 10.0, 10), (2, "A", 20.0, 10), (3, "B", 30.0, 10), (4, "B", 50.0, 10), (5, "C", 1.0, 0)], "t int, s string, p double, n int")
    got = dict(values(df.groupBy("s").agg(A.vwap(F.col("p"), F.col("n")).alias("v")), "s", "v"))
    assert got == {"A": 15, "B": 40, "C": None}
    e = spark.createDataFrame([(0, "A", None), (1, "A", 10.0), (2, "A", None), (3, "A", 20.0)], "t int, s string, p double")
    assert [r[1] for r in sorted(values(ewma(e, "y", "p", 0.5, ["s"], ["t"]), "t", "y"))] == [None, 10.0, 10.0, 15.0]
    with pytest.raises(ValueError):
        ewma(e, "y", "p", 1.5, ["s"], ["t"])


def test_time_buckets(spark):
    assert parse_width("1.5h").micros == 5_400_000_000 and parse_width("1y 2mo").months == 14
    for bad in ("", "0s", "1x", "1mo 1d", "0.5mo"):
        with pytest.raises(ValueError):
            parse_width(bad)
    df = spark.createDataFrame([(datetime(1999, 12, 31, 23, 59),), (datetime(2024, 5, 17, 12),)], "ts timestamp_ntz")
    assert [r[0] for r in sorted(values(df, time_bucket("1w", F.col("ts")).alias("b")))] == [datetime(1999, 12, 27), datetime(2024, 5, 13)]
    assert [r[0] for r in sorted(values(df, time_bucket("3mo", F.col("ts")).alias("b")))] == [datetime(1999, 10, 1), datetime(2024, 4, 1)]
    assert values(df.where("year(ts) = 2024"), time_bucket("1d", F.col("ts"), tz="Asia/Tokyo").alias("b")) == [(datetime(2024, 5, 16, 15),)]


def test_asof(spark):
    trades = spark.createDataFrame([(5, "A", 100.0), (10, "B", 200.0), (15, "A", 101.0), (25, "A", 102.0)], "t long, s string, p double")
    quotes = spark.createDataFrame([(0, "A", 99.0, 1), (11, "B", 199.0, 2), (12, "A", 100.5, 3), (20, "A", 101.5, 4)], "t long, s string, bid double, seq int")
    for slice in (None, "7"):
        bids = lambda **kw: [r[1] for r in sorted(values(asof_join(trades, quotes, "t", ["s"], seq="seq", slice=slice, **kw), "t", "bid"))]  # noqa: B023, E731
        assert bids() == [99.0, None, 100.5, 101.5]
        assert bids(tolerance=4) == [None, None, 100.5, None]
        assert bids(direction="forward") == [100.5, 199.0, 101.5, None]
        assert bids(how="inner") == [99.0, 100.5, 101.5]
    tie = spark.createDataFrame([(10, "A", 1.0, 1), (10, "A", 2.0, 2)], "t long, s string, bid double, seq int")
    assert values(asof_join(trades.where("t = 15"), tie, "t", ["s"], seq="seq"), "bid") == [(2.0,)]
    nulls = quotes.withColumn("bid", F.lit(None).cast("double"))
    assert values(asof_join(trades.where("t = 15"), nulls, "t", ["s"], seq="seq"), "bid", "t_right") == [(None, 12)]


def test_gapfill(spark):
    df = spark.createDataFrame([(0, 0.0, 1), (20, 20.0, 3), (7, 7.0, 9)], "t long, p double, n long")
    got = lambda *a: sorted(values(gapfill(df, "t", 10, *a), "t", "p", "n"))
    assert got() == [(0, 0.0, 1), (10, None, None), (20, 20.0, 3)]
    assert got("locf") == [(0, 0.0, 1), (10, 7.0, 9), (20, 20.0, 3)]
    assert got("linear") == [(0, 0.0, 1), (10, 10.0, 8), (20, 20.0, 3)]
    assert got("value", 5) == [(0, 0.0, 1), (10, 5.0, 5), (20, 20.0, 3)]
    with pytest.raises(Exception, match="the grid has over"):
        gapfill(df, "t", 1, max_rows=5).collect()


def test_bars_and_latest(spark):
    day = datetime(2024, 1, 1)
    at = [day, day.replace(microsecond=10), day.replace(second=59, microsecond=999999), day.replace(minute=1), day.replace(minute=1, microsecond=5)]
    df = spark.createDataFrame([(t, "A", p, i) for i, (t, p) in enumerate(zip(at, [1.0, 2.0, 3.0, 10.0, 20.0], strict=True))], "ts timestamp_ntz, s string, p double, seq int")
    got = values(ohlcv(df, "1m", "ts", "p", F.lit(1), ["s"], "seq").orderBy("bucket"), "open", "high", "low", "close", "n")
    assert got == [(1, 3, 1, 3, 3), (10, 20, 10, 20, 2)]
    tie = spark.createDataFrame([("A", 1, 1), ("A", 2, 2), ("A", 2, 3), (None, 9, 9)], "k string, t int, seq int")
    assert values(latest_on(tie, "k", "t", "seq"), "k", "t", "seq") == [("A", 2, 3)]


def test_values(spark):
    df = spark.createDataFrame([(-7, 2), (7, 0)], "a int, b int")
    assert values(df, int_div(F.col("a"), F.col("b")).alias("q"), is_in(F.col("a"), []).alias("i")) == [(-3, False), (None, False)]
    r = spark.createDataFrame([(-1.0,), (0.0,)], "r double")
    assert values(r, log_growth(F.col("r")).alias("g")) == [(float("-inf"),), (0.0,)]
