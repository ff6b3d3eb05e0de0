import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.replay import streams as R
from tidemark.replay.book import LevelBook, OrderBook
from tidemark.replay.engine import SCALE, Config, Order, Position, Run, notional, simulate


def book(run, bids=(), asks=(), ts=1):
    rows = [("buy", p, q) for p, q in bids] + [("sell", p, q) for p, q in asks]
    for i, (side, p, q) in enumerate(rows):
        run.step({"ts_init": ts, "kind": "snapshot", "action": "snapshot", "instrument_id": "X", "side": side, "price": p * SCALE, "size": q * SCALE, "is_last": i == len(rows) - 1})


def test_books():
    b = LevelBook()
    b.apply("snapshot", "buy", 9, 5, False)
    b.apply("snapshot", "sell", 11, 5, True)
    b.apply("set", "sell", 12, 5)
    assert (b.bid, b.ask, b.mid, b.spread) == (9, 11, 10, 2)
    assert b.walk("buy", 7) == [(11, 5), (12, 2)] and b.walk("buy", 7, 11) == [(11, 5)]
    b.apply("set", "sell", 11, 0)
    assert b.ask == 12
    b.apply("gap")
    assert b.bid is None and b.walk("buy", 1) == []
    o = OrderBook()
    o.add("a", "buy", 9, 5)
    o.add("b", "buy", 9, 3)
    o.reduce("a", 2)
    assert o.ahead("b") == 3 and o.best("buy") == 9
    o.cancel("a")
    assert o.ahead("b") == 0


def test_rounding_and_positions():
    assert notional(3, SCALE // 2) == 2 and notional(-3, SCALE // 2) == -2
    p = Position()
    p.fill(2 * SCALE, 10 * SCALE, 0)
    p.fill(2 * SCALE, 20 * SCALE, 0)
    assert p.average == 15 * SCALE
    p.fill(-6 * SCALE, 18 * SCALE, 5)
    assert (p.quantity, p.average, p.realized) == (-2 * SCALE, 18 * SCALE, 12 * SCALE - 5)


def test_order_lifecycle():
    r = Run(Config(fee="proportional", rate=0.001))
    book(r, [(9, 5)], [(11, 5), (12, 5)])
    r.submit(Order("m", "X", "buy", 7 * SCALE))
    r.step({"ts_init": 2, "kind": "reference", "instrument_id": "X", "price": 10 * SCALE})
    assert r.orders["m"].status == "filled" and [f["price"] for f in r.fills] == [11 * SCALE, 12 * SCALE]
    r.submit(Order("f", "X", "buy", 9 * SCALE, tif="FOK"))
    r.submit(Order("p", "X", "buy", SCALE, "limit", 12 * SCALE, post_only=True))
    r.submit(Order("o", "X", "buy", SCALE, reduce_only=True))
    r.submit(Order("q", "X", "buy", 2 * SCALE, "limit", 9 * SCALE))
    r.submit(Order("s", "X", "sell", SCALE, trigger=8 * SCALE, trigger_above=False))
    r.step({"ts_init": 3, "kind": "reference", "instrument_id": "X", "price": 10 * SCALE})
    assert {k: r.orders[k].status for k in "fpoqs"} == {"f": "cancelled", "p": "rejected", "o": "rejected", "q": "resting", "s": "waiting"}
    r.step({"ts_init": 4, "kind": "trade", "instrument_id": "X", "price": 9 * SCALE, "size": 6 * SCALE, "aggressor": "sell"})
    assert r.orders["q"].filled == SCALE  # five were ahead
    r.amend("q", limit=8 * SCALE)
    r.cancel("q")
    r.step({"ts_init": 5, "kind": "reference", "instrument_id": "X", "price": 8 * SCALE})
    assert r.orders["q"].status == "cancelled" and r.orders["s"].status == "filled"
    r.step({"ts_init": 6, "kind": "funding", "instrument_id": "X", "rate": 0.01})
    assert r.equity() == r.cash + r.exposure()


def test_runs_are_independent(spark):
    order = json.dumps({"id": "a", "instrument": "X", "side": "buy", "quantity": SCALE})
    events = [(run, t, 20, 0, t, "snapshot", "snapshot", "X", side, p * SCALE, 5 * SCALE, last, None) for run in ("r1", "r2") for t, side, p, last in ((1, "buy", 9, False), (2, "sell", 11, True))]
    events += [("r1", 3, 40, 1, 3, "command", None, "X", None, None, None, None, order)]
    df = spark.createDataFrame(events, "run_id string, ts_init long, priority int, stream int, arrival long, kind string, action string, instrument_id string, side string, price long, size long, is_last boolean, command string")
    got = {r["run_id"]: r for r in simulate(df, {"r1": Config(), "r2": Config()}).collect()}
    assert got["r1"]["fills"] == 1 and got["r2"]["fills"] == 0
    assert got["r1"]["equity"] == got["r1"]["starting_cash"] - SCALE
    assert simulate(df, {"r1": Config(), "r2": Config()}, "fills").count() == 1


def test_streams(spark):
    s = spark.createDataFrame([(2, "trade", 0), (1, "trade", 1)], "ts_init long, kind string, arrival long")
    with pytest.raises(ValueError):
        R.merge([s])
    with pytest.raises(Exception, match="enters and exits"):
        R.from_signals(spark.createDataFrame([(1, "X", True, True)], "ts int, instrument_id string, entry boolean, exit boolean")).collect()
    got = R.from_signals(spark.createDataFrame([(1, "X", True, False), (2, "X", False, False), (3, "X", False, True)], "ts int, instrument_id string, entry boolean, exit boolean"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "X", 1.0), (3, "X", -1.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_need_no_single_task(spark):
    rows = [(i * 37 % 11 if i % 9 else None, i) for i in range(60)]
    s = spark.createDataFrame(rows, "ts_init long, arrival long").withColumn("kind", F.lit("trade"))
    f = s.where("arrival % 2 = 0").withColumn("kind", F.lit("funding"))
    out = R.placed([s, f], 4, check=False)
    want = [(*r[:4], i + 1) for i, r in enumerate(R.merge([s, f], check=False).collect())]
    assert sorted((tuple(r)[:4] + (r["place"],) for r in out.collect()), key=lambda r: r[-1]) == want
    for line in plan(entry.queries()["replay_merge"](spark, "/root/testdata/sf0.001")).splitlines():
        assert "row_number" not in line or "Window" not in line or "__slice" in line


def test_members_are_counted_without_pairs(spark):
    spans = [(i % 7 if i % 6 else None, i * 5 % 50 - 20, i * 5 % 50 - 20 + i % 23 - 2) for i in range(80)]
    registry = spark.createDataFrame(spans, "symbol long, start long, end long")
    moments = spark.createDataFrame([(i - 30,) for i in range(90)] + [(3,), (3,), (None,)], "t long")
    pairs = R.members_at(registry.where("start < end"), moments, 8).groupBy("t").agg(F.count(F.lit(1)).alias("members"), F.sum("symbol").alias("total"))
    got = R.members_total(registry, moments, "symbol", 8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    assert "Join" not in plan(entry.queries()["universe_asof"](spark, "/root/testdata/sf0.001"))


def test_a_run_holds_open_orders_only(spark):
    """Closed orders leave with their batch, in rows and counts; an open one stays, and an id may come again."""

    def watch(run, e):
        if len(run.orders) > 30:
            raise ValueError(f"{len(run.orders)} orders are held")

    def order(t, **more):
        return json.dumps({"id": str(t % 200), "instrument": "X", "side": "buy", "quantity": SCALE} | more)

    orders = [(t, order(t, reduce_only=t % 2 == 0)) for t in range(1, 400)] + [(0, order(1000, id="open", kind="limit", limit=5 * SCALE))]
    events = [("r", -1, 20, 0, 0, "snapshot", "sell", 9 * SCALE, 500 * SCALE, "X", None)] + [("r", t, 20, 0, t, "command", None, None, None, None, c) for t, c in orders]
    df = spark.createDataFrame(events, "run_id string, ts_init long, priority int, stream int, arrival long, kind string, side string, price long, size long, instrument_id string, command string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = simulate(df, Config(), "all", watch).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    done = [r["status"] for r in rows if r["output"] == "orders"]
    # Even ones reduce a long position with a buy, and are refused; odd ones fill.
    assert {s: done.count(s) for s in set(done)} == {"filled": 200, "rejected": 199, "resting": 1}
    [summary] = [r for r in rows if r["output"] == "summary"]
    assert (summary["records"], summary["fills"], summary["rejected"]) == (401, 200, 199)
    assert len([r for r in rows if r["output"] == "fills"]) == 200 and len([r for r in rows if r["output"] == "equity"]) == 401


def test_takers_are_sorted_as_narrow_rows(spark):
    p = plan(entry.queries()["engine_summary"](spark, "/root/testdata/sf0.001"))
    assert 0 < p.index("Generate") < p.index("Sort")


def test_queue_fills_read_and_deal_lines_once(spark):
    p = plan(entry.queries()["engine_queue_fills"](spark, "/root/testdata/sf0.001"))
    assert p.count("Exchange") == 1 and p.count("FileScan") == 1
