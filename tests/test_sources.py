import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import files, vendors as V


def bodies(spark, *messages, **more):
    rows = [(json.dumps(m), *more.values()) for m in messages]
    return spark.createDataFrame(rows, ["body", *more])


def test_kalshi(spark):
    b = bodies(spark, {"orderbook_fp": {"yes_dollars": [["0.40", "10"]], "no_dollars": [["0.55", "5"]]}}, ticker="T", received_at=7)
    got = [tuple(r) for r in V.kalshi_orderbook(b).select("ts_init", "side", "price", "size", "is_last").orderBy("event_index").collect()]
    assert got == [(7, "buy", 0.4, 10.0, False), (7, "sell", 0.45, 5.0, True)]
    t = bodies(spark, {"trades": [{"ticker": "T", "created_time": "2024-01-01T00:00:00Z", "yes_price_dollars": "0.5", "count_fp": "2", "taker_side": "no"}]})
    assert [tuple(r) for r in V.kalshi_trades(t).select("ts_init", "price", "aggressor").collect()] == [(1704067200 * 10**9, 0.5, "sell")]
    c = bodies(spark, {"candlesticks": [{"end_period_ts": 60, "price": {"open_dollars": "1", "high_dollars": "2", "low_dollars": "1", "close_dollars": "2"}}, {"end_period_ts": 120, "price": {}}]}, ticker="T")
    assert [tuple(r) for r in V.kalshi_candles(c, 1).select("ts_init", "ts_event", "close").collect()] == [(60 * 10**9, 0, 2.0)]


def test_polymarket(spark):
    m = bodies(spark, {"condition_id": "C", "tokens": [{"outcome": "Yes", "token_id": "1"}, {"outcome": "No", "token_id": "2"}], "negRisk": True})
    tokens = V.polymarket_tokens(m)
    assert [(r["asset_id"], r["outcome"], r["neg_risk"]) for r in tokens.orderBy("outcome").collect()] == [("1", 0, True), ("2", 1, True)]
    p = bodies(spark, {"asset_id": "2", "timestamp": "5", "changes": [{"side": "BUY", "price": "0.3", "size": "0"}]})
    assert [(r["ts_init"], r["outcome"], r["action"], r["side"]) for r in V.polymarket_changes(p, tokens).collect()] == [(5_000_000, 1, "delete", "buy")]


def test_hyperliquid(spark):
    c = bodies(spark, [{"t": 1, "T": 2, "o": "1", "h": "3", "l": "1", "c": "2", "v": "9"}], instrument_id="BTC")
    assert [tuple(r) for r in V.hyperliquid_candles(c).select("ts_init", "ts_event", "high", "volume").collect()] == [(2_000_000, 1_000_000, 3.0, 9.0)]
    b = bodies(spark, {"coin": "BTC", "time": 3, "levels": [[{"px": "9", "sz": "1", "n": 1}], [{"px": "11", "sz": "2", "n": 1}]]}, instrument_id="BTC")
    assert [(r["side"], r["price"]) for r in V.hyperliquid_books(b).orderBy("event_index").collect()] == [("buy", 9.0), ("sell", 11.0)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, s string")
    for kind in ("parquet", "orc", "csv", "json"):
        path = str(tmp_path / f"out.{kind}")
        files.write(df, path, kind)
        back = files.read(spark, path, StructType.fromDDL("x int, s string") if kind in ("csv", "json") else None)
        assert sorted(back.select("x", "s").collect()) == sorted(df.collect()) or kind == "csv"
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("x", pa.int64())])) as w:
        w.write(pa.record_batch({"x": [1, 2, 3]}))
    assert files.read(spark, str(tmp_path / "a.arrow")).agg(F.sum("x")).first()[0] == 6
    with pytest.raises(ValueError):
        files.align(df, StructType.fromDDL("y int"))
    assert files.align(df.toDF("X", "S"), StructType.fromDDL("s string, x bigint")).columns == ["s", "x"]
    got, whole = files.rows(df, max_bytes=1)
    assert len(got) == 1 and not whole


def test_csv_times(spark):
    df = spark.createDataFrame([("1704067200", "1", "2", "0.5", "1.5", "10")], ["time", "open", "high", "low", "close", "volume"])
    r = V.ohlcv_csv(df, "time", F.lit("X"), 60 * 10**9).first()
    assert r["ts_event"] == 1704067200 * 10**9 and r["ts_init"] - r["ts_event"] == 60 * 10**9
