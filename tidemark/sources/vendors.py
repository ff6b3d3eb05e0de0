"""Vendor messages (a column of JSON texts) to canonical tables, by from_json with declared schemas.

Canonical times are nanoseconds in longs: ts_init is when a record is known, ts_event when it happened.
Parsing happens within rows; a message that is no such message gives no rows, unless strict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LEVELS = "ARRAY<STRUCT<price: STRING, size: STRING>>"


def _parsed(messages: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    return messages.select("*", F.from_json("body", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("j"))


def _iso_ns(c: Column) -> Column:
    return F.unix_micros(F.to_timestamp(c)) * 1000


def _record(ts: Column, instrument: Column, outcome: Column | None = None, event: Column | None = None) -> list[Column]:
    return [ts.cast("long").alias("ts_init"), (ts if event is None else event).cast("long").alias("ts_event"), instrument.alias("instrument_id"), (F.lit(0) if outcome is None else outcome).cast("int").alias("outcome")]


def _delta(action: Column, side: Column, price: Column, size: Column, index: Column, last: Column) -> list[Column]:
    return [action.alias("action"), side.alias("side"), price.cast("double").alias("price"), size.cast("double").alias("size"), index.cast("int").alias("event_index"), last.alias("is_last")]


def _snapshot(rows: DataFrame, bids: Column, asks: Column, head: list[Column]) -> DataFrame:
    """One row a level; bids come first, and the last row ends the snapshot."""
    side = lambda levels, name: F.transform(F.coalesce(levels, F.array()), lambda x: F.struct(F.lit(name).alias("side"), x["price"].alias("price"), x["size"].alias("size")))
    levels = F.concat(side(bids, "buy"), side(asks, "sell"))
    out = rows.select(*head, levels.alias("levels")).select("*", F.posexplode("levels").alias("i", "x"))
    return out.select("ts_init", "ts_event", "instrument_id", "outcome", *_delta(F.lit("snapshot"), F.col("x.side"), F.col("x.price"), F.col("x.size"), F.col("i"), F.col("i") == F.size("levels") - 1))


# --- Kalshi -----------------------------------------------------------------------------------------------------------

def kalshi_orderbook(messages: DataFrame) -> DataFrame:
    """messages: body, ticker, received_at. No-bids at p are yes-asks at 1 - p."""
    rows = _parsed(messages, "orderbook_fp STRUCT<yes_dollars: ARRAY<ARRAY<STRING>>, no_dollars: ARRAY<ARRAY<STRING>>>").where("j.orderbook_fp is not null")
    level = lambda price, size: F.struct(price.cast("string").alias("price"), size.alias("size"))
    bids = F.transform("j.orderbook_fp.yes_dollars", lambda x: level(x[0].cast("decimal(18,9)"), x[1]))
    asks = F.transform("j.orderbook_fp.no_dollars", lambda x: level(F.lit(1).cast("decimal(18,9)") - x[0].cast("decimal(18,9)"), x[1]))
    return _snapshot(rows, bids, asks, _record(F.col("received_at"), F.col("ticker")))


def kalshi_trades(messages: DataFrame) -> DataFrame:
    rows = _parsed(messages, "trades ARRAY<STRUCT<ticker: STRING, created_time: STRING, yes_price_dollars: STRING, count_fp: STRING, taker_outcome_side: STRING, taker_side: STRING, trade_id: STRING>>").select(F.explode("j.trades").alias("t"))
    taker = F.coalesce("t.taker_outcome_side", "t.taker_side")
    side = F.when(taker == "yes", "buy").when(taker == "no", "sell").when(taker.isNotNull(), F.raise_error(F.concat(F.lit("unknown taker side "), taker)).cast("string"))
    return rows.select(*_record(_iso_ns(F.col("t.created_time")), F.col("t.ticker")), F.col("t.yes_price_dollars").cast("double").alias("price"), F.col("t.count_fp").cast("double").alias("size"), side.alias("aggressor"), F.col("t.trade_id").alias("trade_id"))


def kalshi_candles(messages: DataFrame, minutes: int) -> DataFrame:
    """messages: body, ticker. Candles without prices are synthetic and left out; a bar is known at its end."""
    if minutes not in (1, 60, 1440):
        raise ValueError("minutes are 1, 60 or 1440")
    rows = _parsed(messages, "candlesticks ARRAY<STRUCT<end_period_ts: BIGINT, volume_fp: STRING, price: STRUCT<open_dollars: STRING, high_dollars: STRING, low_dollars: STRING, close_dollars: STRING>>>").select("ticker", F.explode("j.candlesticks").alias("c"))
    p = [F.col(f"c.price.{k}_dollars").cast("double").alias(k) for k in ("open", "high", "low", "close")]
    end = F.col("c.end_period_ts") * 1_000_000_000
    out = rows.select(*_record(end, F.col("ticker"), None, end - minutes * 60 * 1_000_000_000), *p, F.coalesce(F.col("c.volume_fp").cast("double"), F.lit(0.0)).alias("volume"))
    return out.where("open is not null and high is not null and low is not null and close is not null")


def kalshi_markets(messages: DataFrame) -> DataFrame:
    """instrument_id, venue, tick and lot size, expiration and settlement times, the winner (0 yes, 1 no) if resolved; binary markets only."""
    fields = "ticker: STRING, market_type: STRING, fractional_trading_enabled: BOOLEAN, expiration_time: STRING, settlement_ts: STRING, result: STRING"
    rows = _parsed(messages, f"market STRUCT<{fields}>").where("j.market is not null and coalesce(j.market.market_type, 'binary') = 'binary'")
    m = lambda k: F.col(f"j.market.{k}")
    return rows.select(m("ticker").alias("instrument_id"), F.lit("kalshi").alias("venue"), F.when(m("fractional_trading_enabled"), 0.01).otherwise(1.0).alias("lot_size"), _iso_ns(m("expiration_time")).alias("expiration_ns"), _iso_ns(m("settlement_ts")).alias("settlement_observable_ns"), F.when(m("result") == "yes", 0).when(m("result") == "no", 1).alias("winner"))


# --- Polymarket -------------------------------------------------------------------------------------------------------

def _polymarket(messages: DataFrame, schema: str, tokens: DataFrame) -> DataFrame:
    """Messages with the instrument and outcome of their token; tokens: asset_id, instrument_id, outcome."""
    rows = _parsed(messages, schema).withColumn("asset_id", F.col("j.asset_id"))
    return rows.join(tokens, "asset_id").withColumn("at", F.col("j.timestamp").cast("long") * 1_000_000)


def polymarket_books(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    rows = _polymarket(messages, f"asset_id STRING, timestamp STRING, bids {_LEVELS}, asks {_LEVELS}", tokens)
    return _snapshot(rows, F.col("j.bids"), F.col("j.asks"), _record(F.col("at"), F.col("instrument_id"), F.col("outcome")))


def polymarket_changes(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """A change to size 0 is a delete."""
    rows = _polymarket(messages, "asset_id STRING, timestamp STRING, changes ARRAY<STRUCT<side: STRING, price: STRING, size: STRING>>", tokens)
    rows = rows.select("*", F.posexplode("j.changes").alias("i", "x"))
    action = F.when(F.col("x.size").cast("double") == 0, "delete").otherwise("set")
    return rows.select(*_record(F.col("at"), F.col("instrument_id"), F.col("outcome")), *_delta(action, F.lower("x.side"), F.col("x.price"), F.col("x.size"), F.col("i"), F.col("i") == F.size("j.changes") - 1))


def polymarket_trades(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """An absent side stays unknown."""
    rows = _polymarket(messages, "asset_id STRING, timestamp STRING, price STRING, size STRING, side STRING", tokens)
    return rows.select(*_record(F.col("at"), F.col("instrument_id"), F.col("outcome")), F.col("j.price").cast("double").alias("price"), F.col("j.size").cast("double").alias("size"), F.lower("j.side").alias("aggressor"))


def polymarket_tokens(markets: DataFrame) -> DataFrame:
    """asset_id, instrument_id, outcome, outcome_label, tick_size, neg_risk; markets need two outcomes or more."""
    rows = _parsed(markets, "condition_id STRING, minimum_tick_size STRING, neg_risk BOOLEAN, negRisk BOOLEAN, tokens ARRAY<STRUCT<outcome: STRING, token_id: STRING>>").where("size(j.tokens) >= 2")
    rows = rows.select("j", F.posexplode("j.tokens").alias("i", "t"))
    neg = F.coalesce("j.neg_risk", F.lit(False)) | F.coalesce("j.negRisk", F.lit(False))
    return rows.select(F.col("t.token_id").alias("asset_id"), F.col("j.condition_id").alias("instrument_id"), F.col("i").alias("outcome"), F.col("t.outcome").alias("outcome_label"), F.col("j.minimum_tick_size").cast("double").alias("tick_size"), neg.alias("neg_risk"))


# --- Hyperliquid ------------------------------------------------------------------------------------------------------

def hyperliquid_candles(messages: DataFrame) -> DataFrame:
    """messages: body, instrument_id; a bar is known at its close."""
    # The keys t and T differ in case only, so that a map holds them, not a struct.
    rows = _parsed(messages, "ARRAY<MAP<STRING, STRING>>")
    x = rows.select("instrument_id", F.explode("j").alias("x"))
    n = lambda k: F.try_element_at("x", F.lit(k))
    return x.select(*_record(n("T").cast("long") * 1_000_000, F.col("instrument_id"), None, n("t").cast("long") * 1_000_000), *[n(k).cast("double").alias(name) for k, name in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])


def hyperliquid_funding(messages: DataFrame) -> DataFrame:
    rows = _parsed(messages, "ARRAY<STRUCT<time: BIGINT, fundingRate: STRING>>").select("instrument_id", F.explode("j").alias("x"))
    return rows.select(*_record(F.col("x.time") * 1_000_000, F.col("instrument_id")), F.col("x.fundingRate").cast("double").alias("rate"))


def hyperliquid_books(messages: DataFrame) -> DataFrame:
    rows = _parsed(messages, "coin STRING, time BIGINT, levels ARRAY<ARRAY<STRUCT<px: STRING, sz: STRING>>>").where("size(j.levels) = 2")
    side = lambda i: F.transform(F.get("j.levels", F.lit(i)), lambda x: F.struct(x["px"].alias("price"), x["sz"].alias("size")))
    return _snapshot(rows, side(0), side(1), _record(F.col("j.time") * 1_000_000, F.col("instrument_id")))


# --- files ------------------------------------------------------------------------------------------------------------

def infer_unit(times: DataFrame, ts: str) -> int:
    """Nanoseconds in one unit of integer times, by their size: seconds, milliseconds, microseconds or nanoseconds."""
    top = times.agg(F.max(F.abs(F.col(ts).cast("long"))).alias("m")).first()["m"] or 0
    return 1_000_000_000 if top < 10**11 else 1_000_000 if top < 10**14 else 1_000 if top < 10**17 else 1


def ohlcv_csv(df: DataFrame, ts: str, instrument: Column, width_ns: int, names: dict[str, str] | None = None) -> DataFrame:
    """Bars from a CSV's strings: times are ISO or integers of an inferred unit, and mark a bar's start."""
    names = {k: k for k in ("open", "high", "low", "close", "volume")} | (names or {})
    numeric = df.where(~F.col(ts).rlike(r"^\s*-?\d+\s*$")).isEmpty()
    at = F.col(ts).cast("long") * infer_unit(df, ts) if numeric else _iso_ns(F.col(ts))
    return df.select(*_record(at + width_ns, instrument, None, at), *[F.col(c).cast("double").alias(k) for k, c in names.items()])


def trades_csv(df: DataFrame, ts: str, instrument: Column, price: str = "price", size: str = "size", side: str | None = None) -> DataFrame:
    numeric = df.where(~F.col(ts).rlike(r"^\s*-?\d+\s*$")).isEmpty()
    at = F.col(ts).cast("long") * infer_unit(df, ts) if numeric else _iso_ns(F.col(ts))
    return df.select(*_record(at, instrument), F.col(price).cast("double").alias("price"), F.col(size).cast("double").alias("size"), (F.lower(side) if side else F.lit(None).cast("string")).alias("aggressor"))


def compare_to_ledger(fills: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("order_id",)) -> DataFrame:
    """keys, quantity and price differences of simulated fills against a ledger's; either side may lack an order."""
    per = lambda df, p: df.groupBy(*keys).agg(F.sum("quantity").alias(f"{p}_quantity"), (F.sum(F.col("quantity") * F.col("price")) / F.nullif(F.sum("quantity"), F.lit(0))).alias(f"{p}_price"))
    both = per(fills, "sim").join(per(ledger, "real"), list(keys), "full")
    return both.withColumns({"quantity_delta": F.coalesce("sim_quantity", F.lit(0)) - F.coalesce("real_quantity", F.lit(0)), "price_delta": F.col("sim_price") - F.col("real_price")})
