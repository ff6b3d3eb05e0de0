"""Bars, latest rows and other group-wise reductions of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.aggregates import vwap
from ..functions.time import time_bucket


def ohlcv(ticks: DataFrame, width: str, ts: str, price: str, volume: Column, by: list[str], seq: str | None = None, tz: str | None = None) -> DataFrame:
    """bucket, by, open, high, low, close, volume, vwap, n: one row a non-empty bucket and key.

    Open and close are those of the first and last row in (ts, seq); partial aggregation leaves one row
    a task, bucket and key to shuffle.
    """
    at = F.struct(*[F.col(c) for c in (ts, seq) if c])
    rows = ticks.withColumn("bucket", time_bucket(width, F.col(ts), tz=tz)).withColumn("__w", volume)
    return rows.groupBy("bucket", *by).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum("__w").alias("volume"), vwap(F.col(price), F.col("__w")).alias("vwap"), F.count(F.lit(1)).alias("n"))


def latest_on(df: DataFrame, by: str, ts: str, seq: str | None = None) -> DataFrame:
    """Each non-null key's row of the greatest time, of ties the one greatest in seq; columns as they come."""
    at = F.struct(*[F.col(c) for c in (ts, seq) if c])
    rows = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*df.columns), at).alias("__r"))
    return rows.select(*[F.col(f"__r.`{c}`").alias(c) for c in df.columns]).orderBy(by)


def bars_from_trades(trades: DataFrame, interval: int, ts: str = "ts_init", by: tuple[str, ...] = ("instrument_id", "outcome"), price: str = "price", size: str = "size", seq: str | None = None) -> DataFrame:
    """Bars at floor(ts / interval) of integer times: ts_event is a bucket's start, ts_init its end; null sizes count 0."""
    at = F.struct(*[F.col(c) for c in (ts, seq) if c])
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(interval))
    out = trades.groupBy(start.alias("ts_event"), *by).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(F.coalesce(F.col(size), F.lit(0))).alias("volume"))
    return out.select((F.col("ts_event") + interval).alias("ts_init"), "ts_event", *by, "open", "high", "low", "close", "volume")


#: The mergeable state of a rollup; a partial table of it per file can be kept and merged later.
def rollup_state(ticks: DataFrame, by: list[str], ts: str, price: str, volume: Column, seq: str) -> DataFrame:
    """One row a key: counts, sums, extremes, and first and last prices with their places in (ts, seq)."""
    at = F.struct(F.col(ts), F.col(seq))
    rows = ticks.withColumn("__w", volume)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"),
        F.max(price).alias("high"), F.min(price).alias("low"), F.sum("__w").alias("volume"), F.sum(F.col(price) * F.col("__w")).alias("turnover"))


def merge_rollups(states: DataFrame, by: list[str]) -> DataFrame:
    """The state of all of several states' rows together."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min_by("open", "first_at").alias("open"), F.max_by("close", "last_at").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def finish_rollup(state: DataFrame, by: list[str]) -> DataFrame:
    """Keys, n, first and last time, OHLC, volume and vwap of a merged state."""
    ts = state.schema["first_at"].dataType.fieldNames()[0]
    return state.select(*by, "n", F.col(f"first_at.{ts}").alias("first_ts"), F.col(f"last_at.{ts}").alias("last_ts"), "open", "high", "low", "close", "volume", (F.col("turnover") / F.nullif(F.col("volume"), F.lit(0))).alias("vwap"))
