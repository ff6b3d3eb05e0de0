"""The rows that versions append, as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Catalog, CatalogError


def tail(catalog: Catalog, name: str, after: int = 0, poll_s: float = 0.25, until: Callable[[], bool] = lambda: False) -> Iterator[tuple[int, DataFrame]]:
    """(version, its new rows) for each append after a version, as they come; any other change ends the stream with an error."""
    at = after
    while True:
        for v in [v for v in catalog.versions(name) if v > at]:
            op = catalog._manifest(name, v).op
            if op == "compact":
                at = v
                continue
            if op not in ("append", "evolve") and not (op == "write" and v == 1):
                raise CatalogError(f"version {v} is a {op}: only appends can be followed")
            yield v, catalog.diff(name, v - 1, v) if op != "evolve" else catalog.table(name, version=v).limit(0)
            at = v
        if until():
            return
        time.sleep(max(poll_s, 0.01))


def wait_for_version(catalog: Catalog, name: str, after: int, timeout_s: float = 30, poll_s: float = 0.25) -> int:
    """The head's number once it is greater than `after`."""
    end = time.monotonic() + timeout_s
    while time.monotonic() < end:
        if (found := catalog.versions(name)) and found[-1] > after:
            return found[-1]
        time.sleep(max(poll_s, 0.01))
    raise TimeoutError(f"{name} got no version after {after}")


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """An append-only folder of Parquet files as a streaming DataFrame."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def rollup_stream(ticks: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Count and value sums in tumbling windows; rows later than the watermark are dropped."""
    from pyspark.sql import functions as F

    return ticks.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).select(F.col("w.start").alias("start"), *keys, "n", "s")


def append_to(catalog: Catalog, name: str, source: DataFrame, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch as a version; the batch's number is the idempotency key, so that a replay changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        catalog.append(name, batch, key=f"{checkpoint}/{epoch}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
