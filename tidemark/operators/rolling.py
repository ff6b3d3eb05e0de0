"""Rolling sums over durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.time import parse_width
from ..functions.values import clean


def rolling_duration(df: DataFrame, x: str, ts: str, duration: str, partition_by: list[str], total: str = "total", count: str = "count", rows: str = "rows") -> DataFrame:
    """df with the sum and number of x, null and NaN left out, and the number of rows, over each key's rows from `duration` before ts up to ts, peers included.

    Time is cut into slices as wide as the frame, so that a frame is the end of one slice and the start of the next:
    each row asks the slice before for its sum from ts - duration on, and adds its own slice's sum up to ts. Both are running
    sums, so work is linear in the rows whatever a frame holds, nothing is subtracted, and a key's slices run in parallel.
    Rows without a time are each other's frame.
    """
    width = parse_width(duration)
    if width.months:
        raise ValueError("a rolling duration must have a fixed width")
    wide = F.lit(width.micros)
    at = F.col("__at")
    own = df.withColumns({"__at": F.unix_micros(F.col(ts).cast("timestamp")), "__own": clean(F.col(x))}).withColumn("__slice", at - F.pmod(at, wide))
    given = own.where(at.isNotNull()).select(*partition_by, "__slice", "__at", F.col("__own").alias("__x"), F.lit(1).alias("__given"))
    asks = own.withColumns({"__slice": F.col("__slice") - wide, "__at": at - wide, "__x": F.lit(None).cast(own.schema["__own"].dataType), "__given": F.lit(None).cast("int")})
    both = asks.withColumn("__asks", F.lit(True)).unionByName(given, allowMissingColumns=True)

    def running(order: Column) -> WindowSpec:
        return Window.partitionBy(*partition_by, "__slice").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    w = running(at.desc())
    told = both.withColumns({"__sum": F.sum("__x").over(w), "__n": F.count("__x").over(w), "__rows": F.count("__given").over(w)}).where("__asks").withColumn("__slice", F.col("__slice") + wide)
    w = running(at)
    out = told.withColumns({"__sum_own": F.sum("__own").over(w), "__n_own": F.count("__own").over(w), "__rows_own": F.count(F.lit(1)).over(w)})
    whole = F.coalesce(F.col("__sum") + F.col("__sum_own"), "__sum", "__sum_own")
    return out.select(*df.columns, whole.alias(total), (F.col("__n") + F.col("__n_own")).alias(count), (F.col("__rows") + F.col("__rows_own")).alias(rows))
