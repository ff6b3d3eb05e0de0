"""As-of joins: for each left row the nearest right row in time, within equal keys.

Both sides are put into one sequence per key and time slice, and the last right row so far is carried
along by a window: one shuffle, and no pairs are formed. With `slice`, a key's rows are dealt into slices of
time, so that a hot key, or no key at all, is many tasks' work; what each slice inherits from
those before comes from one row per key and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import parse_width, to_micros


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, direction: str = "backward", tolerance: str | int | None = None, how: str = "left", seq: str | None = None, slice: str | None = "30d", suffix: str = "_right") -> DataFrame:
    """All left columns, then right's without `by`; names that clash get the suffix.

    backward: the last right row at or before the left time, of equal times the one greatest in seq; forward: the
    first at or after, of equal times the least in seq. tolerance (a width, or raw units): the nearest row is
    dropped if it is farther. Null keys match null keys; null times match nothing. how: left or inner.
    """
    by = by or []
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError("direction is backward or forward, how is left or inner")
    if left.schema[on].dataType != right.schema[on].dataType:
        raise TypeError("the time columns must have the same type")
    temporal = left.schema[on].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    number = lambda c: to_micros(c) if temporal else c.cast("long")
    payload = [c for c in right.columns if c not in by]
    names = {c: c + suffix if c in left.columns else c for c in payload}
    sign = 1 if direction == "backward" else -1
    t = number(F.col(on)) * sign
    order = F.col(seq).cast("long") * sign if seq and seq in right.columns else F.lit(0).cast("long")
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    lefts = left.select(*keys, t.alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__seq"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*payload).alias("x")).schema["x"].dataType).alias("__r"))
    rights = right.where(F.col(on).isNotNull()).select(*keys, t.alias("__t"), F.lit(0).alias("__side"), order.alias("__seq"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("__l"), F.struct(*payload).alias("__r"))
    both = lefts.unionByName(rights)
    group = [f"__k{i}" for i in range(len(by))]
    if slice is not None:
        # Integer times have no unit: slices of them are asked for as a number.
        width = parse_width(slice).micros if temporal else int(slice) if str(slice).isdigit() else None
        slice = None if width is None else slice
    if slice is not None:
        both = both.withColumn("__slice", F.floor(F.col("__t") / F.lit(width)))
    sliced = group + (["__slice"] if slice is not None else [])
    w = Window.partitionBy(*sliced).orderBy("__t", "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if slice is not None:
        # The last right row of each key and slice, then the last one of all slices before.
        edge = rights.withColumn("__slice", F.floor(F.col("__t") / F.lit(width))).groupBy(*sliced).agg(F.max_by("__r", F.struct("__t", "__seq")).alias("__e"))
        slots = edge.unionByName(lefts.select(*group, F.floor(F.col("__t") / F.lit(width)).alias("__slice")).distinct().withColumn("__e", F.lit(None).cast(edge.schema["__e"].dataType)))
        slots = slots.groupBy(*sliced).agg(F.first("__e", ignorenulls=True).alias("__e"))
        before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = slots.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).select(*[F.col(k).alias(k + "r") for k in sliced], "__c")
        same: Column = F.lit(True)
        for k in sliced:
            same = same & F.col(k).eqNullSafe(F.col(k + "r"))
        found = found.join(carried, same, "left").withColumn("__m", F.coalesce("__m", "__c"))
    match = F.when(F.col("__t").isNotNull(), F.col("__m"))
    if tolerance is not None:
        limit = parse_width(tolerance).micros if isinstance(tolerance, str) else int(tolerance)
        match = F.when(F.col("__t") - number(F.col(f"__m.`{on}`")) * sign <= limit, match)
    found = found.withColumn("__m", match)
    if how == "inner":
        found = found.where(F.col("__m").isNotNull())
    return found.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(n) for c, n in names.items()])
