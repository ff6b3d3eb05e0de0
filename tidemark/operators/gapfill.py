"""Regular grids over irregular series: point sampling with null, previous, linear or constant fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.time import from_micros, parse_width, to_micros

_MODES = {"null": "null", "locf": "prev", "prev": "prev", "linear": "linear", "interpolate": "linear", "value": "value"}


def gapfill(df: DataFrame, ts: str, step: str | int, mode: str = "null", value=None, seq: str | None = None, by: list[str] | None = None, max_rows: int = 1_000_000) -> DataFrame:
    """Rows at min(ts) + n * step up to max(ts); of rows at one time the last in seq counts.

    Rows off the grid are not in the result, but neighbours of it in the fills. linear rounds
    integers and takes the previous value for anything else; value fills numeric columns. A grid of
    over max_rows for one series is an error. `by`: a grid for each key (the series' own keys).
    """
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {sorted(_MODES)}")
    mode, by = _MODES[mode], by or []
    temporal = df.schema[ts].dataType.typeName() in ("timestamp", "timestamp_ntz")
    width = parse_width(step).micros if isinstance(step, str) else int(step)
    u = to_micros(F.col(ts)) if temporal else F.col(ts).cast("long")
    cols = [f for f in df.schema.fields if f.name not in (ts, *by)]
    order = F.col(seq) if seq else F.lit(0)
    rows = df.where(F.col(ts).isNotNull()).groupBy(*by, u.alias("__u")).agg(F.max_by(F.struct(*[F.col(f"`{f.name}`") for f in cols]), order).alias("__v"))
    span = rows.groupBy(*by).agg(F.min("__u").alias("__lo"), F.max("__u").alias("__hi"))
    n = F.floor((F.col("__hi") - F.col("__lo")) / F.lit(width)) + 1
    checked = F.when(n <= max_rows, F.sequence("__lo", "__hi", F.lit(width).cast("long"))).otherwise(F.raise_error(F.lit(f"the grid has over {max_rows} rows")).cast("array<bigint>"))
    grid = span.where(F.col("__lo").isNotNull()).select(*by, F.explode(checked).alias("__u"))
    marked = rows.withColumn("__grid", F.lit(False)).unionByName(grid.select(*by, "__u", F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"), F.lit(True).alias("__grid")))
    both = marked.groupBy(*by, "__u").agg(F.first("__v", ignorenulls=True).alias("__v"), F.max("__grid").alias("__grid"))
    before = Window.partitionBy(*by).orderBy("__u").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy("__u").rowsBetween(0, Window.unboundedFollowing)
    out = []
    for f in cols:
        x = F.col(f"__v.`{f.name}`")
        numeric = isinstance(f.dataType, T.NumericType)
        if mode == "null":
            filled = x
        elif mode == "value":
            filled = F.coalesce(x, F.when(F.col("__v").isNull(), F.lit(value).cast(f.dataType))) if numeric else x
        else:
            known = F.when(x.isNotNull(), F.struct(F.col("__u").alias("u"), x.alias("x")))
            lo = F.last(known, ignorenulls=True).over(before)
            filled = lo["x"]
            if mode == "linear" and numeric:
                hi = F.first(known, ignorenulls=True).over(after)
                share = (F.col("__u") - lo["u"]) / F.nullif(hi["u"] - lo["u"], F.lit(0))
                between = lo["x"] + (hi["x"] - lo["x"]) * share
                if isinstance(f.dataType, T.IntegralType):
                    between = F.round(between)
                filled = F.coalesce(x, between.cast(f.dataType))
        out.append(filled.alias(f.name))
    time = from_micros(F.col("__u")).cast(df.schema[ts].dataType) if temporal else F.col("__u").cast(df.schema[ts].dataType)
    whole = {f.name: c for f, c in zip(cols, out, strict=True)}
    return both.select("__grid", *[F.col(k) if k in by else time.alias(ts) if k == ts else whole[k] for k in df.columns]).where("__grid").drop("__grid")


resample = gapfill
