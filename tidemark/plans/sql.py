"""SQL text with the extensions that Spark's parser lacks: as-of joins and rolling shorthands, rewritten before parsing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.asof import asof_join

_ASOF = re.compile(r"\b(?!FROM\b|JOIN\b)(\w+)(?:\s+(?:AS\s+)?(\w+))?\s+ASOF\s+(LEFT\s+)?JOIN\s+(\w+)(?:\s+(?:AS\s+)?(\w+))?\s+MATCH_CONDITION\s*\(\s*(\w+)\.(\w+)\s*(>=|>|<=|<)\s*(\w+)\.(\w+)\s*\)\s*ON\s+((?:\w+\.\w+\s*=\s*\w+\.\w+)(?:\s+AND\s+\w+\.\w+\s*=\s*\w+\.\w+)*)", re.IGNORECASE)
_ROLLING = re.compile(r"\brolling_(avg|sum|min|max|count)\(\s*([^,()]+)\s*,\s*([^,()]+)\s*,\s*(\d+)\s*(?:,\s*([^,()]+)\s*)?\)", re.IGNORECASE)


def rewrite_rolling(text: str) -> str:
    """rolling_avg(v, order, rows[, partition]) as a window aggregate; rows from 1 to 1,000,000."""

    def one(m: re.Match) -> str:
        f, v, order, rows, part = m.groups()
        if not 1 <= int(rows) <= 1_000_000:
            raise ValueError("rows must be from 1 to 1000000")
        by = f"PARTITION BY {part.strip()} " if part else ""
        return f"{f}({v.strip()}) OVER ({by}ORDER BY {order.strip()} ROWS BETWEEN {int(rows) - 1} PRECEDING AND CURRENT ROW)"

    return _ROLLING.sub(one, text)


def sql(spark: SparkSession, text: str, seq: str | None = None) -> DataFrame:
    """Run SQL in which `a ASOF [LEFT] JOIN b MATCH_CONDITION (a.t >= b.t) ON a.k = b.k` is a table; strict signs
    mean the same as the others. The joined table's columns are a's, then b's, those that clash with `_right`."""

    def one(m: re.Match) -> str:
        left, la, outer, right, ra, side, t, sign, _, t2, on = m.groups()
        la, ra = la or left, ra or right
        keys = [re.findall(r"(\w+)\.(\w+)", c) for c in re.split(r"\s+AND\s+", on, flags=re.IGNORECASE)]
        backward = (sign[0] == ">") == (side.lower() == la.lower())
        mine, theirs = (t, t2) if side.lower() == la.lower() else (t2, t)
        r = spark.table(right)
        by = []
        for (s, a), (_, b) in keys:
            a, b = (a, b) if s.lower() == la.lower() else (b, a)
            r = r.withColumnRenamed(b, a)
            by.append(a)
        r = r.withColumnRenamed(theirs, mine)
        out = asof_join(spark.table(left), r, mine, by, "backward" if backward else "forward", how="left" if outer else "inner", seq=seq)
        name = f"asof_{uuid.uuid4().hex}"
        out.createOrReplaceTempView(name)
        return name

    return spark.sql(rewrite_rolling(_ASOF.sub(one, text)))


#: Temporary SQL functions over collect_list(struct(x)) frames (fixed texts).
FUNCTIONS = {
    "frame_mad": "(xs ARRAY<STRUCT<x: DOUBLE>>) RETURNS DOUBLE RETURN aggregate(xs, 0D, (a, s) -> a + abs(s.x - aggregate(xs, 0D, (b, r) -> b + r.x) / size(xs))) / size(xs)",
    "frame_idxmax": "(xs ARRAY<STRUCT<x: DOUBLE>>) RETURNS DOUBLE RETURN CAST(array_position(transform(xs, s -> s.x), array_max(transform(xs, s -> s.x))) AS DOUBLE)",
    "frame_idxmin": "(xs ARRAY<STRUCT<x: DOUBLE>>) RETURNS DOUBLE RETURN CAST(array_position(transform(xs, s -> s.x), array_min(transform(xs, s -> s.x))) AS DOUBLE)",
}


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def pinned_view(df: DataFrame, name: str, **read_point) -> str:
    """A temporary view of a table at a read point, named apart for each."""
    label = "__".join([name, *[f"{k}_{re.sub(r'\\W', '_', str(v))}" for k, v in read_point.items()]])
    df.select(*[F.col(f"`{c}`") for c in df.columns]).createOrReplaceTempView(label)
    return label
