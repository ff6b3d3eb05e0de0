"""Exponentially weighted moving averages of ordered series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def ewma(df: DataFrame, name: str, x: str, alpha: float, partition_by: list[str], order_by: list[str]) -> DataFrame:
    """df with y = alpha * x + (1 - alpha) * y along each partition's order; y starts at the first
    non-null x, and a null x carries y on. NaN is a value, and stays.

    A series is a recursion: it is one task's work, streamed in order; series run in parallel.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    place = [df.columns.index(c) for c in partition_by]

    def run(batches):
        key, y = None, None
        for pdf in batches:
            out = []
            keys = list(zip(*[pdf.iloc[:, i] for i in place], strict=True)) if place else [()] * len(pdf)
            for k, v, missing in zip(keys, pdf[x], pdf[x + "__null"], strict=True):
                if k != key:
                    key, y = k, None
                if not missing:
                    y = float(v) if y is None else alpha * float(v) + (1 - alpha) * y
                out.append(y)
            pdf[name] = pd.Series(out, dtype="object")
            yield pdf[[f.name for f in schema]]

    rows = df.withColumn(x + "__null", F.col(x).isNull())
    dealt = rows.repartition(*partition_by) if partition_by else rows.repartition(1)
    return dealt.sortWithinPartitions(*partition_by, *order_by).mapInPandas(run, schema)
