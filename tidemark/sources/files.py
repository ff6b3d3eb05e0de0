"""File inputs by extension, aligned to a declared schema, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, CSV (with a header), JSON lines, ORC, or Arrow IPC streams and files, by extension.

    CSV and JSON take a schema rather than guess one; a CSV's header decides the order.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("arrow", "arrows", "ipc", "feather"):
        return _read_arrow(spark, path)
    if kind in ("json", "jsonl", "ndjson"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
        return align(raw, schema) if schema else raw
    return spark.read.orc(path) if kind == "orc" else (spark.read.schema(schema) if schema else spark.read).parquet(path)


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns by exact name, else by the only one that differs in case; in the schema's order and types."""
    out = []
    for f in schema.fields:
        exact = [c for c in df.columns if c == f.name] or [c for c in df.columns if c.lower() == f.name.lower()]
        if len(exact) != 1:
            raise ValueError(f"no one column for {f.name}")
        out.append(F.col(f"`{exact[0]}`").cast(f.dataType).alias(f.name))
    return df.select(*out)


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Files are read as bytes by Spark, and their batches decoded in the tasks."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("content")

    def reader(content: bytes):
        return pa.ipc.open_file(content) if content[:6] == b"ARROW1" else pa.ipc.open_stream(content)

    first = files.limit(1).collect()
    if not first:
        raise ValueError(f"nothing at {path}")
    arrow_schema = reader(bytes(first[0]["content"])).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                r = reader(content.as_py())
                yield from ((r.get_batch(i) for i in range(r.num_record_batches)) if hasattr(r, "num_record_batches") else r)

    return files.mapInArrow(run, from_arrow_schema(arrow_schema))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """parquet, orc, csv (with header) or json (nulls written)."""
    w = df.write.mode(mode)
    if kind == "csv":
        w.option("header", True).csv(path)
    elif kind == "json":
        w.option("ignoreNullFields", "false").json(path)
    elif kind in ("parquet", "orc"):
        w.format(kind).save(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def rows(df: DataFrame, max_bytes: int | None = None):
    """Rows one after another; with max_bytes, up to the batch in which their JSON passes that size, and whether all came."""
    size, out = 0, []
    for r in df.toLocalIterator(prefetchPartitions=True):
        out.append(r)
        size += len(str(r.asDict()))
        if max_bytes is not None and size > max_bytes:
            return out, False
    return out, True
