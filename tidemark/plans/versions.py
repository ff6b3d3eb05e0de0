"""Queries over versioned tables: orders committed year by year."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..session import scratch
from ..sources.catalog import Catalog, CatalogError, arrival_delta as delta_, arrival_report as report_, violations
from .registry import Tables, query

_CUTS = (datetime(1996, 1, 1), datetime(1997, 1, 1))
_V1 = "o_orderdate < TIMESTAMP '1996-01-01'"
_V2 = "o_orderdate < TIMESTAMP '1997-01-01'"
_COLS = "o_orderkey, o_totalprice, o_orderdate"


def _catalog(t: Tables) -> Catalog:
    """Version 1: orders before 1996; 2: those of 1996 too; 3: all. Committed at 1000, 2000 and 3000."""
    ticks = iter(range(1000, 100_000, 1000))
    c = Catalog(t.spark, f"{scratch(t.spark)}/catalog-{uuid.uuid4().hex}", clock=lambda: next(ticks))
    orders, d = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), F.col("o_orderdate")
    c.create("orders", orders.schema, time="o_orderdate")
    c.write("orders", orders.where(d < F.lit(_CUTS[0])))
    c.append("orders", orders.where((d >= F.lit(_CUTS[0])) & (d < F.lit(_CUTS[1]))))
    c.append("orders", orders.where(d >= F.lit(_CUTS[1])))
    return c


@query(f"SELECT {_COLS} FROM orders WHERE {_V2}")
def time_travel_version(t: Tables):
    return _catalog(t).table("orders", version=2)


@query(f"SELECT {_COLS} FROM orders WHERE {_V1}")
def time_travel_asof(t: Tables):
    return _catalog(t).table("orders", as_of=1999)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
def range_scan(t: Tables):
    return _catalog(t).scan("orders", ["o_orderkey"], datetime(1996, 3, 1), datetime(1996, 4, 1))


@query(f"SELECT {_COLS} FROM orders WHERE NOT ({_V1})")
def incremental_diff(t: Tables):
    return _catalog(t).diff("orders", 1, 3)


@query(f"SELECT {_COLS} FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'")
def embargo_scan(t: Tables):
    return _catalog(t).pinned(as_of=2500, cutoff=datetime(1996, 6, 30)).table("orders")


@query(f"SELECT {_COLS} FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01' OR o_orderdate >= TIMESTAMP '1996-05-01' UNION ALL SELECT o_orderkey, 0.0, TIMESTAMP '1996-02-15' FROM orders WHERE o_orderkey <= 50")
def replace_range(t: Tables):
    c = _catalog(t)
    new = t.orders.where("o_orderkey <= 50").select("o_orderkey", F.lit(0.0).alias("o_totalprice"), F.lit(datetime(1996, 2, 15)).cast("timestamp_ntz").alias("o_orderdate"))
    c.replace_range("orders", datetime(1996, 2, 1), datetime(1996, 5, 1), new)
    return c.table("orders")


@query("SELECT 'a' AS __fork, o_orderkey FROM orders UNION ALL SELECT 'b', o_orderkey FROM orders UNION ALL SELECT 'b', -o_orderkey FROM orders WHERE o_orderkey <= 20")
def fork_union(t: Tables):
    c = _catalog(t)
    c.fork("a", ["orders"])
    c.fork("b", ["orders"])
    extra = t.orders.where("o_orderkey <= 20").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz").alias("o_orderdate"))
    c.fork_append("b", "orders", extra)
    return c.union_forks("orders").select("__fork", "o_orderkey")


@query("SELECT 'known_status' AS rule, count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) AS n FROM orders UNION ALL SELECT 'dear', count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) FROM orders")
def data_policy_violations(t: Tables):
    return violations(t.orders, {"known_status": {"kind": "in_set", "column": "o_orderstatus", "values": ["F", "O"]}, "dear": {"kind": "compare", "column": "o_totalprice", "op": ">", "value": 1000}})


@query(f"SELECT 'n' AS \"column\", count(*) FILTER (a.n IS DISTINCT FROM b.n) AS mismatches, max(abs(a.n - b.n))::DOUBLE AS max_abs_delta FROM (SELECT year(o_orderdate) // 2 AS y, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT year(o_orderdate) // 2 AS y, count(*) AS n FROM orders WHERE {_V2} GROUP BY 1) b USING (y)")
def arrival_delta(t: Tables):
    c = _catalog(t)
    by_years = lambda df: df.groupBy(F.floor(F.year("o_orderdate") / 2).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return delta_(by_years(c.table("orders")), by_years(c.table("orders", version=2)), ["y"])


@query(f"SELECT o_orderkey FROM orders WHERE {_V2} AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_V1})")
def version_diff_join(t: Tables):
    c = _catalog(t)
    return c.table("orders", version=2).join(c.table("orders", version=1), "o_orderkey", "left_anti").select("o_orderkey")


@query(f"SELECT {_COLS} FROM orders WHERE {_V1}")
def restore(t: Tables):
    c = _catalog(t)
    c.restore("orders", 1)
    return c.table("orders")


@query(f"SELECT {_COLS}, CASE WHEN NOT ({_V2}) THEN o_orderpriority END AS o_orderpriority FROM orders")
def evolve(t: Tables):
    """A column that comes with the third version is null in rows of the first two."""
    c = _catalog(t)
    c.restore("orders", 2)
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c.evolve("orders", orders.schema)
    c.append("orders", orders.where(F.col("o_orderdate") >= F.lit(_CUTS[1])))
    return c.table("orders")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01' OR o_orderdate >= TIMESTAMP '1996-05-01'")
def plan_apply(t: Tables):
    """A staged deletion of a range changes nothing until it is applied."""
    c = _catalog(t)
    c.apply(c.plan("orders", datetime(1996, 2, 1), datetime(1996, 5, 1), None, ttl_s=10**6)["id"])
    return c.table("orders").select("o_orderkey")


@query(f"SELECT 'orders' AS tab, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'late', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE NOT ({_V2})")
def transaction(t: Tables):
    """An append to one table and a write of another, published together."""
    c = _catalog(t)
    c.restore("orders", 2)
    late = c.table("orders", version=3).where(F.col("o_orderdate") >= F.lit(_CUTS[1]))
    c.create("late", late.schema, time="o_orderdate")
    c.transaction({"orders": ("append", late), "late": ("write", late)})
    per = lambda name: c.table(name).agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return per("orders").unionByName(per("late"))


@query(f"SELECT 2::BIGINT AS version, count(*) AS n FROM orders WHERE {_V2} UNION ALL SELECT 3, count(*) FROM orders")
def retention(t: Tables):
    """The versions that are left when the last two are kept, with their rows."""
    c = _catalog(t)
    c.retain("orders", keep_last=2)
    out = None
    for v in (1, 2, 3):
        try:
            one = c.table("orders", version=v).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("n"))
        except CatalogError:
            continue
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT {_COLS} FROM orders")
def idempotent_append(t: Tables):
    """A repeated append with the same key adds nothing; compacting changes no row."""
    c = _catalog(t)
    c.restore("orders", 2)
    late = c.table("orders", version=3).where(F.col("o_orderdate") >= F.lit(_CUTS[1]))
    for _ in range(2):
        c.append("orders", late, key="late")
    c.compact("orders")
    return c.table("orders")


@query(f"SELECT {_COLS} FROM orders WHERE {_V2}")
def snapshot_read(t: Tables):
    """A snapshot keeps its read point when the table goes on."""
    c = _catalog(t)
    c.restore("orders", 2)
    c.snapshot("then", ["orders"])
    c.append("orders", c.table("orders", version=3).where(F.col("o_orderdate") >= F.lit(_CUTS[1])))
    return c.table("orders", snapshot="then")


@query("SELECT event_id, user_id, value FROM events")
def file_round_trip(t: Tables):
    """CSV written, its kind told by its name, read back."""
    folder = f"{scratch(t.spark)}/files-{uuid.uuid4().hex}/events.csv"
    t.events.select("event_id", "user_id", "value").write.option("header", True).csv(folder)
    return t.spark.read.option("header", True).schema("event_id long, user_id long, value double").csv(folder)


@query(f"""SELECT a.n AS head_rows, b.n AS asof_rows, a.n <> b.n AS row_count_differs, true AS changed, false AS vacuous FROM (SELECT count(DISTINCT year(o_orderdate)) AS n FROM orders) a, (SELECT count(DISTINCT year(o_orderdate)) AS n FROM orders WHERE {_V2}) b
    UNION ALL SELECT count(DISTINCT year(o_orderdate)), count(DISTINCT year(o_orderdate)), false, false, true FROM orders""")
def arrival_report(t: Tables):
    """Head against version 2, which lacks one commit, and against itself."""
    c = _catalog(t)
    by_year = lambda v: c.table("orders", version=v).groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return report_(by_year(3), by_year(2), ["y"], 1).unionByName(report_(by_year(3), by_year(3), ["y"], 0))
