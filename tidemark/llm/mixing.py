"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the budget by weight, at most `most` times its
size; the excess is shared again by weight. Every document of the source then gets the same fractional number of
copies, target / size. The whole part is taken; the fractions are rounded
in pairs: mass in words moves at random between two documents, with
probabilities that keep each one's expectation, until one of them is integral.
One document of a block stays fractional and goes up a reduction tree, block by
block, until each source has one left, which is rounded at random by itself.
So a source's taken words miss the target by less than one document.

Blocks are dealt by hash and hold about FAN documents whatever a source's size, and a source
has as many as its own documents need; only ids and sizes move. All random numbers are hashes of ids and a seed: reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 times, unless whole
copies say otherwise (they add no words); a null source is a source of its own,
last in order; repeated rows are documents of their own; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut, mix64

FAN = 4096
WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (3.0, 1.0, 2.0)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
    )


def targets(by_source: DataFrame, budget: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Adds weight and target to rows (source, source_size and others), one for each source.

    The capped shares solve sum(min(cap, weight * level)) = budget: sources are
    filled in order of cap / weight, and the level follows from prefix sums. Windows over
    all rows run on one row a source, never on documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycled = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    ranked = by_source.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", cycled).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    level = (F.col("all_size") * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("level", level)
    # Up to the first source that its level doesn't fill, each one is full; from there that level holds.
    open_ = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))
    first = F.first(open_, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.coalesce(F.least(F.col("cap"), F.col("weight") * first), F.col("cap"))
    return filled.withColumn("target", at).select(*by_source.columns, "weight", "target")


def _uniform(a: int, b: int, seed: int) -> float:
    x = np.array([(a * 0x9E3779B97F4A7C15 + b * 0xD1342543DE82EF95 + seed) & (2**64 - 1)], dtype=np.uint64)
    return float(int(mix64(mix64(x))[0]) >> 11) / (1 << 53)


def round_pairs(ids: list[int], size: list[int], p: list[float], seed: int) -> tuple[list[float], int | None]:
    """Pivotal rounding in the given order; the fractions afterwards, and the place of the one left over."""
    p, held = list(p), None
    for i in range(len(ids)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held is None:
            held = i
            continue
        j = held
        # Words that can move from i to j, and from j to i.
        up, down = min(p[i] * size[i], (1 - p[j]) * size[j]), min((1 - p[i]) * size[i], p[j] * size[j])
        if _uniform(ids[i], ids[j], seed) * (up + down) < down:
            a, b = p[i] - up / size[i], p[j] + up / size[j]
        else:
            a, b = p[i] + down / size[i], p[j] - down / size[j]
        a, b = (round(x) * 1.0 if abs(x - round(x)) < 1e-9 else x for x in (a, b))
        p[i], p[j] = a, b
        held = next((k for k in (i, j) if 0.0 < p[k] < 1.0), None)
    return p, held


def _level(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        last = rows["blocks"].iloc[0] == 1
        # Long documents first: what is left over at the end is then short.
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        ids = [0 if pd.isna(x) else int(x) for x in rows["doc_id"]]
        p, held = round_pairs(ids, rows["size"].tolist(), rows["part"].tolist(), seed)
        if held is not None and last:
            p[held] = 1.0 if _uniform(ids[held], held, seed + 1) < p[held] else 0.0
            held = None
        rows["part"] = p
        rows["open"] = [k == held for k in range(len(p))]
        return rows

    return run


def mix(docs: DataFrame, seed: int = 20240229, fan: int = FAN, budget: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs."""
    sized = cut(sizes(docs))
    by_source = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), budget, most, cycle))
    sources = by_source.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.alias("d").join(F.broadcast(by_source).alias("s") if sources["n"] <= 10_000 else by_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    blocks = F.ceil(F.col("n") / F.lit(fan)).cast("long").alias("blocks")
    rows = rows.select("doc_id", "d.source", "size", "source_size", "target", F.floor(rate).cast("long").alias("whole"), F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)).alias("part"), blocks)
    # The size too, so that rows without an id are not one block.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks"))).withColumn("open", F.lit(True))
    n_blocks, done = max(1, -(-(sources["most"] or 0) // fan)), []
    while True:
        rows = cut(rows.groupBy("source", "block").applyInPandas(_level(seed), rows.schema))
        done.append(rows.where("not open"))
        if n_blocks == 1:
            break
        n_blocks = -(-n_blocks // fan)
        rows = rows.where("open").withColumn("blocks", F.ceil(F.col("blocks") / F.lit(fan)).cast("long"))
        rows = rows.withColumn("block", F.pmod("block", "blocks"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.col("part").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    """docs with each row as often as the mix takes it; columns as they come."""
    plan = mix(docs, **kw).where("copies > 0").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__tm_id"), "size", "copies")
    plan = plan.groupBy("__tm_id").agg(F.sum("copies").alias("__tm_copies"), F.count(F.lit(1)).alias("__tm_rows"))
    rows = docs.withColumn("__tm_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).join(plan, "__tm_id")
    # Rows that repeat an id share its copies, the first ones taking what doesn't divide.
    place = F.row_number().over(Window.partitionBy("__tm_id").orderBy("text")) - 1
    share = (F.col("__tm_copies") / F.col("__tm_rows")).cast("long") + (F.col("__tm_place") < F.col("__tm_copies") % F.col("__tm_rows")).cast("long")
    rows = rows.withColumn("__tm_place", place).withColumn("__tm_copy", share).where("__tm_copy > 0").withColumn("__tm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tm_copy"))))
    return rows.drop("__tm_id", "__tm_copies", "__tm_rows", "__tm_place", "__tm_copy")
