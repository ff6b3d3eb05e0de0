"""Validation splits of n ordered bars: purged k-fold, combinatorial, walk-forward.

Bars are rows with `place` (0 to n - 1) and, where labels look ahead, `horizon`: a bar's label spans place to place + horizon, and a
null horizon is 0. A split gives rows (fold, place, role) of all bars in each fold's reach: role is test, train or purged. Purged
is what follows a test block within the embargo (in walk-forward, what comes right before it), and every bar from whose
place to its label's end the fold's tests are touched; tests span from their first to their last bar.
Fold tables hold a row a fold and are made of n alone; walk-forward finds a bar's folds by arithmetic.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F


def embargo_width(total: int, embargo: float) -> int:
    """A fraction of the bars that a split spans, in bars."""
    if not 0 <= embargo < 1:
        raise ValueError("embargo is a fraction from 0 to below 1")
    return round(total * embargo)


def _blocks(n: int, parts: int) -> list[tuple[int, int]]:
    if parts < 2 or n < parts:
        raise ValueError(f"{n} bars can't be cut into {parts} parts")
    edges = [round(k * n / parts) for k in range(parts + 1)]
    return list(itertools.pairwise(edges))


def _horizon(bars: DataFrame) -> Column:
    return F.coalesce(F.col("horizon"), F.lit(0)) if "horizon" in bars.columns else F.lit(0)


def _in_blocks(bars: DataFrame, tests: list[list[tuple[int, int]]], width: int) -> DataFrame:
    block = lambda b: F.struct(F.lit(b[0]).alias("lo"), F.lit(b[1]).alias("hi"))
    folds = [F.struct(F.lit(k).cast("long").alias("fold"), F.array(*map(block, bs)).alias("blocks")) for k, bs in enumerate(tests)]
    rows = bars.select("place", _horizon(bars).alias("h"), F.inline(F.array(*folds)))
    at, first, last = F.col("place"), F.col("blocks")[0]["lo"], F.element_at("blocks", -1)["hi"] - 1
    test = F.exists("blocks", lambda b: (at >= b["lo"]) & (at < b["hi"]))
    after = F.exists("blocks", lambda b: (at >= b["hi"]) & (at < b["hi"] + width))
    role = F.when(test, "test").when(after | ((at <= last) & (at + F.col("h") >= first)), "purged").otherwise("train")
    return rows.select("fold", "place", role.alias("role"))


def purged_kfold(bars: DataFrame, n: int, folds: int = 5, embargo: float = 0.0) -> DataFrame:
    return _in_blocks(bars, [[b] for b in _blocks(n, folds)], embargo_width(n, embargo))


def combinatorial_purged(bars: DataFrame, n: int, groups: int = 6, test_groups: int = 2, embargo: float = 0.0) -> DataFrame:
    """A fold for each choice of test_groups out of groups."""
    if not 1 <= test_groups < groups:
        raise ValueError("test groups are fewer than groups")
    return _in_blocks(bars, [list(x) for x in itertools.combinations(_blocks(n, groups), test_groups)], embargo_width(n, embargo))


def walk_forward(bars: DataFrame, n: int, train: int, test: int, step: int | None = None, embargo: float = 0.0, expanding: bool = False) -> DataFrame:
    """Windows of train and test bars that move on by step (the test's length); the embargo is a share of one window."""
    step = test if step is None else step
    if min(train, test, step) < 1:
        raise ValueError("train, test and step are 1 or more")
    span, width = train + test, embargo_width(train + test, embargo)
    if width >= train:
        raise ValueError("the embargo leaves nothing to train on")
    folds = (n - span) // step + 1 if n >= span else 0
    at, fold = F.col("place"), F.col("fold")
    oldest = F.greatest(F.lit(0), F.ceil((at - span + 1) / step))
    newest = F.lit(folds - 1) if expanding else F.least(F.lit(folds - 1), F.floor(at / step))
    ids = F.when(oldest <= newest, F.sequence(oldest.cast("long"), newest.cast("long")))
    rows = bars.select("place", _horizon(bars).alias("h"), F.explode(ids).alias("fold"))
    first = fold * step + train
    role = F.when(at >= first, "test").when((at >= first - width) | (at + F.col("h") >= first), "purged").otherwise("train")
    return rows.select("fold", "place", role.alias("role"))
