"""A lazy builder over DataFrames with SQL's verbs and a strict error contract; it holds a DataFrame, not SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V, windows as W

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}
#: Type names beyond Spark's own (fixed values).
TYPES = {"VARCHAR": "string", "TEXT": "string", "UTF8": "string", "INT64": "bigint", "INT32": "int", "FLOAT64": "double", "FLOAT32": "float"}


class FrameError(ValueError):
    """A call that the builder refuses."""


@dataclass(frozen=True, eq=False)
class Expr:
    """A column expression; operators follow SQL: integers divide to integers, comparisons with null are null."""

    c: Column
    over_able: bool = False

    def _do(self, f: Callable, other) -> Expr:
        return Expr(f(self.c, other.c if isinstance(other, Expr) else V.lit(other)))

    def __add__(self, o): return self._do(lambda a, b: a + b, o)
    def __sub__(self, o): return self._do(lambda a, b: a - b, o)
    def __mul__(self, o): return self._do(lambda a, b: a * b, o)
    def __truediv__(self, o): return self._do(lambda a, b: a / F.nullif(b, F.lit(0)), o)
    def __floordiv__(self, o): return self._do(V.int_div, o)
    def __mod__(self, o): return self._do(lambda a, b: a % F.nullif(b, F.lit(0)), o)
    def __neg__(self): return Expr(-self.c)
    def __eq__(self, o): return self._do(lambda a, b: a == b, o)
    def __ne__(self, o): return self._do(lambda a, b: a != b, o)
    def __lt__(self, o): return self._do(lambda a, b: a < b, o)
    def __le__(self, o): return self._do(lambda a, b: a <= b, o)
    def __gt__(self, o): return self._do(lambda a, b: a > b, o)
    def __ge__(self, o): return self._do(lambda a, b: a >= b, o)
    def __and__(self, o): return self._do(lambda a, b: a & b, o)
    def __or__(self, o): return self._do(lambda a, b: a | b, o)
    def __invert__(self): return Expr(~self.c)
    __hash__ = None

    def __bool__(self):
        raise FrameError("an expression has no truth value; use & | ~")

    def alias(self, name: str) -> Expr: return Expr(self.c.alias(name))
    def is_null(self) -> Expr: return Expr(self.c.isNull())
    def is_not_null(self) -> Expr: return Expr(self.c.isNotNull())
    def is_in(self, values: list) -> Expr: return Expr(V.is_in(self.c, list(values)))
    def between(self, lo, hi) -> Expr: return (self >= lo) & (self <= hi)

    def like(self, pattern: str) -> Expr:
        if not isinstance(pattern, str):
            raise FrameError("a pattern is a string")
        return Expr(self.c.like(pattern))

    def not_like(self, pattern: str) -> Expr: return ~self.like(pattern)

    def ilike(self, pattern: str) -> Expr:
        if not isinstance(pattern, str):
            raise FrameError("a pattern is a string")
        return Expr(self.c.ilike(pattern))

    def cast(self, kind: str) -> Expr:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*(\s*\(\s*\d+\s*(,\s*\d+\s*)?\))?", kind):
            raise FrameError(f"not a type: {kind!r}")
        return Expr(self.c.cast(TYPES.get(kind.upper(), kind)))

    def _agg(self, f: Callable) -> Expr: return Expr(f(self.c), True)
    def sum(self) -> Expr: return self._agg(F.sum)
    def mean(self) -> Expr: return self._agg(F.avg)
    def min(self) -> Expr: return self._agg(F.min)
    def max(self) -> Expr: return self._agg(F.max)
    def count(self) -> Expr: return self._agg(F.count)
    def n_unique(self) -> Expr: return self._agg(F.count_distinct)
    def std(self) -> Expr: return self._agg(F.stddev_samp)
    def var(self) -> Expr: return self._agg(F.var_samp)
    def median(self) -> Expr: return self._agg(F.median)
    def quantile(self, q: float) -> Expr: return self._agg(lambda c: F.percentile(c, q))
    def first_by(self, *order: Expr) -> Expr: return self._agg(lambda c: F.min_by(c, F.struct(*[o.c for o in order])))
    def last_by(self, *order: Expr) -> Expr: return self._agg(lambda c: F.max_by(c, F.struct(*[o.c for o in order])))

    def abs(self) -> Expr: return Expr(F.abs(self.c))
    def ln(self) -> Expr: return Expr(F.ln(self.c))
    def log10(self) -> Expr: return Expr(F.log10(self.c))
    def exp(self) -> Expr: return Expr(F.exp(self.c))
    def sqrt(self) -> Expr: return Expr(F.sqrt(self.c))
    def sign(self) -> Expr: return Expr(F.signum(self.c))
    def round(self, digits: int = 0) -> Expr: return Expr(F.round(self.c, digits))
    def floor(self) -> Expr: return Expr(F.floor(self.c))
    def ceil(self) -> Expr: return Expr(F.ceil(self.c))

    def over(self, partition_by=(), order_by=(), rows=None, duration=None) -> Expr:
        if not self.over_able:
            raise FrameError("over() takes one aggregate")
        return Expr(self.c.over(W.frame(partition_by, order_by, rows, duration)))


def col(name: str, relation: str | None = None) -> Expr:
    """A column; with relation `l` or `r`, that side's in a join's condition."""
    return Expr(F.col(f"{relation}.`{name}`") if relation else V.col(name))


def lit(value) -> Expr:
    return Expr(V.lit(value))


def sql_expr(text: str) -> Expr:
    return Expr(F.expr(text))


def count_star() -> Expr:
    return Expr(F.count(F.lit(1)), True)


def coalesce(*xs: Expr) -> Expr:
    return Expr(F.coalesce(*[x.c for x in xs]))


def greatest(*xs: Expr) -> Expr:
    return Expr(F.greatest(*[x.c for x in xs]))


def least(*xs: Expr) -> Expr:
    return Expr(F.least(*[x.c for x in xs]))


class when:
    """when(a).then(x).when(b).then(y).otherwise(z); without otherwise, null."""

    def __init__(self, condition: Expr, so_far: Column | None = None):
        self._condition, self._so_far = condition, so_far

    def then(self, value) -> Then:
        v = value.c if isinstance(value, Expr) else V.lit(value)
        return Then(F.when(self._condition.c, v) if self._so_far is None else self._so_far.when(self._condition.c, v))


class Then(Expr):
    def when(self, condition: Expr) -> when:
        return when(condition, self.c)

    def otherwise(self, value) -> Expr:
        return Expr(self.c.otherwise(value.c if isinstance(value, Expr) else V.lit(value)))


def _columns(exprs, named) -> list[Column]:
    out = [V.col(e) if isinstance(e, str) else e.c for e in exprs]
    return out + [e.c.alias(k) for k, e in named.items()]


class LazyFrame:
    def __init__(self, df: DataFrame):
        self.df = df

    def select(self, *exprs, **named) -> LazyFrame:
        return LazyFrame(self.df.select(*_columns(exprs, named)))

    def with_columns(self, replace: tuple[str, ...] = (), **named) -> LazyFrame:
        if clash := [k for k in named if k in self.df.columns and k not in replace]:
            raise FrameError(f"columns exist: {clash}; name them in replace")
        return LazyFrame(self.df.withColumns({k: e.c for k, e in named.items()}))

    def filter(self, *predicates: Expr) -> LazyFrame:
        out = self.df
        for p in predicates:
            out = out.where(p.c)
        return LazyFrame(out)

    def group_by(self, *keys) -> GroupBy:
        return GroupBy(self.df, _columns(keys, {}))

    def join(self, other: LazyFrame, on=None, how: str = "inner", left_on=None, right_on=None, predicate: Expr | None = None) -> LazyFrame:
        """Sides are `l` and `r` in predicates; names are not made unique, so select what is ambiguous by relation."""
        if how not in HOW:
            raise FrameError(f"how is one of {sorted(HOW)}")
        l, r = self.df.alias("l"), other.df.alias("r")
        if how == "cross":
            return LazyFrame(l.crossJoin(r))
        as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
        pairs = list(zip(as_list(left_on or on), as_list(right_on or on), strict=True))
        if not pairs and predicate is None:
            raise FrameError("a join needs keys or a predicate")
        condition = None
        for a, b in pairs:
            c = F.col(f"l.`{a}`") == F.col(f"r.`{b}`")
            condition = c if condition is None else condition & c
        if predicate is not None:
            condition = predicate.c if condition is None else condition & predicate.c
        return LazyFrame(l.join(r, condition, HOW[how]))

    def sort(self, *by, descending: bool | list[bool] = False) -> LazyFrame:
        down = descending if isinstance(descending, list) else [descending] * len(by)
        if len(down) != len(by):
            raise FrameError("descending must match the keys")
        return LazyFrame(self.df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_last() for c, d in zip(_columns(by, {}), down, strict=True)]))

    def limit(self, n: int, offset: int = 0) -> LazyFrame:
        return LazyFrame((self.df.offset(offset) if offset else self.df).limit(n))

    head = limit

    def unique(self) -> LazyFrame:
        return LazyFrame(self.df.distinct())

    def union(self, other: LazyFrame, all: bool = True) -> LazyFrame:
        out = self.df.unionByName(other.df)
        return LazyFrame(out if all else out.distinct())

    def drop(self, *names: str) -> LazyFrame:
        return LazyFrame(self.df.drop(*names))

    def pipe(self, f: Callable, *args, **kw):
        return f(self, *args, **kw)

    def explain(self, mode: str = "formatted") -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def schema(self):
        return self.df.schema

    def collect(self, max_rows: int | None = None, timeout: float | None = None) -> list:
        """All rows; more than max_rows is an error, not a cut; a job beyond timeout seconds is cancelled."""
        df = self.df if max_rows is None else self.df.limit(max_rows + 1)
        if timeout is not None:
            import threading
            import uuid

            group, sc = uuid.uuid4().hex, df.sparkSession.sparkContext
            sc.setJobGroup(group, "collect with a timeout", True)
            timer = threading.Timer(timeout, sc.cancelJobGroup, [group])
            timer.start()
            try:
                rows = df.collect()
            finally:
                timer.cancel()
                sc.setLocalProperty("spark.jobGroup.id", None)
        else:
            rows = df.collect()
        if max_rows is not None and len(rows) > max_rows:
            raise FrameError(f"the result has over {max_rows} rows")
        return rows

    def to_arrow(self):
        return self.df.toArrow()

    def to_pandas(self):
        return self.df.toPandas()


class GroupBy:
    def __init__(self, df: DataFrame, keys: list[Column]):
        self._df, self._keys = df, keys

    def agg(self, *exprs, **named) -> LazyFrame:
        return LazyFrame(self._df.groupBy(*self._keys).agg(*_columns(exprs, named)))

    def count(self) -> LazyFrame:
        return self.agg(count=count_star())
