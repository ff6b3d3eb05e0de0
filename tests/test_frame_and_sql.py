import itertools

import pytest

from tidemark.plans import sql as S
from tidemark.plans.frame import FrameError, LazyFrame, col, count_star, lit, when


@pytest.fixture
def lf(spark):
    return LazyFrame(spark.createDataFrame([(i, ["AAPL", "MSFT", "GOOG"][i % 3], 100.0 + i, 10 + i) for i in range(12)], "t int, s string, p double, n int"))


VERBS = {
    "filter": lambda f: f.filter(col("t") > 3),
    "sort": lambda f: f.sort("t", descending=True),
    "limit": lambda f: f.sort("t").limit(8),
    "unique": lambda f: f.unique(),
    "with": lambda f: f.with_columns(replace=("p",), p=col("p") + 1),
    "select": lambda f: f.select("t", "s", "p", "n"),
}


def apply_plain(name, rows):
    if name == "filter":
        return [r for r in rows if r[0] > 3]
    if name == "limit":
        return sorted(rows)[:8]
    return [(t, s, p + 1, n) for t, s, p, n in rows] if name == "with" else rows


@pytest.mark.parametrize("pair", list(itertools.permutations(VERBS, 2)), ids="-".join)
def test_verb_pairs(lf, pair):
    rows, out = [(i, ["AAPL", "MSFT", "GOOG"][i % 3], 100.0 + i, 10 + i) for i in range(12)], lf
    for name in pair:
        out, rows = VERBS[name](out), apply_plain(name, rows)
    assert sorted(tuple(r) for r in out.collect()) == sorted(rows)


def test_contract(lf):
    with pytest.raises(FrameError):
        lf.with_columns(p=lit(1))
    with pytest.raises(FrameError):
        lf.join(lf)
    with pytest.raises(FrameError):
        bool(col("p") > 1)
    with pytest.raises(FrameError):
        col("p").over("s")
    with pytest.raises(FrameError):
        col("s").like(3)
    with pytest.raises(FrameError):
        col("s").cast("int); drop")
    with pytest.raises(FrameError):
        lf.collect(max_rows=5)
    with pytest.raises(ValueError):
        lit(float("nan"))
    assert lf.filter(col("s").is_in([])).collect() == []
    assert "Scan" in lf.explain() and len(lf.collect(max_rows=12, timeout=60)) == 12


def test_group_join_case(lf):
    g = lf.group_by("s").agg(total=col("n").sum(), rows=count_star(), last=col("p").last_by(col("t")))
    assert {tuple(r) for r in g.collect()} == {("AAPL", 58, 4, 109.0), ("MSFT", 62, 4, 110.0), ("GOOG", 66, 4, 111.0)}
    kind = when(col("t") < 4).then("a").when(col("t") < 8).then("b")
    got = lf.select("t", k=kind).group_by("k").count()
    assert {tuple(r) for r in got.collect()} == {("a", 4), ("b", 4), (None, 4)}
    j = lf.join(lf, on="s", predicate=col("t", "l") < col("t", "r")).select(a=col("t", "l"), b=col("t", "r"))
    assert len(j.collect()) == 18
    roll = lf.select("t", m=col("p").mean().over("s", "t", rows=2))
    assert {r["t"]: r["m"] for r in roll.collect()}[3] == 101.5


def test_sql_extensions(spark, lf):
    lf.df.createOrReplaceTempView("trades")
    spark.createDataFrame([(1, "AAPL", 9.0), (4, "MSFT", 8.0)], "u int, sym string, bid double").createOrReplaceTempView("quotes")
    out = S.sql(spark, "SELECT t, s, bid FROM trades x ASOF LEFT JOIN quotes q MATCH_CONDITION (x.t >= q.u) ON x.s = q.sym WHERE t < 5")
    assert {tuple(r) for r in out.collect()} == {(0, "AAPL", None), (1, "MSFT", None), (2, "GOOG", None), (3, "AAPL", 9.0), (4, "MSFT", 8.0)}
    got = S.sql(spark, "SELECT t, rolling_sum(n, t, 2, s) AS r FROM trades")
    assert {r["t"]: r["r"] for r in got.collect()}[11] == 18 + 21
    with pytest.raises(ValueError):
        S.rewrite_rolling("rolling_sum(n, t, 0)")
    S.register(spark)
    r = spark.sql("SELECT frame_mad(collect_list(struct(CAST(x AS DOUBLE) AS x))) AS m FROM VALUES (1), (2), (3), (4), (10) AS t(x)").first()
    assert r["m"] == pytest.approx(2.4)
