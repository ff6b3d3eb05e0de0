import math

import numpy as np
import pytest

from tidemark.quant import checks as C, perf as P, splits as S


def test_perf_against_numpy(spark):
    r = np.random.default_rng(3).normal(0.001, 0.02, 300)
    s = P.stats(spark.createDataFrame([(f"{i:04d}", float(x)) for i, x in enumerate(r)], "date string, ret double")).first()
    level = np.cumprod(1 + r)
    dd = level / np.maximum.accumulate(np.maximum(level, 1)) - 1
    dd = (level / np.maximum(1, np.maximum.accumulate(level)) - 1).min()
    down = math.sqrt(np.mean(np.minimum(r, 0) ** 2) * 252)
    want = {"cumulative": level[-1] - 1, "volatility": r.std(ddof=1) * 252**0.5, "sharpe": r.mean() / r.std(ddof=1) * 252**0.5, "max_drawdown": dd, "sortino": r.mean() * 252 / down, "value_at_risk": r.mean() - 2 * r.std(ddof=1), "tail_ratio": abs(np.quantile(r, 0.95)) / abs(np.quantile(r, 0.05))}
    for k, v in want.items():
        assert s[k] == pytest.approx(v, rel=1e-9), k


def test_drawdowns(spark):
    df = spark.createDataFrame([("1", 0.1), ("2", -0.5), ("3", 1.5), ("4", -0.1)], "date string, ret double")
    table = P.drawdown_table(df)
    assert [(d["peak"], d["valley"], d["recovery"]) for d in table] == [("1", "2", "3"), ("3", "4", None)]
    total_loss = spark.createDataFrame([("1", 0.1), ("2", -1.0), ("3", 0.5)], "date string, ret double")
    assert P.stats(total_loss).first()["cumulative"] == -1


def test_splits(spark):
    bars = spark.createDataFrame([(i, 3 if i % 2 else None) for i in range(60)], "place long, horizon int")
    roles = {(r["fold"], r["place"]): r["role"] for r in S.purged_kfold(bars, 60, 5, 0.05).collect()}
    assert len(roles) == 300
    for k in range(5):
        lo, hi = 12 * k, 12 * k + 12
        for i in range(60):
            touched = i < hi and i + (3 if i % 2 else 0) >= lo
            assert roles[k, i] == ("test" if lo <= i < hi else "purged" if hi <= i < hi + 3 or touched else "train")
    assert S.combinatorial_purged(bars, 60, 6, 2).select("fold").distinct().count() == 15
    for expanding in (False, True):
        rows = S.walk_forward(bars, 60, 20, 10, 5, 0.1, expanding).collect()
        for k in range(7):
            mine = {r["place"]: r["role"] for r in rows if r["fold"] == k}
            first = 5 * k + 20
            assert sorted(mine) == list(range(0 if expanding else 5 * k, first + 10))
            assert all((r == "test") == (p >= first) and (r == "purged") == (p < first and (p >= first - 3 or p + 3 * (p % 2) >= first)) for p, r in mine.items())
        assert max(r["fold"] for r in rows) == 6
    assert S.walk_forward(bars, 60, 60, 10).count() == 0
    with pytest.raises(ValueError):
        S.purged_kfold(bars, 60, 5, 1.0)


def test_overfitting(spark):
    rng = np.random.default_rng(1)
    noise = [(b, t, float(x)) for t in range(8) for b, x in enumerate(rng.normal(0, 1, 160))]
    good = noise + [(b, 99, float(x)) for b, x in enumerate(rng.normal(1, 1, 160))]
    schema = "bar int, trial int, ret double"
    assert C.probability_of_overfitting(spark.createDataFrame(good, schema)) == 0
    assert C.probability_of_overfitting(spark.createDataFrame(noise, schema)) > 0.2
    assert C.deflated_sharpe(0.1, 1000, 100, 0.05) < C.deflated_sharpe(0.1, 1000, 2, 0.05)
    assert C.minimum_track_record_length(0.0) == math.inf


def test_calibration(spark):
    df = spark.createDataFrame([(0.0, False), (0.1, False), (0.15, True), (1.0, True)], "p double, won boolean")
    assert {r["bucket"]: r["n"] for r in C.reliability_curve(df).collect()} == {1: 2, 2: 1, 10: 1}
    b = C.brier(df).first()
    assert b["brier"] == pytest.approx((0.01 + 0.85**2) / 4)
    with pytest.raises(Exception, match="out of range"):
        C.reliability_curve(spark.createDataFrame([(1.5, True)], "p double, won boolean")).collect()
