import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import mixing as M


def plain_targets(sizes):
    """Reshare the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.CYCLE[i % 3] for i, s in enumerate(order)}
    budget, cap, full = 1.5 * sum(sizes.values()), {s: 2.0 * sizes[s] for s in order}, set()
    while True:
        rest = budget - sum(cap[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        if not (above := {s for s in open_ if share[s] > cap[s] + 1e-9}):
            return {s: cap[s] if s in full else share[s] for s in order}
        full |= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, out):
    total = Counter()
    for _, t, _, s in rows:
        total[s] += size(t)
    want = plain_targets(total)
    taken, longest = Counter(), defaultdict(int)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((d, s, size(t)) for d, t, _, s in rows)
    for r in out:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in total:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6


def test_mix(spark, frame, odd_rows):
    rows = odd_rows + [(1000 + i, "w " * (i % 90), "en", f"s{i % 4}") for i in range(400)]
    docs = frame(rows)
    out = M.mix(docs).collect()
    check(rows, out)
    again = M.mix(docs.repartition(7)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, out)) == sorted(map(key, again))
    check(rows, M.mix(docs, fan=8).collect())  # a tree of several levels


def test_copies_are_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    plan, out = M.mix(docs), M.mix_documents(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in plan.collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want


def test_no_rows(spark, frame):
    assert M.mix(frame([])).collect() == [] == M.mix_documents(frame([])).collect()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0.01, 0.99)), min_size=1, max_size=30))
def test_pairs_keep_the_sum(docs):
    ids, sizes, p = list(range(len(docs))), [d[0] for d in docs], [d[1] for d in docs]
    out, held = M.round_pairs(ids, sizes, p, 1)
    assert sum(x not in (0.0, 1.0) for x in out) == (held is not None)
    assert sum(a * b for a, b in zip(out, sizes, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, sizes, strict=True)), rel=1e-6)


def test_expectations_are_kept():
    p = [0.2, 0.7, 0.5, 0.9]
    mean = [sum(M.round_pairs([1, 2, 3, 4], [10, 10, 10, 10], p, seed)[0][k] for seed in range(3000)) / 3000 for k in range(4)]
    assert mean == pytest.approx(p, abs=0.03)
