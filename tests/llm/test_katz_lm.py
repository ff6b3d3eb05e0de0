import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import katz_lm


def brute_force(rows):
    """Scores by the formulas, with plain dictionaries."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]
    held = {i: zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for i, (d, _) in enumerate(rows)}
    train = [split(t) for i, (_, t) in enumerate(rows) if not held[i]]
    c1 = Counter(w for t in train for w in t)
    c2 = Counter(p for t in train for p in zip(t, t[1:], strict=False))
    n, v = sum(c1.values()), len(c1)
    d1, d2 = katz_lm.good_turing(Counter(c1.values())), katz_lm.good_turing(Counter(c2.values()))
    d = lambda table, c: table.get(c, c / (c + 1))
    unknown = 1 - sum(d(d1, c) * c for c in c1.values()) / n if n else 1.0
    p1 = lambda w: d(d1, c1[w]) * c1[w] / n if c1[w] else unknown
    base = lambda w: (c1[w] + 1) / (n + v + 1)
    assert sum(map(p1, c1)) + p1(("unknown",)) == pytest.approx(1, abs=1e-9)
    seen = defaultdict(dict)
    for (h, w), c in c2.items():
        seen[h][w] = d(d2, c) * c / c1[h]
    alpha = {h: (1 - sum(s.values())) / (1 - sum(map(p1, s))) for h, s in seen.items()}
    assert min(alpha.values(), default=1) > 0  # no history without a rest
    for h, s in list(seen.items())[:: len(seen) // 50 + 1]:  # exactly normalised over known words and the unknown one
        assert sum(s.values()) + alpha[h] * (sum(p1(w) for w in c1 if w not in s) + unknown) == pytest.approx(1, abs=1e-9)
    out = []
    for i, (doc, text) in enumerate(rows):
        t = split(text)
        total = math.log10(p1(t[0]))
        for h, w in zip(t, t[1:], strict=False):
            total += math.log10(seen[h][w]) if w in seen.get(h, ()) else math.log10(alpha.get(h, 1.0) * p1(w))
        out.append((doc, held[i], len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), total))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int")
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in katz_lm.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
    want = sorted(brute_force(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_against_brute_force(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r[0], r[1]) for r in table])


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, "a b a b a b"), (3, "a b a b a b"), (4, "A  b\tb\n b"), (None, "x y"), (9, "a " * 500)])


def test_many_partitions_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(katz_lm, "TOKENS_PER_PARTITION", 50)
    monkeypatch.setattr(katz_lm, "HOT", 20)
    check(spark, [(i, f"the cat sat on the mat {i % 3} the cat ran {i % 5}") for i in range(60)])


def test_empty(spark):
    assert katz_lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs_seen_once_are_in_the_model(spark):
    """All counts are 1 and too thin for Good-Turing, so that half of each goes: P1(q) = 1/6, and both pairs keep 1/2."""
    got = katz_lm.score(spark.createDataFrame([(None, "q z")], "doc_id long, text string")).first()
    assert got["score"] == pytest.approx(math.log10(1 / 6 / 2 / 2))


def test_long_text_and_blocks(spark, monkeypatch):
    """A text longer than a block, texts over several blocks and chunks, and many slices."""
    monkeypatch.setattr(katz_lm, "BLOCK", 3000)
    monkeypatch.setattr(katz_lm, "CHUNK", 64)
    draw = random.Random(2)
    text = lambda n: " ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(n))
    check(spark, [(0, text(20_000))] + [(i, text(draw.randint(0, 60))) for i in range(1, 120)])
