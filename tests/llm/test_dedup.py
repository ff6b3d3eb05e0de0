import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import common, exact_dedup as E, near_dedup as N

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_exact(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(d)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, top[k := (t or "").translate(LOWER)], len(groups[k]), d == top[k], hashlib.sha256(k.encode()).hexdigest()) for d, t, *_ in rows), key=str)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(spark, frame, odd_rows, bits):
    """With 2-bit hashes most chunks clash, and their contents must tell them apart."""
    rows = odd_rows + [(100 + i, odd_rows[7][1][i:], "en", "a") for i in range(3)]
    assert sorted((tuple(r) for r in E.exact_groups(frame(rows), bits).collect()), key=str) == plain_exact(rows)


def test_chunks_follow_content():
    draw = random.Random(1)
    b = bytes(draw.randrange(97, 123) for _ in range(200_000))
    cut = lambda x: [x[i:j] for i, j in zip([0, *E.chunk_ends(x)], E.chunk_ends(x), strict=False)]
    assert b"".join(cut(b)) == b
    assert len(set(cut(b)) & set(cut(b"new beginning " + b))) > len(cut(b)) * 0.8


def test_exact_dedup_keeps_columns(spark, frame, odd_rows):
    docs = frame(odd_rows)
    kept = E.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t, *_ in odd_rows})
    assert E.exact_groups(frame([])).collect() == [] == E.exact_dedup(frame([])).collect()


def plain_near(rows, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    comp = [min(least[find(i)]) if r[0] is not None else None for i, r in enumerate(rows)]
    return sorted(((r[0], len(sets[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows)), key=str)


def family(n, words, edits, seed):
    """Copies of one text with some words changed, chains of copies of copies among them."""
    draw = random.Random(seed)
    original = [f"w{draw.randrange(500)}" for _ in range(words)]
    out = [original]
    for _ in range(n - 1):
        copy = list(draw.choice([original, original, draw.choice(out)]))
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def test_near_groups(spark, frame, odd_rows):
    texts = family(60, 150, 4, 1) + family(12, 80, 2, 2) + family(5, 40, 1, 3) + ["a b c d", "A b c d", "a b c d e"]
    rows = odd_rows + [(1000 - i, t, "en", "a") for i, t in enumerate(texts)]
    assert sorted((tuple(r) for r in N.near_groups(frame(rows), 0.85).collect()), key=str) == plain_near(rows)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (203, 201), (5, 5)]
    got = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in [*range(1, 41), 100]} | {201: 200, 203: 200}


def test_near_groups_at_the_default(spark, frame, odd_rows):
    rows = odd_rows + [(1000 - i, t, "en", "a") for i, t in enumerate(family(40, 120, 5, 11) + family(15, 60, 3, 12))]
    assert sorted((tuple(r) for r in N.near_groups(frame(rows)).collect()), key=str) == plain_near(rows, 80)


@pytest.mark.parametrize("order", [1, -1])
def test_repeated_ids_with_other_texts(spark, frame, order):
    """Both texts of document 2 have a near copy; which row comes first changes nothing, and one row of each pair stays."""
    draw = random.Random(3)
    a, b = ([f"{c}{draw.randrange(900)}" for _ in range(90)] for c in "ab")
    rows = [(2, " ".join(a), "en", "a"), (2, " ".join(b), "en", "a")][::order] + [(5, " ".join([*a, "z"]), "en", "a"), (6, " ".join([*b, "z"]), "en", "a"), (1, " ".join([*b, "z", "y"]), "en", "a")]
    assert sorted((tuple(r) for r in N.near_groups(frame(rows), 0.85).collect()), key=str) == plain_near(rows)
    kept = N.near_dedup(frame(rows), 0.85).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in kept) == [(1, "b"), (2, "a")]


def test_hot_centres_are_dealt(spark, frame, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, t, "en", "a") for i, t in enumerate(family(60, 150, 4, 1) + family(30, 90, 3, 2))]
    assert sorted((tuple(r) for r in N.near_groups(frame(rows), 0.85).collect()), key=str) == plain_near(rows)


def test_near_dedup_on_odd_rows(spark, frame, odd_rows):
    """Rows without an id and each empty document stay; repeated rows and links leave one."""
    docs = frame(odd_rows)
    got = sorted(((r["doc_id"], r["text"]) for r in N.near_dedup(docs).collect()), key=str)
    want = {(d, t) for d, t, *_ in odd_rows if d is None}
    reps = {r[2] for r in plain_near(odd_rows, 80)}
    want |= {(d, t) for d, t, *_ in odd_rows if d is not None and d in reps}
    assert got == sorted(want, key=str)


def test_near_pairs_that_share_a_passage(spark, frame):
    """Pairs whose first common band lies in the large bucket of a passage that all documents share."""
    draw = random.Random(8)
    passage, texts = [f"p{i}" for i in range(110)], []
    for i in range(400):
        text = passage + [f"w{draw.randrange(10**6)}" for _ in range(110)]
        texts.append(" ".join(text))
        if i < 250:
            text[draw.randrange(115, 215)] = "changed"
            texts.append(" ".join(text))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    assert sorted((tuple(r) for r in N.near_groups(frame(rows), 0.85).collect()), key=str) == plain_near(rows)


def test_screen_follows_the_threshold():
    """Signatures that agree in 80 of 128 places are within 6 standard deviations of 0.8, but not of 0.85."""
    sigs = np.zeros((2, N.VALUES), np.uint16)
    sigs[1, 80:] = 1
    pairs = [len(N._bucket_pairs(np.arange(2), sigs, np.zeros(2, np.int64), 0, N.screen(t))[0]) for t in (0.8, 0.85)]
    assert pairs == [1, 0] and (N.far_bands(0.8), N.far_bands(0.85)) == (2, 4)


def test_near_dedup_keeps_one(spark, frame):
    rows = [(i, t, "en", "a") for i, t in enumerate(family(20, 100, 0, 4))] + [(50, "other words entirely for this one", "en", "b"), (50, "other words entirely for this one", "en", "b")]
    docs = frame(rows)
    kept = N.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 50]
    assert N.near_groups(frame([])).collect() == []
