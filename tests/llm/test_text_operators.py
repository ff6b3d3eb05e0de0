import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_id as L, license_scan as S, quality as Q

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_quality_counts(spark, frame, odd_rows):
    rows = odd_rows + [(200, "a a a a\na a a a\nb\n\nb\nb \n#$ %", "en", "a"), (201, "x y z " * 40, "en", "a")]
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, *_) in enumerate(rows) if d is not None] + [(999, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:7] for r in Q.judge(frame(rows), labels).collect()), key=str)
    assert got == sorted(((d, *plain_quality(t)) for d, t, *_ in rows), key=str)
    kept = Q.keep_good(frame(rows), labels)
    assert kept.columns == frame(rows).columns
    assert {r["doc_id"] for r in kept.collect()} <= {g[0] for g in got if not g[6]}
    assert Q.judge(frame([]), labels).collect() == []
    none = Q.judge(frame(rows), labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)


def test_trees_learn_and_are_monotone():
    draw = np.random.default_rng(2)
    x = draw.random((2000, 3))
    y = ((x[:, 0] < 0.5) & (draw.random(2000) > 0.1)).astype(float)
    trees = Q.train(x, y, np.array([-1, 0, 0]), n_trees=20)
    assert ((trees.margin(x) > 0) == (x[:, 0] < 0.5)).mean() > 0.97
    grid = np.repeat(draw.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(trees.margin(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert ((r["quality"] == 1) == r["kept"]).mean() > 0.97


def plain_margin(trees, x):
    total, inner = trees.bias, trees.feature.shape[1]
    for feature, threshold, value in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist(), strict=True):
        i = 0
        while i < inner:
            i = 2 * i + (2 if x[feature[i]] > threshold[i] else 1)
        total += value[i - inner]
    return total


def test_quality_against_a_plain_tree_walk(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = Q.learn(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = Q.judge(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        want = 1 / (1 + np.exp(-plain_margin(trees, Q.statistics([texts[r["doc_id"]]])[1][0].tolist())))
        assert r["score"] == pytest.approx(want, abs=1e-12) and r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)


def test_quality_of_repeated_labelled_rows(spark, frame):
    rows = [(i % 40, " ".join(f"w{(i * k) % 97}" for k in range(60 + i % 7)), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = Q.learn(frame(rows), labels), Q.learn(frame(rows[::-1]), labels)
    assert a.bias == b.bias == 0 and (a.feature == b.feature).all() and (a.value == b.value).all()


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 12):
        code = L.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
        if n > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3 - (n == 3)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(r) > 100 and (r["lang"] == r["lang_pred"]).mean() > 0.98 and r["score"].between(0, 1).all()


def test_language_edges(spark, frame, odd_rows):
    got = {r["doc_id"]: r for r in L.identify(frame(odd_rows)).collect()}
    assert {got[d]["lang_pred"] for d in (1, 2, 6)} == {"und"} and {got[d]["score"] for d in (1, 2, 6)} == {0.0}
    assert got[3]["lang_pred"] in ("en", "fr", "de") and len(L.identify(frame(odd_rows)).collect()) == len(odd_rows)
    assert L.identify(frame([])).collect() == []
    one = L.identify(frame([(i, "some words", "en", "a") for i in range(20)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}
    unlabelled = L.identify(frame([(1, "some words", None, "a")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)]


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in S.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


NOTICES = [
    "Foo. Licensed under the Apache License, Version 2.0! bar",
    "GNU General Public License gnu general public license MIT License cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met",
    "free and unencumbered",
    "ünder the mit lİcense mit \u212aicense MIT License\u212a \u212aMIT license",
]


def test_license_scan(spark, frame, odd_rows):
    rows = odd_rows + [(300 + i, t, "en", "a") for i, t in enumerate(NOTICES)] + [(400, (NOTICES[0] + " x ") * 500, "en", "a")]
    out = S.scan(frame(rows), "doc_id")
    got = {r["doc_id"]: r for r in out.where("doc_id >= 300").collect()}
    assert [got[300 + i]["labels"] for i in range(6)] == ["apache,apache-2.0", "apache,cc-by,gpl,mit".replace("apache,", ""), "mit", "bsd", "", ""]
    assert got[300]["score"] == pytest.approx(1) and 0.7 <= got[303]["score"] < 1
    assert len(got[400]["spans"]) == 500
    plain = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    assert plain == sorted(((d, *plain_scan(t)) for d, t, *_ in rows), key=str)
    assert S.scan(frame([]), "doc_id").collect() == []


def test_license_scan_finds_all_notices(spark, frame):
    whole = " and then ".join(notice for _, notice, _ in S.TEMPLATES)
    found = S.scan(frame([(1, whole, "en", "a"), (2, " ".join(["filler"] * 50), "en", "a")]), "doc_id")
    got = {r["doc_id"]: r for r in found.collect()}
    at, want = 0, []
    for label, notice, _ in S.TEMPLATES:
        n = len(notice.split())
        want.append((label, at, at + n))
        at += n + 2
    spans = {(s["label"], s["start"], s["end"]): s["score"] for s in got[1]["spans"]}
    assert set(want) <= set(spans) and all(spans[w] == pytest.approx(1) for w in want)
    assert {label for label, _, _ in S.TEMPLATES} <= set(got[1]["labels"].split(",")) and not got[2]["spans"]


def plain_spans(w, idf, postings):
    out = []
    for t, (label, notice, key) in enumerate(S.TEMPLATES):
        own, phrase = notice.split(), key.split()
        anchors = [p for places in postings.values() for u, p in places if u == t]
        at = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        for s in range(-len(own), len(w)):
            fits = [0 <= s + p < len(w) and w[s + p] == x for p, x in enumerate(own)]
            score = sum(idf[x] for x, f in zip(own, fits, strict=True) if f) / sum(idf[x] for x in own)
            if sum(fits[p] for p in anchors) > 1 and all(fits[at : at + len(phrase)]) and score >= S.LEAST:
                out.append((label, s, s + len(own), round(score, 9)))
    return sorted(out)


def test_license_scan_against_a_plain_matcher(spark, frame):
    draw = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        parts = []
        for t in draw.integers(0, len(S.TEMPLATES), draw.integers(1, 6)):
            w = S.TEMPLATES[t][1].split()
            for i in draw.integers(0, len(w), draw.integers(0, 4)):
                w[i] = str(draw.choice(["other", "the", "license", "software", "x"]))
            parts += w[draw.integers(0, 2) :] + ["filler"] * int(draw.integers(0, 3))
        texts.append(" ".join(parts))
    counts = Counter(w for t in texts for w in set(t.split()))
    idf, postings = S.build_index(len(texts), counts)
    got = S.scan(frame([(i, t, "en", "a") for i, t in enumerate(texts)]), "doc_id").collect()
    found = 0
    for r in got:
        w = texts[r["doc_id"]].split()
        want = plain_spans(w, idf, postings)
        assert sorted((s["label"], s["start"], s["end"], round(s["score"], 9)) for s in r["spans"]) == want
        base = [x for x in plain_scan(texts[r["doc_id"]])[4].split(",") if x]
        assert r["labels"] == ",".join(sorted({x[0] for x in want} | set(base)))
        assert r["score"] == pytest.approx(max([x[3] for x in want], default=0), abs=1e-8)
        found += len(want)
    assert found > 60
