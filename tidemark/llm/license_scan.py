"""Licence scan with a positional index of rare words. DataFrame functions only.

Templates are short licence notices. For every word of theirs the document frequency is
counted over all texts; a template is indexed under its ANCHORS rarest words, each
posting being (template, position). A file looks up all indexed words that it holds,
turns each place into the template's would-be start there, and intersects:
a start that two anchors agree on is a candidate. It is then compared word by word; the
score is the matched share of the template's IDF weight, and the template's label counts
only if its mandatory key phrase stands at its place.

Apart from these labels, base phrases are found wherever their words stand consecutively.

Everything happens within the row; just the counts of template words (a few hundred
numbers, fixed by the templates) go to the driver in between.

Defined cases: null texts are empty, with no words and score 0; repeated rows are scanned
each; empty tables give no rows; long texts are scanned whole; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates (fixed values): label, notice, mandatory key phrase.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Index terms a template, least matched share of IDF weight.
ANCHORS, LEAST = 4, 0.7


def words(text: Column) -> Column:
    """The words of a text in lower case, for comparison with ASCII words only.

    lower() maps one other letter, the Kelvin sign, to ASCII; it is taken out of the way first.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b"))), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of rows, and in how many each template word stands."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    found = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    rows = docs.select(words(F.col("text").cast("string")).alias("words")).select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word"))
    counts = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def build_index(n_docs: int, counts: dict[str, int]) -> tuple[dict[str, float], dict[str, list[tuple[int, int]]]]:
    """IDF of template words, and postings of each template's rarest words."""
    idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 0.5)) + 1e-6 for _, notice, _ in TEMPLATES for w in notice.split()}
    idf = {w: max(x, 1e-6) for w, x in idf.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(TEMPLATES):
        own = notice.split()
        for w in sorted(set(own), key=lambda w: (-idf[w], w))[:ANCHORS]:
            postings.setdefault(w, []).extend((t, i) for i, x in enumerate(own) if x == w)
    return idf, postings


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _templates(idf: dict[str, float]) -> Column:
    """The templates as a constant array of structs."""
    out = []
    for label, notice, key in TEMPLATES:
        own, phrase = notice.split(), key.split()
        at = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        weights = [idf[w] for w in own]
        out.append(F.struct(F.lit(label).alias("label"), _strings(own).alias("own"), F.array(*[F.lit(x / sum(weights)) for x in weights]).alias("weights"), F.array(*[F.lit(at + i) for i in range(len(phrase))]).alias("keys")))
    return F.array(*out)


def _base_label(i: Column) -> Column:
    """The label of the base phrase that starts at place i, else null."""
    out = None
    for phrase, label in BASE.items():
        here = None
        for k, w in enumerate(phrase.split()):
            same = F.get("words", i + k) == w
            here = same if here is None else here & same
        out = F.when(here, label) if out is None else out.when(here, label)
    return out


def scan(docs: DataFrame, *carry) -> DataFrame:
    """The columns `carry`, then n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (label, start, end, score of each verified notice)."""
    idf, postings = build_index(*document_frequencies(docs))
    wanted = sorted(set(postings) | {p.split()[0] for p in BASE})
    index = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])

    rows = docs.select(*carry, words(F.col("text").cast("string")).alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(wanted))
    rows = rows.withColumn("hits", F.when(F.size("words") > 0, places).otherwise(F.array().cast("array<int>")))

    based = F.filter(F.transform("hits", lambda i: F.struct(i.alias("i"), _base_label(i).alias("label"))), lambda x: x["label"].isNotNull())
    # Where the file's indexed words stand.
    anchored = F.filter("hits", lambda i: F.get("words", i).isin(sorted(postings)))
    rows = rows.withColumns({"based": based, "anchored": anchored})

    def starts(i: Column) -> Column:
        return F.transform(F.try_element_at(index, F.get("words", i)), lambda p: F.struct(p["t"].alias("t"), (i - p["p"]).alias("s")))

    rows = rows.withColumn("starts", F.when(F.size("anchored") > 1, F.array_sort(F.flatten(F.transform("anchored", starts)))))
    # Sorted, equal starts are neighbours: take each that has one just before it, once.
    same = lambda x, j: F.get("starts", j).eqNullSafe(x)
    agreed = F.filter("starts", lambda x, j: same(x, j - 1) & ~same(x, j - 2))
    rows = rows.withColumn("agreed", agreed).withColumn("templates", F.when(F.size("agreed") > 0, _templates(idf)))

    def compared(x: Column) -> Column:
        t = F.get("templates", x["t"])
        fits = lambda p: F.get("words", x["s"] + p).eqNullSafe(F.get(t["own"], p))
        matched = F.aggregate(F.transform(t["weights"], lambda w, p: F.when(fits(p), w).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, w: a + w)
        return F.struct(t["label"].alias("label"), x["s"].alias("start"), (x["s"] + F.size(t["own"])).alias("end"), F.least(matched, F.lit(1.0)).alias("score"), F.forall(t["keys"], fits).alias("key"))

    spans = F.filter(F.transform("agreed", compared), lambda c: c["key"] & (c["score"] >= LEAST))
    rows = rows.withColumn("spans", F.coalesce(F.when(F.size("agreed") > 0, spans), F.array().cast("array<struct<label:string,start:int,end:int,score:double,key:boolean>>")))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base_labels = F.transform("based", lambda b: b["label"])
    kept = [f for f in rows.columns if f not in ("words", "hits", "based", "anchored", "starts", "agreed", "templates", "spans")]
    return rows.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        F.size("based").cast("long").alias("n_base"),
        F.array_min(F.transform("based", lambda b: b["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("based", lambda b: b["i"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.transform("spans", lambda s: s.dropFields("key")).alias("spans"),
    )
