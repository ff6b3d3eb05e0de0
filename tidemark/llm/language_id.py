"""Language identification by error-correcting output codes over character n-grams.

Each learned language has a codeword; each bit splits the languages in two, and
a binary classifier (log-odds of hashed character 1- to 3-grams, smoothed) predicts that bit
from a text's mean log-odds. Decoding adds the logistic loss of all bits, each bit
weighed by its accuracy on the training sample, and takes the nearest
codeword. `ambiguous` marks texts whose second codeword is nearly as near.

With few languages the code is the exhaustive one; beyond that random splits, drawn
from a fixed seed until all pairs of codewords are far apart.

The n-gram counts come from a sample of about `per_language` labelled rows of each language, those of
the smallest hashes; the languages themselves from all labelled rows.

Defined cases: null texts and texts without a letter are `und` with score 0; with
one learned language every text with a letter is that one, with none it is `und`; rows
without lang teach nothing; an empty table gives no rows; long texts are read whole;
repeated rows are predicted each; lang, source and doc_id are not inputs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Expected bound on training rows of each language.
PER_LANGUAGE = 3_000
ORDERS, BUCKETS = 3, 1 << 16
EXHAUSTIVE_UP_TO, BITS_BEYOND = 6, 63
AMBIGUOUS_BELOW = 0.6
_BLOCK_CHARS = 500_000


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each language."""
    if n == 0:
        return np.zeros((0, 0), dtype=np.int8)
    if n <= EXHAUSTIVE_UP_TO:
        splits = [[1, *rest] for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, dtype=np.int8).reshape(len(splits), n).T
    draw = np.random.default_rng(n)
    best, far = None, -1
    for _ in range(50):
        code = np.where(draw.random((n, BITS_BEYOND)) < 0.5, 1, -1).astype(np.int8)
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        near = min(int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(n), 2))
        if near > far:
            best, far = code, near
    return best


def ngram_blocks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: from, to, the n-grams' buckets (order, position), each position's text.

    Texts are lower-cased, runs of anything but letters become one space. Positions
    are those of a text's letters and spaces; n-grams end there and begin in the text.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _BLOCK_CHARS):
            size += len(texts[j]) + 1
            j += 1
        lowered = [x.lower() for x in texts[i:j]]
        c = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in lowered), np.int64, len(lowered)))
        letter = _letters()[c]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one separator after a run of letters
        at = np.flatnonzero(keep)
        doc = np.searchsorted(ends, at, side="left")
        c = np.where(letter[at], c[at], 0).astype(np.uint64)
        before = np.concatenate([[0], c[:-1]]).astype(np.uint64) if len(c) else c
        before[np.diff(doc, prepend=-1) != 0] = 0
        first = np.concatenate([[0], before[:-1]]).astype(np.uint64) if len(c) else c
        first[np.diff(doc, prepend=-1) != 0] = 0
        mix = np.uint64(0x9E3779B97F4A7C15)
        one, two = (c + np.uint64(1)) * mix, (before + np.uint64(7)) * np.uint64(0xD1342543DE82EF95)
        three = (first + np.uint64(13)) * np.uint64(0xBF58476D1CE4E5B9)
        keys = np.stack([one, one ^ (two >> np.uint64(1)), one ^ (two >> np.uint64(1)) ^ (three >> np.uint64(2))])
        buckets = ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.int64)
        yield i, j, buckets, doc
        i = j


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language, bit
    weight: np.ndarray  # bit
    log_odds: np.ndarray  # order * bucket, bit


def fit(languages: list[str], counts: np.ndarray, trust: np.ndarray | None = None, smooth: float = 0.5) -> Model:
    """counts: language, order, bucket."""
    code = codewords(len(languages))
    share = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1)  # languages weigh the same
    scale = np.maximum(counts.sum(axis=2).mean(axis=0), 1)[:, None]
    bits = []
    for b in code.T:
        plus, minus = share[b > 0].mean(axis=0), share[b < 0].mean(axis=0)
        bits.append(np.log((plus * scale + smooth) / (minus * scale + smooth)))
    odds = np.stack(bits, axis=-1).reshape(ORDERS * BUCKETS, -1) if bits else np.zeros((ORDERS * BUCKETS, 0))
    return Model(languages, code, np.ones(code.shape[1]) if trust is None else trust, np.clip(odds, -6, 6).astype(np.float32))


def bit_margins(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-odds of each bit for each text, and how many letters it has."""
    margin, letters = np.zeros((len(texts), model.code.shape[1])), np.zeros(len(texts), np.int64)
    for i, j, buckets, doc in ngram_blocks(texts):
        if not len(doc):
            continue
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        has = doc[begin]
        n = np.diff(np.append(begin, len(doc)))
        letters[i + has] = n
        for order in range(ORDERS):
            odds = model.log_odds[order * BUCKETS : (order + 1) * BUCKETS]
            for b in range(odds.shape[1]):
                margin[i + has, b] += np.add.reduceat(np.ascontiguousarray(odds[:, b])[buckets[order]], begin, dtype=np.float64)
        margin[i + has] /= n[:, None] * ORDERS
    return margin, letters


def decode(margin: np.ndarray, letters: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest codeword (-1: none) and a score from 0 to 1."""
    if not model.languages:
        return np.full(len(margin), -1), np.zeros(len(margin))
    # Evidence grows with the text's length, though n-grams overlap and repeat.
    z = margin * np.sqrt(np.maximum(letters, 1))[:, None]
    loss = np.stack([(np.logaddexp(0, -z * c) * model.weight).sum(axis=1) for c in model.code], axis=1)
    loss /= max(model.weight.sum(), 1e-9) / max(1, model.code.shape[1])
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = np.argmin(loss, axis=1)
    none = letters == 0
    return np.where(none, -1, best), np.where(none, 0.0, p[np.arange(len(p)), best])


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """rows: text, lang and an id to draw the sample by."""
    known = rows.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return fit([], np.zeros((0, ORDERS, BUCKETS)))
    # A row is in the sample if its hash is among the share of all hashes that gives per_language rows.
    span, drawn = 1 << 63, F.lit(False)
    for lang in languages:
        share = min(1.0, per_language / sizes[lang])
        drawn = drawn | ((F.col("lang") == lang) & (F.col("h") <= F.lit(max(-span, min(span - 1, int((2 * share - 1) * span))))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                into = total.setdefault(lang, np.zeros(ORDERS * BUCKETS, np.int64))
                for _, _, buckets, _ in ngram_blocks(texts):
                    for order in range(ORDERS):
                        into[order * BUCKETS : (order + 1) * BUCKETS] += np.bincount(buckets[order], minlength=BUCKETS)
        for lang, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(c[some])], names=["lang", "bucket", "n"])

    counted = known.where(drawn).select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    # At most languages * ORDERS * BUCKETS numbers.
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), ORDERS * BUCKETS))
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    model = fit(languages, counts.reshape(len(languages), ORDERS, BUCKETS))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            margin, letters = bit_margins(batch.column(0).to_pylist(), model)
            truth = model.code[[place[x] for x in batch.column(1).to_pylist()]] if len(margin) else np.zeros((0, model.code.shape[1]))
            ok = ((margin * truth > 0) & (letters > 0)[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ok)), pa.int64()), pa.array(ok, pa.int64()), pa.array([int((letters > 0).sum())] * len(ok), pa.int64())], names=["bit", "ok", "n"])

    if len(languages) > 1:
        scores = known.where(drawn).select("text", "lang").mapInArrow(right, "bit long, ok long, n long").groupBy("bit").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect()
        for r in scores:
            model.weight[r["bit"]] = max(0.0, 2 * r["ok"] / max(r["n"], 1) - 1)
        if not model.weight.any():
            model.weight[:] = 1
    return model


def predict(docs: DataFrame, model: Model, *carry) -> DataFrame:
    """lang_pred, score, ambiguous for each row of docs, behind the columns `carry`."""
    rows = docs.select(F.col("text").cast("string").alias("text"), *carry)
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            best, score = decode(*bit_margins([x or "" for x in batch.column(0).to_pylist()], model), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(label[best], pa.string()), pa.array(score, pa.float64()), pa.array((score < AMBIGUOUS_BELOW) & (best >= 0))], names=[*names, "lang_pred", "score", "ambiguous"])

    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(run, ", ".join([*carried, "lang_pred string", "score double", "ambiguous boolean"]))


def identify(docs: DataFrame, folds: int = 5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned where crc32(doc_id) mod folds is not 0."""
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
    model = train(docs.where(~held_out), per_language)
    return predict(docs, model, doc_id.alias("doc_id"), held_out.alias("held_out"))
