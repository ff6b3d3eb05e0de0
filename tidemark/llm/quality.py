"""Quality rules: document statistics, hard rules, and gradient-boosted trees with monotonic constraints.

Words are runs of anything but ASCII white space. A document fails the hard rules with
fewer than 50 words, or if over half of its words lie in 3-word windows that it
holds twice or more. The others are judged by trees over shares and means of its
statistics. They are trained on labelled documents (label 1: good), all of them
up to `max_labels`, then those of the smallest hashes; along features
that only speak against a document the score never rises. The trained trees are flattened
into numpy arrays of nodes, and a batch goes through all of them level by level.

Defined cases: a null text has no words and fails; with no labels of both kinds
the hard rules decide alone; labels of absent or null documents are
ignored, documents labelled both ways count once for each, and of rows that repeat a labelled
doc_id the one with the smallest features counts; a score of exactly 0.5 is kept; empty tables give no rows; repeated rows are
judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import TextBlock, blocks, mix64, text_blocks

MIN_WORDS = 50
#: Bound on the labelled documents that the trees learn from.
MAX_LABELS = 8_000
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:?!")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and which way the score may go along each: -1 never up, 0 free.
FEATURES = {"repeat_share": -1, "symbol_share": -1, "dup_line_share": -1, "upper_share": -1, "shout_share": -1, "digit_share": -1, "same_next_share": -1, "distinct_share": 0, "word_length": 0, "punctuation_share": 0, "line_length": 0, "long_word_share": -1}


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (columns BASE) and the features (columns FEATURES) of each text."""
    counts, features = [], []
    for i, j in blocks(texts):
        c, f = _block_statistics(texts[i:j])
        counts.append(c)
        features.append(f)
    return (np.concatenate(counts), np.concatenate(features)) if counts else (np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES))))


def _block_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    t, n = TextBlock(texts), len(texts)
    per = lambda docs: np.bincount(docs, minlength=n)
    n_words = per(t.word_doc)
    in_word = np.zeros(len(t.bytes) + 1, dtype=np.int8)
    in_word[t.word_start] += 1
    in_word[t.word_end] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).view(bool)
    word_chars = t.count_by_doc(in_word & (t.bytes & 0xC0 != 0x80))
    n_symbols = t.count_by_doc(_SYMBOLS[t.bytes])
    upper, digit = t.count_by_doc((t.bytes >= 65) & (t.bytes <= 90)), t.count_by_doc((t.bytes >= 48) & (t.bytes <= 57))
    letters = t.count_by_doc(((t.bytes | 32) >= 97) & ((t.bytes | 32) <= 122))
    punctuation = t.count_by_doc(_PUNCTUATION[t.bytes])
    shout = t.count_by_doc(t.bytes == 33)

    # Lines with a word that equal an earlier one of their document.
    line_end = np.flatnonzero(t.bytes == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
    words_before = np.searchsorted(t.word_start, np.stack([line_start, line_end]))
    some = words_before[1] > words_before[0]
    line_start, line_end = line_start[some], line_end[some]
    line_doc = np.searchsorted(t.doc_end, line_start, side="left")
    line_key = mix64(t.range_hash(line_start, line_end) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n_lines = per(line_doc)
    n_dup_lines = n_lines - per(line_doc[np.unique(line_key, return_index=True)[1]])

    # Words in 3-word windows that are in the document twice or more.
    h, d = t.word_hashes(), t.word_doc
    repeated = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            key = mix64(mix64(mix64(h[:-2] + d[:-2].astype(np.uint64)) + h[1:-1]) + h[2:])
        inside = np.flatnonzero(d[:-2] == d[2:])
        _, which, times = np.unique(key[inside], return_inverse=True, return_counts=True)
        twice = inside[times[which] > 1]
        for k in (0, 1, 2):
            repeated[twice + k] = True
    n_repeat = per(d[repeated])
    with np.errstate(over="ignore"):
        own = h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n_distinct = per(d[np.unique(own, return_index=True)[1]])
    same_next = per(d[:-1][(h[:-1] == h[1:]) & (d[:-1] == d[1:])]) if len(h) else np.zeros(n, np.int64)
    long_words = per(d[t.word_end - t.word_start > 40])

    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack([n_repeat / words, n_symbols / words, n_dup_lines / np.maximum(n_lines, 1), upper / np.maximum(letters, 1), shout / words, digit / chars, same_next / words, n_distinct / words, word_chars / words, punctuation / words, np.minimum(n_words / np.maximum(n_lines, 1), 500), long_words / words], axis=1)
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], axis=1), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


# --- trees ------------------------------------------------------------------------------------------------------------

@dataclass
class Trees:
    """Complete binary trees of one depth. A node's children are 2i+1 and 2i+2; the last level holds the leaves' values."""

    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray  # tree, inner node; values up to it go left
    value: np.ndarray  # tree, leaf
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return total


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, min_rows: int = 5, ridge: float = 1.0) -> Trees:
    """Boosted trees on the logistic loss, by second-order gains over quantile bins.

    A split along a constrained feature must order its children's values; children inherit
    bounds around the midpoint of the two, so that the whole tree is monotone.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rate_of_good = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(rate_of_good / (1 - rate_of_good)))
    margin = np.full(len(x), bias)
    inner, leaves = 2**depth - 1, 2**depth
    trees = Trees(np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves)), bias)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), dtype=np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner):
            lo, hi = bounds[i]
            rows = np.flatnonzero(node == i)
            best = (1e-9, None)
            whole = _gain(g[rows].sum(), h[rows].sum(), ridge, lo, hi)[0]
            for f in range(x.shape[1]) if len(rows) >= 2 * min_rows else ():
                n = len(edges[f]) + 1
                gs, hs, cs = (np.cumsum(np.bincount(code[rows, f], w, n)) for w in (g[rows], h[rows], np.ones(len(rows))))
                left, right = _gain(gs[:-1], hs[:-1], ridge, lo, hi), _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1], ridge, lo, hi)
                gain = left[0] + right[0] - whole
                gain[(cs[:-1] < min_rows) | (cs[-1] - cs[:-1] < min_rows) | (monotone[f] * (right[1] - left[1]) < 0)] = 0
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (gain[k], (f, k, left[1][k], right[1][k]))
            if best[1] is None:
                bounds[2 * i + 1] = bounds[2 * i + 2] = (lo, hi)
                node[rows] = 2 * i + 1
                continue
            f, k, a, b = best[1]
            trees.feature[t, i], trees.threshold[t, i] = f, edges[f][k]
            middle = (a + b) / 2
            bounds[2 * i + 1] = (lo, middle) if monotone[f] > 0 else (middle, hi) if monotone[f] < 0 else (lo, hi)
            bounds[2 * i + 2] = (middle, hi) if monotone[f] > 0 else (lo, middle) if monotone[f] < 0 else (lo, hi)
            node[rows] = 2 * i + 1 + (code[rows, f] > k)
        for leaf in range(leaves):
            rows = np.flatnonzero(node == inner + leaf)
            lo, hi = bounds[inner + leaf]
            value = _gain(g[rows].sum(), h[rows].sum(), ridge, lo, hi)[1] if len(rows) else 0.0
            trees.value[t, leaf] = rate * value
        margin += trees.value[t][node - inner]
    return trees


def _gain(g, h, ridge: float, lo: float, hi: float):
    """Half the drop of the loss at the best value within the bounds, and that value."""
    w = np.clip(-g / (h + ridge), lo, hi)
    return -(g * w + 0.5 * (h + ridge) * w * w), w


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Trees | None:
    """Trees from labelled documents, or None without labels of both kinds."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)
    # At most max_labels rows of two numbers: they fit into any task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(2)):
                counts, features = statistics(texts)
                judged = ~base_failed(counts)
                keys = [batch.column(k).slice(i, j - i).filter(pa.array(judged)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(features[judged].tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    if len(found) == 0 or found["quality"].nunique() < 2:
        return None
    x, y = np.stack(found["x"].to_numpy()), found["quality"].to_numpy(dtype=float)
    order = np.lexsort((y, *x.T))  # the trees don't depend on the order in which rows came
    return train(x[order], y[order], np.array(list(FEATURES.values())))


def verdicts(texts: list[bytes], trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, kept and score of each text."""
    counts, features = statistics(texts)
    failed = base_failed(counts)
    score = 1 / (1 + np.exp(-trees.margin(features))) if trees else np.where(failed, 0.0, 1.0)
    return counts, failed, ~failed & (score >= 0.5), score


def judge(docs: DataFrame, labels: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, score for each row of docs."""
    model = trees or learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1)):
                counts, failed, kept, score = verdicts(texts, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(counts[:, k], pa.int64()) for k in range(len(BASE))], pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept; columns as they come."""
    model = learn(docs, labels)

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        # A few texts at a time, so that a batch isn't held twice.
        found = [verdicts([(x or "").encode() for x in text.iloc[i : i + 256]], model)[2] for i in range(0, len(text), 256)]
        return pd.Series(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(kept(F.col("text").cast("string")))
