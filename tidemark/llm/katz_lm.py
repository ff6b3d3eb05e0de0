"""Scoring by a Katz back-off bigram model with Good-Turing discounts, learned from the corpus.

Tokens are words (A-Z lower-cased) and one end a text. With c the counts of training tokens and pairs:

    P1(w)      = d1 * c(w) / N          if the word was seen; what these leave goes to the unknown word
    P(w | h)   = d2 * c(h, w) / c(h)    if the pair was seen
               = alpha(h) * P1(w)       else

A text's first token has P1. d1 and d2 are Good-Turing's for counts up to GT_MAX, from the corpus's counts of counts of words
and of pairs; where these give none between 0 and 1, and for greater counts, one in c + 1 is taken, so that every history leaves
something. alpha(h) is what d2 leaves over what P1 leaves to words unseen after h: all probabilities after h
add up to exactly 1, without a floor. All pairs seen are in the model.

How it runs. Word pairs of 100 TB are too many to send with every occurrence, so tasks read texts block by block and send packed
arrays: for each partition of the words one row with the block's pairs (history, word).

1. Words are counted (one row a distinct word and block).
2. Pairs are counted by their word's partition, where c(w) is known too, and kept as a table of packed rows, one a partition.
   From it come the counts of counts, and by a sum over histories the weights alpha: a table by history's partition.
3. Texts are read again, a slice of them at a time, and their pairs meet the table of pairs. As c(h) is also h's count as a word, each
   word subtracts its own log10 c where it stands. Pairs that were not seen back off: they get P1(w) there, and go on to the
   table of weights with their history, nobody else does. Sums return by block.

Words and pairs that make up over 1 in HOT of all tokens (at most HOT of each kind, a proven bound) are
known to every task; the pairs of a hot word are dealt by pair. So no partition is swamped by "the". The number of partitions
follows the corpus. Keys are 63-bit hashes of words and pairs.

Defined cases: null and empty texts are just the end; repeated rows are learned and scored each; with no training
text every token is unknown, with probability 1, and N is 0; empty tables give no rows; long texts are read whole (one is a block of its own); other columns,
of whatever name, are not read; a null doc_id is in the training fold. The tables of the last two steps stay in the checkpoint folder, as the result reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import TextBlock, drop, mix64, text_blocks, written

FOLDS, TEST_FOLD = 7, 2
GT_MAX = 5
HOT = 10_000
#: Bytes of text in a block; tokens for each partition of the words; tokens a task looks up at once; slices of the texts scored one after the other.
BLOCK, TOKENS_PER_PARTITION, CHUNK, SLICES = 2 << 20, 2_000_000, 1 << 18, 2
_MASK = np.uint64((1 << 63) - 1)
_END, _START = np.uint64(0x1D2C3B4A59687706), np.uint64(0x2B7E151628AED2A6)
PAIRS, DOCS, SUMS, BACK = 0, 1, 2, 3


# --- tokens -----------------------------------------------------------------------------------------------------------

def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased texts' tokens, ends included, and each one's text."""
    t = TextBlock([x.lower() for x in texts])
    n = len(t.word_start) + len(texts)
    tok, doc = np.full(n, _END, dtype=np.uint64), np.zeros(n, np.int64)
    at = np.arange(len(t.word_start)) + t.word_doc
    tok[at] = t.word_hashes() & _MASK
    t.forget_hashes()
    ends = np.searchsorted(t.word_doc, np.arange(len(texts)), side="right") + np.arange(len(texts))
    doc[at], doc[ends] = t.word_doc, np.arange(len(texts))
    return tok, doc


def histories(tok: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The token before each; _START before a text's first."""
    h = np.append(_START, tok[:-1])
    h[1:][doc[1:] != doc[:-1]] = _START
    return h


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(h) + w) & _MASK


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal values begin, and how many there are."""
    begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(sorted_)))


class _Hot:
    """Values of a few hot keys, looked up by search."""

    def __init__(self, keys: list[int], **values: list[float]):
        order = np.argsort(np.array(keys, dtype=np.uint64))
        self.keys = np.array(keys, dtype=np.uint64)[order]
        self.values = {k: np.array(v, dtype=float)[order] for k, v in values.items()}

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each x is hot, and its place if so."""
        if not len(self.keys):
            return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return self.keys[at] == x, at


def _find(sorted_: np.ndarray, x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each x among sorted keys, 0 where it isn't one."""
    if not len(sorted_):
        return np.zeros(len(x), values.dtype)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, values[at], values.dtype.type(0))


# --- the model's numbers ----------------------------------------------------------------------------------------------

def good_turing(n_r: dict[int, int]) -> dict[int, float]:
    """Discounts of counts 1 to GT_MAX; one in r + 1 is taken where the counts of counts are too thin to tell."""
    n = lambda r: float(n_r.get(r, 0))
    out = {}
    for r in range(1, GT_MAX + 1):
        d = 1.0
        if n(1) > 0 and n(r) > 0:
            common = (GT_MAX + 1) * n(GT_MAX + 1) / n(1)
            d = ((r + 1) * n(r + 1) / (r * n(r)) - common) / (1 - common) if common != 1 else 1.0
        out[r] = d if 0.0 < d < 1.0 else r / (r + 1)
    return out


def discounted(c: np.ndarray, discounts: dict[int, float]) -> np.ndarray:
    """d * c of each count; 0 for 0."""
    c = c.astype(float)
    small = np.array([0.0, *(discounts[r] for r in range(1, GT_MAX + 1))])
    return np.where(c <= GT_MAX, small[np.minimum(c, GT_MAX).astype(np.int64)], c / (c + 1)) * c


class _Words:
    """What all tasks know of words: discounts, hot counts, and the unknown word's probability."""

    def __init__(self, hot: _Hot, discounts: dict[int, float], n: int, mass: int, unknown: float):
        self.hot, self.discounts, self.n, self.mass, self.unknown = hot, discounts, n, mass, unknown

    def counts(self, w: np.ndarray, own: np.ndarray) -> np.ndarray:
        """c(w): the hot word's, else what the partition counted itself."""
        is_hot, place = self.hot.find(w)
        return np.where(is_hot, self.hot.values["c"][place] if len(self.hot.keys) else 0, own).astype(np.int64)

    def p1(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.discounts) / max(self.n, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / self.mass)


# --- the tasks --------------------------------------------------------------------------------------------------------

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in text_blocks(batch.column(0), BLOCK):
            keys, n = np.unique(tokens(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])


def _parts(h: np.ndarray, w: np.ndarray, hot: _Hot, partitions: int) -> np.ndarray:
    """A word's pairs are together, unless it is hot."""
    return (np.where(hot.find(w)[0], pair_key(h, w), w) % np.uint64(partitions)).astype(np.int32)


def _packed_pairs(part: np.ndarray, w: np.ndarray, h: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
    """part, words, pairs a word, histories and last of rows sorted by part and word."""
    first, sizes = _runs(part)
    for a, size in zip(first.tolist(), sizes.tolist(), strict=True):
        b = a + size
        begins, lengths = _runs(w[a:b])
        yield int(part[a]), w[a:b][begins].tobytes(), lengths.astype(np.uint32).tobytes(), h[a:b].tobytes(), last[a:b].tobytes()


def _send_pairs(partitions: int, hot: _Hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0), BLOCK):
                w, doc = tokens(texts)
                h = histories(w, doc)
                part = _parts(h, w, hot, partitions)
                order = np.lexsort((h, w, part))
                h, w, part = h[order], w[order], part[order]
                begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
                n = np.diff(np.append(begin, len(h))).astype(np.uint32)
                rows = list(_packed_pairs(part[begin], w[begin], h[begin], n))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(5)], names=["part", "w", "runs", "h", "n"])

    return run


def _unpack(w: bytes, runs: bytes, h: bytes, last: bytes, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(w, np.uint64), np.frombuffer(runs, np.uint32)), np.frombuffer(h, np.uint64), np.frombuffer(last, kind)


_COUNTED = "part int, w binary, runs binary, h binary, c binary, n_r array<long>"


def _count_pairs(table: pa.Table) -> pa.Table:
    """Packed rows of one partition to one row of its pairs and their counts, and its counts of counts."""
    rows = [_unpack(*(table.column(k)[i].as_py() for k in ("w", "runs", "h", "n")), np.uint32) for i in range(table.num_rows)]
    w, h, n = (np.concatenate([r[k] for r in rows]) for k in range(3))
    del rows
    order = np.lexsort((h, w))
    w, h, n = w[order], h[order], n[order]
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
    c = np.add.reduceat(n.astype(np.int64), begin)
    w, h = w[begin], h[begin]
    n_r = np.bincount(np.minimum(c[h != _START], GT_MAX + 2), minlength=GT_MAX + 3)[: GT_MAX + 2]
    ((part, *packed),) = _packed_pairs(np.zeros(len(w), np.int32), w, h, c.astype(np.uint32))
    columns = [table.column("part")[:1].combine_chunks(), *(pa.array([x], pa.binary()) for x in packed), pa.array([n_r.tolist()], pa.list_(pa.int64()))]
    return pa.table(dict(zip(("part", "w", "runs", "h", "c", "n_r"), columns, strict=True)))


def _own_counts(runs: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How often each word of a partition stands there: its pairs' counts."""
    return np.add.reduceat(c.astype(np.int64), np.cumsum(runs, dtype=np.int64) - runs) if len(runs) else np.zeros(0, np.int64)


def _history_sums(words: _Words, discounts: dict[int, float]):
    """Rows of counted pairs to sums by history: what its pairs keep and have, and the P1 of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, runs, h, c = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in enumerate((np.uint64, np.uint32, np.uint64, np.uint32)))
                p1 = np.repeat(words.p1(words.counts(w, _own_counts(runs, c))), runs)
                some = np.flatnonzero(h != _START)
                some = some[np.argsort(h[some])]
                h, c, p1 = h[some], c[some], p1[some]
                begin, _ = _runs(h)
                add = lambda x: np.add.reduceat(x, begin) if len(begin) else x
                yield pa.RecordBatch.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(add(discounted(c, discounts))), pa.array(add(c.astype(np.int64))), pa.array(add(p1))], names=["h", "kept", "total", "lower"])

    return run


def _hot_pairs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h, c = _unpack(*(batch.column(k)[i].as_py() for k in range(4)), np.uint32)
                at = np.flatnonzero(c >= least)
                yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)) for x in (w, h)] + [pa.array(c[at].astype(np.int64))], names=["w", "h", "c"])

    return run


_SENT = "part int, kind int, block long, w binary, runs binary, h binary, docs binary"


def _send_texts(partitions: int, words: _Words, hot_pairs: _Hot):
    """For each block and partition the pairs that occur and their documents; and a row for the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_blocks = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i0, j0, held in text_blocks(batch.column(2), BLOCK):
                for i in range(i0, j0, 1 << 16):
                    j = min(j0, i + (1 << 16))
                    block, n_blocks, m = (task << 32) + n_blocks, n_blocks + 1, j - i
                    w, doc = tokens(held[i - i0 : j - i0])
                    h = histories(w, doc)
                    sums = np.zeros((4, m))  # tokens, base, score, known
                    sums[0] = np.bincount(doc, minlength=m)
                    is_hot, place = hot_pairs.find(pair_key(h, w))
                    if is_hot.any():
                        c = words.counts(w[is_hot], np.zeros(int(is_hot.sum())))
                        for k, x in ((1, words.base(c)), (2, hot_pairs.values["score"][place[is_hot]]), (3, c > 0)):
                            sums[k] = np.bincount(doc[is_hot], x, m)
                        w, h, doc = w[~is_hot], h[~is_hot], doc[~is_hot]
                    part = _parts(h, w, words.hot, partitions)
                    order = np.lexsort((w, part))
                    rows = [(p, PAIRS, block, *packed) for p, *packed in _packed_pairs(part[order], w[order], h[order], doc[order].astype(np.uint16))]
                    ids, folds = batch.column(0).slice(i, m), batch.column(1).slice(i, m)
                    flags = np.stack([np.array(ids.is_null()), np.array(folds)]).astype(np.uint8)
                    rows.append((block % partitions, DOCS, block, np.array(ids.fill_null(0)).astype(np.int64).tobytes(), flags.tobytes(), sums.tobytes(), b""))
                    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["part", "kind", "block", "w", "runs", "h", "docs"])

    return run


def _seen_scores(w: np.ndarray, c_w: np.ndarray, c: np.ndarray, discounts: dict[int, float]) -> np.ndarray:
    """What seen pairs add: log10(d * c), and what every word but the end subtracts as the next one's history."""
    out = np.zeros(len(c))
    np.log10(discounted(c, discounts), out=out, where=c > 0)
    after = (w != _END) & (c_w > 0)
    out[after] -= np.log10(c_w[after])
    return out


_FOUND = "kind int, part int, block long, a binary, b binary, c binary"


def _found(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(("kind", "part", "block", "a", "b", "c"), types, strict=True))})


def _sums_by_doc(rows: list[int], docs: list[np.ndarray], values: list[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
    """For each row its documents and the sums of each of values over them; docs: one array a row, values over all of them."""
    sizes = np.array([int(d.max()) + 1 for d in docs])
    at = np.repeat(np.cumsum(sizes) - sizes, [len(d) for d in docs]) + np.concatenate(docs)
    total = int(sizes.sum())
    n = np.bincount(at, minlength=total)
    sums = [np.bincount(at, x, total) for x in values]
    for begin, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        some = np.flatnonzero(n[begin : begin + size])
        yield some.astype(np.uint16).tobytes(), np.stack([x[begin + some] for x in sums]).tobytes()


def _look_up(partitions: int, words: _Words, discounts: dict[int, float], hot_back: _Hot):
    """Sent pairs and the counted pairs of one partition to sums by document, and pairs that back off at their history's partition."""

    def run(sent: pa.Table, known: pa.Table) -> pa.Table:
        key, count, word, own = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for i in range(known.num_rows):  # one row at most
            word, runs, h, c = (np.frombuffer(known.column(k)[i].as_py(), t) for k, t in (("w", np.uint64), ("runs", np.uint32), ("h", np.uint64), ("c", np.uint32)))
            key, count, own = pair_key(h, np.repeat(word, runs)), c.astype(np.int64), _own_counts(runs, c)
            order = np.argsort(key)
            key, count = key[order], count[order]
        out: list[tuple] = []
        held: list[tuple] = []
        kinds, blocks_ = sent.column("kind").to_pylist(), sent.column("block").to_pylist()
        size = 0
        for i, kind in enumerate(kinds):
            a, b, c, d = (sent.column(k)[i].as_py() for k in ("w", "runs", "h", "docs"))
            if kind == DOCS:
                out.append((DOCS, 0, blocks_[i], a, b, c))
                continue
            held.append((blocks_[i], *_unpack(a, b, c, d, np.uint16)))
            size += len(held[-1][1])
            if size >= CHUNK:
                out += chunk(held, key, count, word, own)
                held, size = [], 0
        if held:
            out += chunk(held, key, count, word, own)
        return _found(out)

    def chunk(held: list[tuple], key, count, word, own) -> list[tuple]:
        rows, docs = [r[0] for r in held], [r[3] for r in held]
        w, h = (np.concatenate([r[k] for r in held]) for k in (1, 2))
        c_w = words.counts(w, _find(word, w, own))
        first = h == _START
        c = np.where(first, 0, _find(key, pair_key(h, w), count))
        score = _seen_scores(w, c_w, c, discounts)
        off = c == 0
        score[off] += np.log10(words.p1(c_w[off]))
        back = off & ~first
        is_hot, place = hot_back.find(h)
        near = np.flatnonzero(back & is_hot)
        if len(near):
            score[near] += hot_back.values["back"][place[near]]
        out = [(SUMS, 0, block, d, s, None) for block, (d, s) in zip(rows, _sums_by_doc(rows, docs, [words.base(c_w), score, (c_w > 0).astype(float)]), strict=True)]
        far = np.flatnonzero(back & ~is_hot)
        if len(far):
            row = np.repeat(np.arange(len(rows)), [len(d) for d in docs])[far]
            part, h, doc = (h[far] % np.uint64(partitions)).astype(np.int64), h[far], np.concatenate(docs)[far]
            order = np.lexsort((row, part))
            part, row, h, doc = part[order], row[order], h[order], doc[order]
            begin, sizes = _runs(part)
            for a, n in zip(begin.tolist(), sizes.tolist(), strict=True):
                of, runs = _runs(row[a : a + n])
                blocks_ = np.array(rows, np.int64)[row[a : a + n][of]]
                out.append((BACK, int(part[a]), 0, h[a : a + n].tobytes(), doc[a : a + n].tobytes(), blocks_.tobytes() + runs.astype(np.int64).tobytes()))
        return out

    return run


def _back_off(sent: pa.Table, known: pa.Table) -> pa.Table:
    """Pairs that back off and the weights of one partition of histories to sums by document."""
    keys = [np.frombuffer(x, np.uint64) for x in known.column("keys").to_pylist()]
    values = [np.frombuffer(x, np.float64) for x in known.column("back").to_pylist()]
    key, value = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (values, np.float64)))
    order = np.argsort(key)
    key, value = key[order], value[order]
    h, doc, block = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for a, b, c in zip(*(sent.column(k).to_pylist() for k in ("a", "b", "c")), strict=True):
        h.append(np.frombuffer(a, np.uint64))
        doc.append(np.frombuffer(b, np.uint16))
        block.append(np.repeat(*np.frombuffer(c, np.int64).reshape(2, -1)))
    h, doc, block = np.concatenate(h), np.concatenate(doc), np.concatenate(block)
    order = np.argsort(block, kind="stable")
    h, doc, block = h[order], doc[order], block[order]
    begin, sizes = _runs(block)
    if not len(begin):
        return _found([])
    weight, none = _find(key, h, value), np.zeros(len(h))
    rows = block[begin].tolist()
    return _found([(SUMS, 0, b, d, x, None) for b, (d, x) in zip(rows, _sums_by_doc(rows, np.split(doc, begin[1:]), [none, weight, none]), strict=True)])


_DOCUMENTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sum_up(table: pa.Table) -> pa.Table:
    """All rows of a block to a row a document."""
    kinds = np.array(table.column("kind"))
    at = int(np.flatnonzero(kinds == DOCS)[0])
    ids = np.frombuffer(table.column("a")[at].as_py(), np.int64)
    flags = np.frombuffer(table.column("b")[at].as_py(), np.uint8).reshape(2, len(ids))
    n, *sums = np.frombuffer(table.column("c")[at].as_py(), np.float64).reshape(4, len(ids)).copy()
    for i in np.flatnonzero(kinds == SUMS).tolist():
        docs = np.frombuffer(table.column("a")[i].as_py(), np.uint16)
        for total, x in zip(sums, np.frombuffer(table.column("b")[i].as_py(), np.float64).reshape(3, len(docs)), strict=True):
            total[docs] += x
    return pa.table({
        "doc_id": pa.array(ids, mask=flags[0] == 1), "held_out": pa.array(flags[1] == 1), "n_tokens": pa.array(n.astype(np.int64)),
        "n_known": pa.array(np.round(sums[2]).astype(np.int64)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
    })


# --- the whole --------------------------------------------------------------------------------------------------------

def _packed_weights(weights: DataFrame, partitions: int) -> DataFrame:
    """part, keys, back: histories and their weights as arrays, some for each task and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = np.array(batch.column(0)).view(np.uint64), np.array(batch.column(1))
            part = keys % np.uint64(partitions)
            order = np.argsort(part, kind="stable")
            first, sizes = _runs(part[order])
            at = [order[a : a + n] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[x[0]]) for x in at], pa.int32()), pa.array([keys[x].tobytes() for x in at], pa.binary()), pa.array([values[x].tobytes() for x in at], pa.binary())], names=["part", "keys", "back"])

    return weights.select("h", "back").mapInArrow(run, "part int, keys binary, back binary")


def _kept(c, discounts: dict[int, float]):
    """d * c of a column of counts."""
    out = c / (c + 1)
    for r, d in discounts.items():
        out = F.when(c == r, F.lit(d)).otherwise(out)
    return out * c


def score(docs: DataFrame, folds: int = FOLDS, test_fold: int = TEST_FOLD, slices: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark: SparkSession = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == test_fold, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    training = rows.where("not held_out").select("text")

    # 1. Words.
    words = written(training.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("c")), "katz-words")
    c = F.col("c")
    about = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), *[F.count(F.when(c == r, 1)).alias(f"n{r}") for r in range(1, GT_MAX + 2)]).first()
    n_tokens, mass = about["n"], about["n"] + about["v"] + 1
    of_words = good_turing({r: about[f"n{r}"] for r in range(1, GT_MAX + 2)})
    seen = words.agg(F.sum(_kept(c, of_words))).first()[0]
    partitions = max(1, math.ceil(max(n_tokens, 1) / TOKENS_PER_PARTITION))
    least_hot = max(2, n_tokens // HOT + 1)
    hot = words.where(c >= least_hot).collect()  # fewer than HOT rows: their counts add up to N at most
    know = _Words(_Hot([r["key"] for r in hot], c=[r["c"] for r in hot]), of_words, n_tokens, mass, 1 - seen / n_tokens if n_tokens else 1.0)
    drop(words)

    # 2. Pairs and the weights of their histories.
    sent = training.mapInArrow(_send_pairs(partitions, know.hot), "part int, w binary, runs binary, h binary, n binary")
    counted = written(sent.groupBy("part").applyInArrow(_count_pairs, _COUNTED), "katz-pairs")
    n_r = {r["r"]: r["n"] for r in counted.select(F.posexplode("n_r").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()}
    of_pairs = good_turing(n_r)
    table = counted.select("w", "runs", "h", "c")
    sums = table.mapInArrow(_history_sums(know, of_pairs), "h long, kept double, total long, lower double").groupBy("h").agg(*[F.sum(k).alias(k) for k in ("kept", "total", "lower")])
    # What a pair that backs off adds: its history's weight, and c(h), which the history itself has subtracted.
    weights = written(sums.select("h", F.log10(F.col("total") * (1 - F.col("kept") / F.col("total")) / (1 - F.col("lower"))).alias("back")), "katz-weights")
    hot_words = F.broadcast(spark.createDataFrame([(r["key"],) for r in hot], "h long"))  # fewer than HOT rows
    hot_back = weights.join(hot_words, "h").collect()
    hot_back = _Hot([r["h"] for r in hot_back], back=[r["back"] for r in hot_back])
    pairs = table.mapInArrow(_hot_pairs(least_hot), "w long, h long, c long").collect()  # fewer than HOT rows, likewise
    w, h, n = (np.array([r[k] for r in pairs], np.int64) for k in ("w", "h", "c"))
    w, h = w.view(np.uint64), h.view(np.uint64)
    c_w, first = know.counts(w, np.zeros(len(w))), h == _START
    pair_score = _seen_scores(w, c_w, np.where(first, 0, n), of_pairs) + np.where(first, np.log10(know.p1(c_w)), 0.0)
    hot_pairs = _Hot(pair_key(h, w).tolist(), score=pair_score.tolist())

    # 3. Texts meet the tables, slice by slice.
    found, slices = [], slices or SLICES
    for k in range(slices):
        some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k)
        texts = some.mapInArrow(_send_texts(partitions, know, hot_pairs), _SENT)
        found.append(written(texts.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(_look_up(partitions, know, of_pairs, hot_back), _FOUND), "katz-sums"))
    drop(counted)
    out = []
    for one in found:
        back = one.where(F.col("kind") == BACK).groupBy("part").cogroup(_packed_weights(weights, partitions).groupBy("part")).applyInArrow(_back_off, _FOUND)
        out.append(one.where(F.col("kind") != BACK).unionByName(back).groupBy("block").applyInArrow(_sum_up, _DOCUMENTS))
    scores = out[0]
    for one in out[1:]:
        scores = scores.unionByName(one)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
