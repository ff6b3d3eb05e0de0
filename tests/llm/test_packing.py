import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as P
from tidemark.llm.queries import tokenizer_path


def test_ids_are_the_tokenizers(spark):
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \n b", "x\u00a0 y", "x \u00a0y", "x\u3000 y \u2003z", "<|endoftext|> it's 've 12 3", "é\t\tè  ", "☃☃ 𝒳"]
    got = [x.tolist() for x in P.ByteBPE(tokenizer_path()).encode([x.encode() for x in texts])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" ab\n\t'é1.☃\u00a0", max_size=20), max_size=6))
def test_ids_of_odd_texts(texts):
    t = Tokenizer.from_file(tokenizer_path())
    assert [x.tolist() for x in P.ByteBPE(tokenizer_path()).encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), max_size=12))
def test_plan_is_whole(histogram):
    first = P.best_fit(histogram, 32)
    bins = P.local_search(first, 32)
    held = Counter()
    for b, c in bins.items():
        assert sum(b) <= 32 and c > 0
        for n in b:
            held[n] += c
    assert held == Counter(histogram)
    fill = lambda bs: sum(c * sum(b) ** 2 for b, c in bs.items())
    assert fill(bins) >= fill(first) and sum(bins.values()) <= sum(first.values())


def test_search_empties_bins():
    # Best fit needs four bins of 10; exchanging one for one makes three.
    start = Counter({(6, 3): 1, (5, 4): 1, (7,): 1, (3, 2): 1})
    assert sum(P.local_search(start, 10).values()) == 3


def test_search_converges():
    """Thousands of bin types, and no step is left between any two underfull ones."""
    lengths = np.maximum(np.exp(np.random.default_rng(1).normal(np.log(300), 1, 300_000)).astype(int), 1)
    histogram = Counter((lengths[lengths % 1024 > 0] % 1024).tolist())
    bins = P.local_search(P.best_fit(histogram, 1024), 1024)
    held = Counter()
    for b, c in bins.items():
        for n in b:
            held[n] += c
    assert held == histogram
    underfull = [b for b in bins if sum(b) < 1024]
    for a in underfull:
        for b in underfull:
            if sum(a) <= sum(b) and (a != b or bins[a] > 1):
                assert not P._steps(a, b, 1024 - sum(b))[0]


def check(rows, packed, capacity=P.CAPACITY):
    encode = P.ByteBPE(tokenizer_path()).encode
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*encode([(text or "").encode()])[0].tolist(), P.END_ID]
        at = 0
        for k, n in enumerate(P.piece_lengths(len(ids), capacity)):
            want[doc, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
        assert at == len(ids)
    assert Counter(tuple(r)[:5] for r in packed) == want
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


def test_pack(spark, frame, odd_rows):
    docs = frame(odd_rows)
    bins = check(odd_rows, P.pack(docs, tokenizer_path()).collect())
    tokens = sum(r["length"] for r in P.pieces(docs, tokenizer_path()).collect())
    assert bins <= -(-tokens // P.CAPACITY) + 1
    packed = P.pack(docs, tokenizer_path(), 64, with_ids=True)
    check(odd_rows, packed.drop("ids").collect(), 64)
    for r in P.sequences(packed).limit(5).collect():
        assert len(r["ids"]) % 4 == 0 and len(r["ids"]) <= 256


def test_empty(spark, frame):
    assert P.pack(frame([]), tokenizer_path()).collect() == []
    with pytest.raises(FileNotFoundError):
        P.ByteBPE("/nowhere.json")
