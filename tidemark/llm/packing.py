"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents longer than a sequence are cut into full pieces and one rest, which comes
first; every other document is one piece. Only how many pieces have each
length matters for the packing, and lengths are at most `capacity`: so the
plan is made on the histogram of lengths (at most `capacity` numbers, whatever
the input) and holds bin types, i.e. lists of lengths, with counts. It starts from
best fit in decreasing order and is then improved by local search over underfull
bins: one document moves, one is exchanged for one, or two for one, each
raising the sum of squared fills, until bins are empty or no such step is left.
Steps act on all bins of a type at once.

Pieces then take the plan's slots by their rank among the pieces of their length. Ranks
come from counts by (length, salt) and a numbering within each such group; the number of
salts follows the commonest length's pieces, so that a length that a third of all pieces share is spread over all tasks.

Defined cases: null and empty texts are one piece with just the end token; repeated
rows are packed each; an empty table gives no rows; a piece of exactly `capacity` tokens
fills a sequence; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import TextBlock, cut, give_back, text_blocks

CAPACITY, END_ID = 1024, 2
#: Salts a length at least, and rows that share a length and a salt before there are more salts.
SALTS, SALT_ROWS = 256, 100_000
#: Words whose ids a worker remembers before it forgets them all.
CACHE_ENTRIES = 400_000


# --- tokens -----------------------------------------------------------------------------------------------------------

class ByteBPE:
    """Ids (little-endian uint32) of texts under a byte-level BPE tokenizer file.

    They are those of tokenizers.Tokenizer.from_file(path) with
    add_special_tokens=False and special tokens' strings as ordinary text. The
    vocabulary and merges come from that file. No merge crosses a single space with
    something else on either side, so words that begin there are encoded once, many in
    one call, and remembered by hash; a block of texts is then a gather.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        back = {ch: b for b, ch in _byte_alphabet().items()}
        special = {x["content"] for x in model.get("added_tokens", ())}
        ranks = {bytes(back[c] for c in tok): i for tok, i in model["model"]["vocab"].items() if tok not in special}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for tok, i in ranks.items():
            self._bytes_of[i] = len(tok)
        # A space before white space of any kind or at the end.
        self._crowded = re.compile(rb" (?:[\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
        self._forget()

    def _forget(self) -> None:
        self._hash, self._at, self._n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, dtype="<u4")

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self._encode(text.decode()), dtype="<u4")

    def _learn(self, hashes: np.ndarray, words: list[bytes], first: np.ndarray) -> None:
        """Remember the ids of words: of those that begin a text as they are, of the others behind a space.

        The latter are encoded in one call; where each ends shows in the bytes of the ids.
        """
        spaced = [w for w, f in zip(words, first.tolist(), strict=True) if not f]
        ids = self._whole(b" " + b" ".join(spaced)) if spaced else np.zeros(0, dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)) + 1)
        after = np.searchsorted(np.cumsum(self._bytes_of[ids]), ends) + 1
        alone = [self._whole(w) for w, f in zip(words, first.tolist(), strict=True) if f]
        n = np.zeros(len(words), np.int64)
        n[~first], n[first] = np.diff(after, prepend=0), [len(x) for x in alone]
        at = np.zeros(len(words), np.int64)
        at[~first] = after - n[~first]
        at[first] = len(ids) + np.cumsum(n[first]) - n[first]
        order = np.argsort(merged := np.concatenate([self._hash, hashes]), kind="stable")
        self._hash = merged[order]
        self._at = np.concatenate([self._at, at + len(self._ids)])[order]
        self._n = np.concatenate([self._n, n])[order]
        self._ids = np.concatenate([self._ids, ids, *alone])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        crowded = np.fromiter((self._crowded.search(t) is not None for t in texts), bool, len(texts))
        t = TextBlock([b"" if c else x for x, c in zip(texts, crowded.tolist(), strict=True)])
        spaces = np.flatnonzero(t.bytes == 32)
        start, end = np.sort(np.concatenate([t.doc_start, spaces + 1])), np.sort(np.concatenate([t.doc_end, spaces]))
        first_of_doc = np.searchsorted(start, t.doc_start)
        first = np.zeros(len(start), dtype=bool)
        first[first_of_doc] = True
        key = t.range_hash(start, end) ^ np.where(first, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        distinct, example, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self._hash) > CACHE_ENTRIES:
            self._forget()
        place = np.searchsorted(self._hash, distinct)
        new = np.flatnonzero(np.append(self._hash, np.uint64(0))[place] != distinct) if len(self._hash) else np.arange(len(distinct))
        if len(new):
            raw, at = t.bytes.tobytes(), example[new]
            words = [raw[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self._learn(distinct[new], words, first[at])
            place = np.searchsorted(self._hash, distinct)
        n = self._n[place][which]
        before = np.cumsum(n) - n
        ids = self._ids[np.repeat(self._at[place][which] - before, n) + np.arange(int(n.sum()))]
        ends = np.append(before[first_of_doc[1:]], len(ids)).tolist()
        out, at = [], 0
        for text, c, e in zip(texts, crowded.tolist(), ends, strict=True):
            out.append(self._whole(text) if c else ids[at:e])
            at = e
        return out


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids: the rest first, then full ones."""
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


_encoders: dict[str, ByteBPE] = {}


def _tokenise(tokenizer_path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = ByteBPE(tokenizer_path)
        encode, end = _encoders[tokenizer_path].encode, np.array([END_ID], dtype="<u4").tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, j, texts in text_blocks(batch.column(1)):
                out: list[tuple] = []
                for doc, ids in zip(docs[i:j], encode(texts), strict=True):
                    ids, at = ids.tobytes() + end, 0
                    for k, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                        part = ids[4 * at : 4 * (at + n)]
                        out.append((doc, k, at, n, zlib.crc32(part), *([part] if with_ids else [])))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids: binary, little-endian uint32)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(give_back(_tokenise(tokenizer_path, capacity, with_ids)), schema)


# --- the plan ---------------------------------------------------------------------------------------------------------

Bins = Counter[tuple[int, ...]]


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best fit in decreasing order, all bins with the same contents at once."""
    left, lengths = dict(histogram), sorted(n for n, c in histogram.items() if c)
    bins: Bins = Counter()
    while lengths:
        room, contents = capacity, []
        free = Counter()
        while room:
            # The longest piece that fits and is left, besides those in the bin already.
            i = bisect_left(lengths, room + 1) - 1
            while i >= 0 and left[lengths[i]] - free[lengths[i]] <= 0:
                i -= 1
            if i < 0:
                break
            n = lengths[i]
            k = min(room // n, left[n] - free[n])
            contents += [n] * k
            free[n] += k
            room -= n * k
        times = min(left[n] // k for n, k in free.items())
        for n, k in free.items():
            left[n] -= k * times
            if not left[n]:
                lengths.pop(bisect_left(lengths, n))
        bins[tuple(contents)] += times
    return bins


def _steps(a: tuple[int, ...], b: tuple[int, ...], room: int) -> tuple[int, tuple, tuple]:
    """The largest gain of b from a within room: words moved, pieces from a, pieces from b."""
    best: tuple[int, tuple, tuple] = (0, (), ())
    give = sorted(set(a))
    for x in give:
        if best[0] < x <= room:
            best = (x, (x,), ())
    back = sorted(set(b))
    for y in back:
        # One for one: the longest x up to y + room.
        i = bisect_left(give, y + room + 1) - 1
        if i >= 0 and give[i] - y > best[0]:
            best = (give[i] - y, (give[i],), (y,))
        if best[0] == room:
            break
        # Two for one, by two pointers from both ends.
        lo, hi = 0, len(give) - 1
        have = Counter(a)
        while lo <= hi:
            s = give[lo] + give[hi]
            if s > y + room:
                hi -= 1
                continue
            if s - y > best[0] and (lo != hi or have[give[lo]] > 1):
                best = (s - y, (give[lo], give[hi]), (y,))
            lo += 1
    return best


def local_search(bins: Bins, capacity: int) -> Bins:
    """Empties underfull bins into fuller ones until no step raises the sum of squared fills any more.

    Whether a donor gains from a taker depends on the two types alone, so a pair without gain is not tried again: a donor
    goes on with the types that came up since its last full scan.
    """
    bins = Counter({b: c for b, c in bins.items() if c})
    came: list[tuple[int, ...]] = []
    seen: dict[tuple[int, ...], int] = {}
    scanned: dict[tuple[int, ...], int] = {}
    barren: dict[tuple[int, ...], set[tuple[int, ...]]] = defaultdict(set)
    due: list[tuple[int, tuple[int, ...]]] = []
    fills: dict[tuple[int, ...], int] = {}

    def arrive(b: tuple[int, ...]) -> None:
        fills[b] = sum(b)
        if fills[b] < capacity:
            seen[b] = len(came)
            came.append(b)

    def change(b: tuple[int, ...], by: int) -> None:
        if not b:
            return
        was = bins[b]
        bins[b] += by
        if not bins[b]:
            del bins[b]
            seen.pop(b, None)
        elif not was or was < 2 <= bins[b]:
            arrive(b)

    for b in bins:
        arrive(b)
    while True:
        due = sorted((fills[b], b) for b in seen if scanned.get(b, 0) < len(came))
        progressed = False
        for fill, donor in due:
            while donor in seen and scanned.get(donor, 0) < len(came):
                end = len(came)
                takers = {b for b in came[scanned.get(donor, 0) :] if b in seen and fills[b] >= fill} - barren[donor]
                for taker in sorted(takers, key=lambda b: (fills[b], b), reverse=True):
                    if taker == donor and bins[donor] < 2:
                        continue
                    moved, out, back = _steps(donor, taker, capacity - fills[taker])
                    if not moved:
                        barren[donor].add(taker)
                        continue
                    times = bins[donor] // 2 if taker == donor else min(bins[donor], bins[taker])
                    new = [tuple(sorted((Counter(x) - Counter(y) + Counter(z)).elements(), reverse=True)) for x, y, z in ((donor, out, back), (taker, back, out))]
                    for b, by in ((donor, -times), (taker, -times), (new[0], times), (new[1], times)):
                        change(b, by)
                    progressed = True
                    break
                else:
                    scanned[donor] = end
            if progressed:
                break
        if not progressed:
            return bins


def plan_slots(bins: Bins) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length the runs (first rank, first sequence, offset, places a bin) in which its pieces lie."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    next_rank, sequence = Counter(), 0
    for b in sorted(bins, reverse=True):
        offset = 0
        for n, k in sorted(Counter(b).items(), reverse=True):
            runs[n].append((next_rank[n], sequence, offset, k))
            next_rank[n] += k * bins[b]
            offset += n * k
        sequence += bins[b]
    return runs


# --- pieces to slots --------------------------------------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, salts: int = SALTS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for each piece of docs."""
    spark = docs.sparkSession
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    cutted = cut(pieces(docs, tokenizer_path, capacity, with_ids).withColumn("salt", F.xxhash64("doc_id", "piece")))
    histogram = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    salts = max(salts, -(-max(histogram.values(), default=0) // SALT_ROWS))
    cutted = cutted.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int"))
    counts = cut(cutted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    runs = plan_slots(local_search(best_fit(histogram, capacity), capacity))
    names = ("first_rank", "first_sequence", "at", "each")
    table = [(n, *([r[i] for r in rs] for i in range(4))) for n, rs in runs.items()]
    slots = spark.createDataFrame(table, "slot_length long, first_rank array<long>, first_sequence array<long>, at array<long>, each array<long>")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = counts.select("length", "salt", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    # `slots` has a row a length, `capacity` at most, and as many runs as the plan has bin types and lengths in them.
    ranked = cutted.withColumn("inner", inner).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inner"))
    found = ranked.join(F.broadcast(slots), F.col("length") == F.col("slot_length"))
    # The last run that begins at the rank or before it: runs are in order of rank.
    run = F.aggregate("first_rank", F.lit(0), lambda acc, r: acc + F.when(r <= F.col("rank"), 1).otherwise(0))
    found = found.withColumn("run", run).select(*cols, *[F.element_at(c, F.col("run")).alias(c) for c in names], "rank")
    nth = F.col("rank") - F.col("first_rank")
    placed = {"sequence_id": F.col("first_sequence") + F.floor(nth / F.col("each")).cast("long"), "offset": F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")}
    return found.select(*cols[:5], *[c.alias(k) for k, c in placed.items()], *cols[5:])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: each sequence's ids from a packing made with with_ids=True."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return parts.select("sequence_id", whole.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
