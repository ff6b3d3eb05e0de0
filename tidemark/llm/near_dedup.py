"""Near-duplicates by min-max hashing: each permutation gives a minimum and a maximum.

A document's set is its distinct 5-word shingles (A-Z lower-cased). Under each of HASHES permutations of the
shingles' hashes both the least and the greatest value are kept: twice the signature for each
evaluation, and both are unbiased for the Jaccard index. Signatures
are cut into bands of ROWS values; documents that share a band are candidates.

* Documents with equal sets form a class; only its smallest doc_id goes on.
* A bucket (one band's value) of up to SMALL members gives all its pairs, each at the first band
  where the two share such a small bucket. A larger one gives the pairs with its centre, the member that meets most
  others in all its buckets.
* Links are confirmed on the full sets, components found by alternating star contractions.
* Members of large buckets that are still in several components are compared by what sets them apart from their centre (see
  `across_components`), so that no candidate link is missed, and components are found anew.

Pairs of small buckets whose signatures agree in too few places are not confirmed (`screen`): that is over SIGMAS standard
deviations below the threshold. At 0.85 two documents share no band with a probability of (1 - 0.85^4)^32 = 5e-11, at 0.8 of 5e-8.

The graph's nodes are classes, not doc_ids: a node's id is its class's smallest doc_id, or a number of its own where a doc_id that
repeats with another text is the smallest of several classes.

Tasks hold a block of texts or a batch of signatures; sets are compared on the JVM, row by row, and a centre or document that many
rows meet is dealt over several tasks (`join_hot`).

Defined cases: null and empty texts have no shingle and no link, each its own component;
texts of fewer than 5 words are one shingle; rows without doc_id are left out of
groups, and `near_dedup` keeps them; repeated rows are in one class, and `near_dedup` keeps one of them; rows that repeat a doc_id
with another text are nodes of their own; empty tables give no rows; long texts are read whole; other columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import TextBlock, cut, drop, give_back, join_hot, mix64, text_blocks

WORDS, THRESHOLD = 5, 0.8
HASHES, ROWS = 64, 4
VALUES = 2 * HASHES
BANDS = VALUES // ROWS
SMALL, SIGMAS = 8, 6.3
#: A member is far from a centre below this agreement; bound on the probability to lose a pair by that.
FAR, MISSED = 0.4, 5e-7
#: Longest list of ids to broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Bytes of text that a task works on at once.
BLOCK = 1 << 20
_FACTORS = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)


# --- sets and signatures ----------------------------------------------------------------------------------------------

def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of lower-cased texts, sorted by text and hash, and each one's text."""
    t = TextBlock(texts)
    h, d = t.word_hashes(), t.word_doc
    key, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= WORDS:
        inside = np.flatnonzero(d[: -WORDS + 1] == d[WORDS - 1 :])
        key = mix64(h[inside])
        for k in range(1, WORDS):
            key = mix64(key + h[inside + k])
        doc = d[inside]
    n_words = np.bincount(d, minlength=len(texts))
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):
        first = np.searchsorted(d, short)
        own = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            more = n_words[short] > k
            own[more] = mix64(own[more] + h[first[more] + k])
        key, doc = np.concatenate([key, mix64(own + np.uint64(1))]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def signatures(key: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """VALUES 16-bit values for each set; begin: where sets begin in key."""
    out = np.empty((len(begin), VALUES), dtype=np.uint16)
    k32 = (key >> np.uint64(32)).astype(np.uint32)
    for i in range(HASHES):
        p = (k32 ^ _SHIFTS[i]) * _FACTORS[i]
        p ^= p >> np.uint32(15)
        out[:, 2 * i] = np.minimum.reduceat(p, begin) & np.uint32(0xFFFF)
        out[:, 2 * i + 1] = np.maximum.reduceat(p, begin) & np.uint32(0xFFFF)
    return out


def _classes_of(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's set; 0 for empty sets."""
    a, b = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(begin):
        some = doc[begin]
        with np.errstate(over="ignore"):
            a[some] = (mix64(np.add.reduceat(mix64(key ^ np.uint64(0x5851F42D4C957F2D)), begin)) + n[some].astype(np.uint64)).view(np.int64)
            b[some] = np.bitwise_xor.reduceat(mix64(key + np.uint64(0xA24BAED4963EE407)), begin).view(np.int64)
    return a, b


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, mark) to doc_id, mark, size, class and signature of the set."""
    for batch in batches:
        for i, j, texts in text_blocks(batch.column(1), BLOCK):
            key, doc = shingle_sets([x.lower() for x in texts])
            n = np.bincount(doc, minlength=j - i)
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            sigs: list[bytes | None] = [None] * (j - i)
            if len(begin):
                for s, row in zip(doc[begin].tolist(), signatures(key, begin), strict=True):
                    sigs[s] = row.tobytes()
            class_a, class_b = _classes_of(key, doc, n)
            columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n, pa.int64()), pa.array(class_a), pa.array(class_b), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "a", "b", "sig"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to the set's class and its sorted keys."""
    for batch in batches:
        for i, j, texts in text_blocks(batch.column(1), BLOCK):
            key, doc = shingle_sets([x.lower() for x in texts])
            class_a, class_b = _classes_of(key, doc, np.bincount(doc, minlength=j - i))
            ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(class_a), pa.array(class_b), keys], names=["id", "a", "b", "keys"])


# --- candidates -------------------------------------------------------------------------------------------------------

def screen(threshold: float) -> float:
    """The least agreement of signatures of a pair to be confirmed."""
    return threshold - SIGMAS * (threshold * (1 - threshold) / VALUES) ** 0.5


def far_bands(threshold: float) -> int:
    """In how many of its bands a member may be far from its centre and leave the stars of these (see `_near_stars`)."""
    miss = 1 - threshold**ROWS
    return next((k for k in range(4, 0, -1) if miss ** (BANDS - 2 * k) <= MISSED), 0)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _bucket_pairs(ids: np.ndarray, sigs: np.ndarray, large: np.ndarray, band: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a small bucket that share no earlier small one; large: bits of the bands where a member's bucket is large."""
    x, y = np.triu_indices(len(ids), 1)
    bands = (sigs[x] == sigs[y]).reshape(len(x), BANDS, ROWS).all(axis=2)
    bands &= (large[x][:, None] >> np.arange(BANDS)) & 1 == 0
    take = (np.argmax(bands, axis=1) == band) & ((sigs[x] == sigs[y]).mean(axis=1) >= least)
    return ids[x[take]], ids[y[take]]


def _small_buckets(least: float):
    """Rows (band, key, id, sig, large) sorted by (band, key) to candidate pairs; a bucket may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            band, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((key != key[-1]) | (band != band[-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            yield _pairs_of(rows.slice(0, at), least)
            held = rows.slice(at)
        if held is not None:
            yield _pairs_of(held, least)

    return run


def _pairs_of(rows: pa.RecordBatch, least: float) -> pa.RecordBatch:
    band, key, ids = (rows.column(k).to_numpy() for k in range(3))
    sigs = np.frombuffer(b"".join(rows.column(3).to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
    large = rows.column(4).to_numpy()
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (band[1:] != band[:-1]))) if len(key) else np.zeros(0, np.int64)
    found = [_bucket_pairs(ids[i:j], sigs[i:j], large[i:j], int(band[i]), least) for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=False)]
    x, y = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])


class _Corpus:
    """Texts by node: docs has (doc_id, text); nodes, if given, the (id, first, a, b) of nodes that aren't just their doc_id."""

    def __init__(self, docs: DataFrame, nodes: DataFrame | None):
        self.docs, self.nodes = docs, nodes

    def sets(self, ids: DataFrame) -> DataFrame:
        """id, keys: the shingle sets of the nodes with these ids."""
        wanted = cut(ids.select("id").distinct())
        # A list of ids goes to the texts while it is short, else they meet by a shuffle.
        few = wanted.count() <= BROADCAST_IDS
        if self.nodes is None:
            of = wanted.withColumn("first", F.col("id"))
        else:
            of = wanted.join(self.nodes.withColumnsRenamed({"a": "class_a", "b": "class_b"}), "id")
        texts = self.docs.join(F.broadcast(of) if few else of, self.docs["doc_id"] == of["first"])
        found = texts.select("id", "text").mapInArrow(give_back(_set_rows), "id long, a long, b long, keys array<long>")
        if self.nodes is not None:
            found = found.join(of, "id").where("a = class_a and b = class_b")
        return found.groupBy("id").agg(F.first("keys").alias("keys"))


def _bits(keys: Column) -> Column:
    """Which of 256 classes of keys (by their top byte) occur, as four 64-bit words."""
    start = F.struct(*[F.lit(0).cast("long").alias(f"s{k}") for k in range(4)])

    def step(acc: Column, x: Column) -> Column:
        word, bit = F.shiftrightunsigned(x, 62), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 56).bitwiseAND(63).cast("int"))
        return F.struct(*[F.when(word == k, acc[f"s{k}"].bitwiseOR(bit)).otherwise(acc[f"s{k}"]).alias(f"s{k}") for k in range(4)])

    return F.aggregate(keys, start, step)


def _stars(large: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, centre): the members of large buckets, each with the centre of its bucket.

    That is the member that meets most others over all its buckets, an original among its copies. Where
    it is missing from a bucket, the best of the bucket is a copy; its own best centre stands in.
    """
    meets = shared.groupBy("id").agg(F.sum("members").alias("meets"))
    best = lambda name: F.max_by("id", F.struct("meets", -F.col("id"))).alias(name)
    centres = cut(large.join(meets, "id").groupBy("band", "key").agg(best("first"), F.max("meets").alias("first_meets")))
    members = large.select("band", "key", "id").join(centres, ["band", "key"])
    own = cut(members.groupBy("id").agg(F.max_by("first", F.struct("first_meets", -F.col("first"))).alias("best")))
    step = lambda df, a, b: df.join(own.select(F.col("id").alias(a), F.col("best").alias(b)), a)
    centre_of = cut(step(step(centres.select("first").distinct(), "first", "second"), "second", "centre").select("first", "centre"))
    return members.join(centre_of, "first").where("id != centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("bands"))


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, centre, bands, sig, centre_sig) to the share of signature places that agree."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, VALUES) for k in (3, 4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((a == b).mean(axis=1) if len(a) else np.zeros(0))], names=["id", "centre", "bands", "agreement"])


def _near_stars(stars: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(id, centre) without members that are far from a centre and just share a passage with it.

    A linked pair shares each band with probability threshold^ROWS. Unless a member is far from its centre in over `far_bands` of its
    bands, it leaves the stars of these; else it stays. A pair so loses up to that many bands by either member, and its link shows in
    the others, small buckets or stars, but for a probability of (1 - threshold^ROWS)^(BANDS - 2 * far_bands): 2e-8 at 0.85, 4e-7 at 0.8.
    """
    both = join_hot(stars.join(sigs.select("id", "sig"), "id"), sigs.select(F.col("id").alias("centre"), F.col("sig").alias("centre_sig")), "centre", "id", stars)
    rows = both.select("id", "centre", "bands", "sig", "centre_sig").mapInArrow(give_back(_agreement), "id long, centre long, bands long, agreement double")
    least = min(FAR, screen(threshold))
    far = F.sum(F.when(F.col("agreement") < least, F.col("bands")).otherwise(0)).over(Window.partitionBy("id"))
    return rows.withColumn("far", far).where((F.col("agreement") >= least) | (F.col("far") > far_bands(threshold))).select("id", "centre")


def across_components(stars: DataFrame, found: DataFrame, corpus: _Corpus, threshold: float) -> DataFrame:
    """Candidate pairs (x, y) between different components among the members of the same stars (id, centre).

    With D the difference of a set from its centre's, two sets differ by |Di| + |Dj| - 2 |Di & Dj|; they are linked
    if that is at most t = (1 - s) / (1 + s) * (|i| + |j|). A member outside the centre's component ("minor") is itself
    farther than that from the centre, so a link of its needs |Di & Dj| >= (|Di| + |Dj| - t) / 2 > 0. By the prefix principle the two
    then share one of the first |D| - that + 1 elements of D in one order, and what copies add
    of their own, the rarest, comes first. So only members that share such an element meet.
    """
    comp = found.select(F.col("id").alias("of"), "component")
    members = stars.unionByName(stars.select(F.col("centre").alias("id"), "centre")).distinct()
    members = members.join(comp, F.col("id") == F.col("of"), "left").select("centre", "id", F.coalesce("component", "id").alias("comp"))
    members = members.join(comp, F.col("centre") == F.col("of"), "left").select("centre", "id", "comp", (F.col("comp") != F.coalesce("component", "centre")).alias("minor"))
    members = cut(members)
    torn = members.where("minor").select("centre").distinct()
    members = cut(members.join(torn, "centre", "left_semi"))
    sets = cut(corpus.sets(members))
    of_centre = sets.select(F.col("id").alias("centre"), F.col("keys").alias("centre_keys"))
    both = join_hot(members.join(sets, "id"), of_centre.join(members.select("centre").distinct(), "centre", "left_semi"), "centre", "id", members)
    # The difference from the centre's set: added keys first, then removed ones, each in the same order everywhere.
    diff = F.concat(F.array_except("keys", "centre_keys"), F.array_except("centre_keys", "keys"))
    rows = both.select("centre", "id", "comp", "minor", F.size("keys").alias("size"), F.size("centre_keys").alias("centre_size"), diff.alias("diff"))
    rows = cut(rows.withColumn("bits", _bits(F.col("diff"))).select("centre", "id", "comp", "minor", "size", "centre_size", "diff", "bits.*"))
    # Sizes of linked sets are within the threshold of each other, and within those of the star.
    sizes = rows.groupBy("centre").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    rows = rows.join(sizes, "centre")
    part = (1 - threshold) / (1 + threshold)
    n, size = F.size("diff"), F.col("size")
    t = F.floor(part * (size + F.least(F.col("most"), size / threshold)) + 1e-9)
    minor_n = F.floor(part * (F.greatest(F.col("least"), size * threshold) + F.col("centre_size")) + 1e-9) + 1
    as_minor = n - F.greatest(F.lit(1), n - t) + 1
    as_other = n - F.greatest(F.lit(1), F.ceil((n + minor_n - t) / 2)) + 1
    prefix = lambda length: F.explode(F.slice("diff", F.lit(1), F.greatest(length, F.lit(0)).cast("int")))
    side = lambda i, length: [F.col("id").alias(i), F.col("comp").alias(f"c{i}"), F.col("size").alias(f"n{i}"), *[F.col(f"s{k}").alias(f"{i}{k}") for k in range(4)], prefix(length).alias("e")]
    a, b = rows.where("minor").select("centre", *side("x", as_minor)).alias("a"), rows.select("centre", *side("y", as_other)).alias("b")
    # The differences themselves differ at least in as many keys as their classes do: what can't be a link doesn't leave the join.
    percent = round(100 * threshold)
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(4)), F.lit(0))
    may_link = (F.col("cx") != F.col("cy")) & (apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent))
    both = a.join(b, (F.col("a.centre") == F.col("b.centre")) & (F.col("a.e") == F.col("b.e")) & may_link)
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def confirmed(pairs: DataFrame, corpus: _Corpus, threshold: float) -> DataFrame:
    """The pairs (x, y) whose full shingle sets have at least that Jaccard index."""
    sets = cut(corpus.sets(pairs.select(F.explode(F.array("x", "y")).alias("id"))))
    a, b = sets.select(F.col("id").alias("x"), F.col("keys").alias("xs")), sets.select(F.col("id").alias("y"), F.col("keys").alias("ys"))
    percent, nx, ny = round(100 * threshold), F.size("xs"), F.size("ys")
    rows = join_hot(join_hot(pairs, a, "x", "y"), b, "y", "x", pairs).where(100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
    both = F.size(F.array_intersect("xs", "ys"))
    return rows.select("x", "y", both.alias("both"), (nx + ny).alias("n")).where((F.col("both") > 0) & (100 * F.col("both") >= percent * (F.col("n") - F.col("both")))).select("x", "y")


# --- components -------------------------------------------------------------------------------------------------------

def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """id, component (its smallest id) of each id in links (x, y), by alternating large and small stars."""
    edges = cut(links.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    for _ in range(max_rounds):
        # Done when edges are stars: no end of one is the start of another, and none starts two.
        ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("starts"), F.lit(0).alias("ended")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("starts"), F.lit(1).alias("ended")))
        ends = ends.groupBy("k").agg(F.sum("starts").alias("starts"), F.max("ended").alias("ended"))
        if ends.where("starts > 1 or (starts = 1 and ended = 1)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        # Large star: each node's greater neighbours go to its least neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node and its lesser neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, cut(small)
        drop(before)
    raise RuntimeError("components did not settle")


def _nodes(classes: DataFrame) -> tuple[DataFrame, bool]:
    """classes (n_shingles, a, b, first, sig) with a node id each, and whether some ids aren't just `first`."""
    plain = classes.withColumn("id", F.col("first"))
    many = cut(classes.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first"))
    if many.isEmpty():
        return plain, False
    # Of the classes that share their smallest doc_id the first keeps it; the others get numbers outside the range of doc_ids.
    ends = classes.agg(F.min("first").alias("low"), F.max("first").alias("high")).first()
    if ends["high"] >= 1 << 62 and ends["low"] <= -(1 << 62):
        raise ValueError("doc_ids leave no room for numbers of their own")
    nth = F.row_number().over(Window.partitionBy("first").orderBy("n_shingles", "a", "b"))
    ranked = cut(classes.join(many, "first", "left_semi").withColumn("nth", nth))
    more = F.monotonically_increasing_id()  # on a written copy, so that it doesn't change
    own = F.lit(ends["high"]) + 1 + more if ends["high"] < 1 << 62 else F.lit(ends["low"]) - 1 - more
    ranked = cut(ranked.withColumn("id", F.when(F.col("nth") == 1, F.col("first")).otherwise(own)).select(plain.columns))
    return cut(plain.join(many, "first", "left_anti").select(plain.columns).unionByName(ranked)), True


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, mark, n_shingles, node (the component's; null without one), component_id for each row of docs; mark: a hash of the text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    signed = cut(rows.mapInArrow(give_back(_signed_rows), "doc_id long, mark long, n_shingles long, a long, b long, sig binary"))
    # One node for each class of equal sets; null ids and empty sets are in none.
    in_class = signed.where("n_shingles > 0 and doc_id is not null")
    nodes, renamed = _nodes(cut(in_class.groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("first"), F.first("sig").alias("sig"))))
    corpus = _Corpus(rows.select("doc_id", "text"), nodes.select("id", "first", "a", "b") if renamed else None)
    firsts = nodes.select("id", "sig")
    # A band's value is its 8 * ROWS bits of bytes; only what shares a bucket meets its signature again.
    part = [F.struct(F.lit(k).alias("band"), F.xxhash64(F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)).alias("key")) for k in range(BANDS)]
    keys = firsts.select("id", F.explode(F.array(*part)).alias("at")).select("at.band", "at.key", "id")
    members = cut(keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    shared = cut(keys.join(members, ["band", "key"]))
    large = shared.where(F.col("members") > SMALL).groupBy("id").agg(F.expr("bit_or(shiftleft(1L, band))").alias("large"))
    small = shared.where(F.col("members") <= SMALL).join(firsts, "id").join(large, "id", "left").select("band", "key", "id", "sig", F.coalesce("large", F.lit(0).cast("long")).alias("large"))
    small = small.repartition("band", "key").sortWithinPartitions("band", "key", "id").mapInArrow(give_back(_small_buckets(screen(threshold))), "x long, y long")
    stars = cut(_near_stars(cut(_stars(shared.where(F.col("members") > SMALL), shared)), firsts, threshold))
    pairs = cut(small.unionByName(stars.select(F.least("id", "centre").alias("x"), F.greatest("id", "centre").alias("y"))).distinct())
    links = cut(confirmed(pairs, corpus, threshold))
    found = components(links)
    more = cut(across_components(stars, found, corpus, threshold))
    if not more.isEmpty():
        found = components(cut(links.unionByName(confirmed(more, corpus, threshold))))
    by_class = nodes.drop("sig").join(found, "id", "left").withColumn("node", F.coalesce("component", "id"))
    if renamed:
        # A component's smallest doc_id is that of its classes, whatever their nodes are called.
        by_class = cut(by_class)
        odd = by_class.where("id <> first").select("node").distinct()
        least = by_class.join(odd, "node", "left_semi").groupBy("node").agg(F.min("first").alias("least"))
        by_class = by_class.join(least, "node", "left").withColumn("component_id", F.coalesce("least", "node"))
    else:
        by_class = by_class.withColumn("component_id", F.col("node"))
    by_class = cut(by_class.select("n_shingles", "a", "b", "node", "component_id"))
    own = signed.drop("sig").join(by_class, ["n_shingles", "a", "b"], "left")
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return own.select("doc_id", "mark", "n_shingles", F.when(has, F.col("node")).alias("node"), F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return _grouped(docs, threshold).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without all but one of each component; columns as they come.

    A component keeps the row of its smallest doc_id, of the least `mark` if that repeats with several texts, and of
    the least hash of all columns if rows are alike.
    """
    groups = cut(_grouped(docs, threshold).where("doc_id is not null"))
    best = groups.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.*")
    kept = cut(best.unionByName(groups.where("node is null").select("doc_id", "mark")).distinct())
    copies = groups.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # Rows without an id stay as they are; they don't meet at one key.
    ident, mark = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    named = docs.where(ident.isNotNull()).withColumns({"__tm_id": ident, "__tm_mark": mark})
    rows = named.join(kept.select(F.col("doc_id").alias("__tm_id"), F.col("mark").alias("__tm_mark")), ["__tm_id", "__tm_mark"], "left_semi")
    if not copies:
        once = F.row_number().over(Window.partitionBy("__tm_id", "__tm_mark").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
        rows = rows.withColumn("__tm_n", once).where("__tm_n = 1").drop("__tm_n")
    return rows.drop("__tm_id", "__tm_mark").unionByName(docs.where(ident.isNull()))
