"""Exact deduplication by content-defined chunk recipes.

A text (A-Z lower-cased, null as empty) is cut where a rolling hash of its last
32 bytes says so. Each distinct chunk gets an identifier: its 64-bit hash, and
an ordinal among the chunks of that hash, which is 0 unless contents differ.
Contents of equal hash are compared as bytes, so that equal lists of
identifiers mean equal texts. Texts move once, chunk by chunk and pre-deduplicated,
to be verified; documents are then grouped by their short lists.

Defined cases: null and empty texts are equal to each other; a null doc_id is kept only
where its whole group has none; rows that repeat a doc_id and text each get a row in
`exact_groups`, and `exact_dedup` keeps one of them; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import as_bytes, cut, give_back, mix64, text_blocks

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 1024, 16384, 12
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(b: bytes) -> list[int]:
    """Where the chunks of b end."""
    n = len(b)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(b, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    places = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        i = int(np.searchsorted(places, at + MIN_CHUNK))
        end = min(int(places[i]) if i < len(places) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _chunks(b: bytes) -> Iterator[bytes]:
    at = 0
    for end in chunk_ends(b):
        yield b[at:end]
        at = end


def _hash(chunk: bytes, bits: int) -> int:
    return (xxhash.xxh3_64_intdigest(chunk) & ((1 << bits) - 1)) - (1 << 63 if bits == 64 else 0)


def _recipes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, lists = [], []
            for _, _, texts in text_blocks(batch.column(1)):
                for text in texts:
                    b = text.lower()
                    shas.append(hashlib.sha256(b).hexdigest())
                    lists.append([_hash(c, bits) for c in _chunks(b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "text_sha256", "recipe"])

    return run


def _contents(bits: int, places: bool):
    """Chunks with their hashes; once a batch, or with places each with its document's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            rows: list[tuple] = []
            for sha_of, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                b = text.lower()
                sha = hashlib.sha256(b).hexdigest() if places else ""
                for i, c in enumerate(_chunks(b)):
                    if places:
                        rows.append((sha_of, sha, i, _hash(c, bits), c))
                    elif c not in seen:
                        seen[c] = _hash(c, bits)
            if places:
                a, s, i, h, c = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.string()), pa.array(i, pa.int32()), pa.array(h, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "text_sha256", "place", "h", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.int64()), pa.array(seen.keys(), pa.binary())], names=["h", "chunk"])

    return run


def recipes(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, recipe: the verified identifiers of a text's chunks in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = cut(rows.mapInArrow(give_back(_recipes(id_bits)), "doc_id long, text_sha256 string, recipe array<long>"))
    chunks = rows.mapInArrow(give_back(_contents(id_bits, False)), "h long, chunk binary")
    clash = cut(chunks.groupBy("h").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a != b").select("h"))
    named = plain.select("doc_id", "text_sha256", F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(0).alias("ordinal"))).alias("recipe"))
    if clash.isEmpty():
        return named
    # Hashes with more than one content: number the contents, and put the numbers into the lists that hold them.
    ordinal = F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1
    ids = chunks.join(clash, "h", "left_semi").distinct().withColumn("ordinal", ordinal)
    placed = rows.mapInArrow(give_back(_contents(id_bits, True)), "doc_id long, text_sha256 string, place int, h long, chunk binary")
    found = placed.join(ids, ["h", "chunk"]).select("doc_id", "text_sha256", "place", "ordinal").distinct()
    found = found.groupBy("doc_id", "text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("place", "ordinal"))).alias("at"))
    joined = named.alias("n").join(found.alias("f"), F.col("n.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("n.text_sha256") == F.col("f.text_sha256")), "left")
    full = F.transform("n.recipe", lambda c, i: F.struct(c["h"].alias("h"), F.coalesce(F.try_element_at("f.at", i), F.lit(0)).alias("ordinal")))
    return joined.select("n.doc_id", "n.text_sha256", full.alias("recipe"))


def exact_groups(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    listed = recipes(docs, id_bits).withColumn("key", F.xxhash64("recipe"))
    groups = listed.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return listed.join(groups, ["key", "recipe"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each group of equal texts; columns as they come."""
    keys = ["__tm_id", "__tm_sha"]
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = exact_groups(docs).where("kept").select(ident.alias(keys[0]), F.col("text_sha256").alias(keys[1])).distinct()
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.withColumns({keys[0]: ident, keys[1]: F.sha2(lowered, 256)})
    once = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    return rows.join(kept, keys, "left_semi").withColumn("__tm_n", once).where("__tm_n = 1").drop(*keys, "__tm_n")
