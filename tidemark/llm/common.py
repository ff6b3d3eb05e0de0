"""What the corpus operators share: durable cuts of lineage and vectorised text primitives."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space, the only separator of words here.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised block holds; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of rows that go to a Python worker in one batch.
BATCH_BYTES = 4 << 20


#: Rows that share a key and go to one task before the key is dealt over several; longest list of keys to broadcast.
HOT_ROWS, BROADCAST_KEYS = 512, 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all is on one machine."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context.getCheckpointDir().get()


@contextmanager
def _sparing(spark: SparkSession):
    """Frames made inside leave no shuffle files behind once their action has ended, and Python gets their rows in batches of few bytes."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder now and continue from that copy."""
    ensure_checkpoint_dir(df.sparkSession)
    with _sparing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of files in the shared folder: columnar and compressed, for what is large."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _sparing(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Remove the files of frames from `cut` or `written` that nothing reads any more."""
    for df in frames:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            place = files[0].rsplit("/", 1)[0]
        else:
            found = df._jdf.queryExecution().logical()
            found = found.rdd().getCheckpointFile() if hasattr(found, "rdd") else None
            if found is None or not found.isDefined():
                continue
            place = found.get()
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has a row a key; a key of over HOT_ROWS rows in left is dealt by the column `by`
    over as many salts as it needs, and its row in right goes to each. `counted`: rows with the same keys, if cheaper to count."""
    n = (left if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("__tm_n")).where(F.col("__tm_n") > HOT_ROWS)
    hot = cut(n.select(key, F.ceil(F.col("__tm_n") / HOT_ROWS).cast("int").alias("__tm_salts")))
    n_hot = hot.count()  # at most 1 in HOT_ROWS of left's rows
    if not n_hot:
        return left.join(right, key)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    salts = F.coalesce("__tm_salts", F.lit(1))
    a = left.join(hot, key, "left").withColumn("__tm_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("__tm_salts")
    b = right.join(hot, key, "left").withColumn("__tm_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__tm_salts")
    return a.join(b, [key, "__tm_salt"]).drop("__tm_salt")


def give_back(run):
    """run, a function of batches; its worker returns what it has freed to the system at the end, so that an idle one holds little."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most `limit` bytes each, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """The blocks of an Arrow string column one by one, so that no more than one block's texts are copied at once."""
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).tolist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i, as_bytes(column.slice(start, i - start))
            start, size = i, 0
        size += n + 1
    if start < len(lengths):
        yield start, len(lengths), as_bytes(column.slice(start))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _rule64(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE_VALUE = _rule64(256, 11) | np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LOW = 4096


def _powers(step: np.uint64, n: int) -> np.ndarray:
    table = np.full(n, step, dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


#: Powers below _LOW; those of _LOW times anything come from a second table, so that none is as long as a text.
_UP, _DOWN = _powers(_STEP, _LOW), _powers(_STEP_INVERSE, _LOW)
_UP_LOW, _DOWN_LOW = (_UP[-1:] * _STEP)[0], (_DOWN[-1:] * _STEP_INVERSE)[0]


_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True


class TextBlock:
    """Documents joined by newlines, with hashes of any of their byte ranges.

    The hash of a range is a polynomial over randomised byte values modulo 2^64,
    read off prefix sums, then mixed: it depends on the bytes alone, not on the place.
    """

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.n_docs = len(texts)
        self.doc_end = np.cumsum(lengths + 1) - 1
        self.doc_start = self.doc_end - lengths
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
        self._prefix: np.ndarray | None = None

    @cached_property
    def _word_edges(self) -> np.ndarray:
        return np.flatnonzero(np.diff(_IS_WHITE[self.bytes].view(np.int8), prepend=np.int8(1)))

    @property
    def word_start(self) -> np.ndarray:
        return self._word_edges[0::2]

    @property
    def word_end(self) -> np.ndarray:
        return self._word_edges[1::2]

    @cached_property
    def word_doc(self) -> np.ndarray:
        """Each word's document."""
        return np.searchsorted(self.doc_end, self.word_start, side="left")

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.bytes)
        if self._prefix is None:
            rows = -(-n // _LOW)
            terms = np.zeros(rows * _LOW + 1, dtype=np.uint64)
            np.take(_BYTE_VALUE, self.bytes, out=terms[1 : n + 1])
            grid = terms[1:].reshape(rows, _LOW)
            grid *= _UP
            grid *= _powers(_UP_LOW, max(rows, 1))[:rows, None]
            self._prefix = np.cumsum(terms, out=terms)
        high = _powers(_DOWN_LOW, n // _LOW + 1)
        h = self._prefix[end] - self._prefix[start]
        h *= _DOWN[start & (_LOW - 1)]
        h *= high[start >> 12]
        h += (end - start).astype(np.uint64)
        return mix64(h)

    def forget_hashes(self) -> None:
        self._prefix = None

    def word_hashes(self) -> np.ndarray:
        return self.range_hash(self.word_start, self.word_end)

    def count_by_doc(self, of_bytes: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        total = np.zeros(len(of_bytes) + 1, dtype=np.int64)
        np.cumsum(of_bytes, out=total[1:])
        return total[self.doc_end] - total[self.doc_start]


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
