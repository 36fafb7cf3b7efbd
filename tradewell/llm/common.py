"""What several operators share: shared storage, checked broadcasts, word hashes, components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.session import ensure_checkpoint_dir, tune

#: Rows of (id, few numbers) that may be broadcast; about 60 MB on an executor.
BROADCAST_ROWS = 1_000_000
#: Texts are hashed in blocks of about so many bytes, which fit a core's cache.
BLOCK = 1 << 18


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: skew splitting, small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    ensure_checkpoint_dir(spark)
    return spark


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: the lineage ends, nothing is computed twice.

    The files stay below ``spark.checkpoint.dir`` until ``clean`` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """As ``saved``, but bucketed by a column, so that grouping by it later needs no shuffle.

    The catalog only serves to write: the table's name is dropped at once, its files stay.
    """
    spark = df.sparkSession
    table = f"tradewell_{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, by).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def shared_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tradewell-llm"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Removes all that the operators keep in the shared folder. Call it when the results are written."""
    remove(spark, shared_folder(spark))


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hinted as broadcast if it has at most ``most`` rows, counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def unique_ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(node, text) with a unique node, and (node, id) unless the ids are unique themselves.

    Null or repeated ids get new node numbers; those rows are written once, so that the
    numbers never change.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    odd = ids.groupBy("id").count().filter("id is null or count > 1").limit(1).count()
    if not odd:
        return docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")), None
    numbered = saved(
        docs.select(
            F.monotonically_increasing_id().alias("node"), F.col(id_col).cast("long").alias("id"),
            F.col(text_col).alias("text"),
        ),
        "numbered",
    )
    return numbered.select("node", "text"), numbered.select("node", "id")


# --- words and hashes ------------------------------------------------------------

_GOLDEN = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any substrings of a block: prefix sums of byte values times powers.

    Wrapping arithmetic modulo 2^64 with an odd base, whose inverse shifts each hash back
    to its own start. ``seed`` picks the byte values and the base.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(0, 1 << 63)) * 8 + 5 & _M64
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.backs = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) <= n:
            size = max(n + 1, BLOCK * 2)
            self.powers, self.backs = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            self.powers[0] = self.backs[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.backs, out=self.backs)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.backs[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all substrings of one size."""
        count = len(prefix) - size
        return mix((prefix[size:] - prefix[:count]) * self.backs[:count])


#: Words of at most so many bytes are hashed in arrays, eight bytes at a time; longer ones by BLAKE2b.
LANES = 8
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): bijections that are not linear, one lane after another.

    A sum of byte values times powers would let somebody build words that meet at every base.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(11))
    some = np.flatnonzero(size <= 8 * LANES)
    for k in range(LANES):
        some = some[size[some] > 8 * k]
        if not len(some):
            break
        lane = lanes[start[some] + 8 * k] & _TAIL[np.minimum(size[some] - 8 * k, 8)]
        out[some] = mix((out[some] ^ lane) * np.uint64(_GOLDEN) + np.uint64(k))
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text cut at white space into pieces of about ``size`` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after another, and each text's number of words.

    Words are runs without ASCII white space; A-Z count as a-z.
    """
    parts: list[np.ndarray] = []
    counts: list[int] = []
    block: list[bytes] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        data = _LOWER[np.frombuffer(b" ".join(block) + b" ", np.uint8)]
        blank = _SPACE[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(data) and not blank[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        sizes = np.array([len(x) + 1 for x in block])
        ends = np.cumsum(sizes)
        per = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
        for i, n in zip(owner, per.tolist(), strict=True):
            counts[i] += n
        parts.append(_hashes(data, start, end))
        block.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        counts.append(0)
        for piece in _pieces(text, BLOCK) if len(text) > BLOCK else (text,):
            block.append(piece)
            owner.append(i)
            held += len(piece) + 1
            if held >= BLOCK:
                flush()
    if block:
        flush()
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return words, np.array(counts, np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; for numbers a sort is several times faster than ``np.unique``, which hashes them."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def shingle_sets(texts: Iterable[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; shorter texts are one shingle, empty ones none."""
    words, counts = word_hashes(texts)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)
    n = len(words)
    sums = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        sums += words[k : k + len(sums)] * factors[k]
    sums = mix(sums)
    at = 0
    for count in counts.tolist():
        if count >= size:
            yield distinct(sums[at : at + count - size + 1])
        elif count:
            yield mix((words[at : at + count] * factors[:count]).sum(keepdims=True) + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)
        at += count


def release_memory(generation: int = 2) -> None:
    """Gives back what earlier tasks of this Python worker have freed: workers are reused, and keep it otherwise."""
    gc.collect(generation)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need not
    if trim is not None:
        trim(0)


def returning(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` of mapInArrow, whose worker gives back what it has freed when a task ends: idle, it stays beside later stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release_memory(1)

    return run


def texts_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


# --- connected components ----------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all linked nodes; the component is its smallest node.

    Large-star and small-star rounds (each node's neighbours move to its smallest one) until
    nothing changes. Every round is a grouped minimum and a join on the node, which adaptive
    execution splits where one node has very many links; rounds end in a checkpoint.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("u != v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = pairs(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).checkpoint()
    before = state(current)
    while before[0]:
        both = current.union(current.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pairs(large).checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = pairs(small.union(least.select("u", "m"))).checkpoint()
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
