"""Importance resampling towards a target: hashed features, and ranks by a distributed radix sort."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewell.llm.common import prepare, saved, texts_of

#: Places that a pass of the sort counts together.
BLOCK = 4096
#: Bits of a digit at most: a pass has at most 2,048 counters.
DIGIT = 11
#: Features whose buckets a task remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: Bytes of a text that are split at once.
PIECE = 1 << 20

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (letters, digits and all beyond ASCII; A-Z lowered), in bounded lists."""
    folded = text.translate(_FOLD)
    at = 0
    while len(folded) - at > PIECE:
        cut = folded.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield folded[at:cut].split()
        at = cut
    yield folded[at:].split()


class Buckets(dict):
    """The bucket of a feature: its crc32 modulo their number."""

    def __init__(self, number: int):
        self.number = number

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.number
        if len(feature) <= LONGEST_REMEMBERED and len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket

    def of(self, text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of the features that end in them), list by list."""
        carried: list[bytes] = []
        for words in word_lists(text):
            features = words
            if longest > 1:
                every, old = carried + words, len(carried)
                features = [
                    b" ".join(every[end - size : end])
                    for end in range(old + 1, len(every) + 1) for size in range(1, min(longest, end) + 1)]
                carried = every[1 - longest :]
            yield len(words), np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): the features of all texts, counted by bucket within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                for _, found in known.of(text, longest):
                    held += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a weight; one number per bucket, so of a fixed size."""
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    own = bucket_counts(docs, text_col, longest, buckets).withColumnRenamed("n", "own")
    wanted = bucket_counts(target, text_col, longest, buckets).withColumnRenamed("n", "wanted")
    held = every.join(own, "bucket", "left").join(wanted, "bucket", "left").na.fill(0)
    rows = held.collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.own, r.wanted
    total_s, total_t = int(s.sum()), int(t.sum())
    ratio = (t + 1.0) * (total_s + buckets) / ((s + 1.0) * (total_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, tie, n_words, n_features, weight) of every row; a weight is a sum of gains."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in batches:
            out = np.zeros((4, len(batch)), np.int64)
            for i, text in enumerate(texts_of(batch.column("text"))):
                out[0, i] = zlib.crc32(text)
                for words, found in known.of(text, longest):
                    out[1:, i] += words, len(found), gain[found].sum()
            held = [batch.column(c) for c in ("id", *keep)]
            yield pa.RecordBatch.from_arrays(
                [*held, *map(pa.array, out)], ["id", *keep, "tie", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    columns = ["id", *keep, "tie", "n_words", "n_features", "weight"]
    return rows.mapInArrow(add, ", ".join(f"{c} long" for c in columns))


def chance(key: Column) -> Column:
    """A Gumbel variate in thousandths, from the first 32 bits of the key's SHA-256."""
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def digits(key: Column, highest: int) -> list[Column]:
    """The digits of a key between 0 and ``highest``, least significant first, all of the same width."""
    bits = highest.bit_length()
    if not bits:
        return []
    number = -(-bits // DIGIT)
    width = -(-bits // number)
    mask = F.lit((1 << width) - 1).cast("long")
    return [F.shiftrightunsigned(key, k * width).bitwiseAND(mask) for k in range(number)]


def radix_sort(rows: DataFrame, passes: list[Column], block: int = BLOCK) -> DataFrame:
    """``rows`` with ``place``, their rank from 0 by the digits of ``passes``, the least significant first.

    Each pass is a stable counting sort: rows are counted by digit and block of places; a block's
    share of a digit begins behind all smaller digits and the same digit of all earlier blocks;
    within it, rows follow their places before. The sums over digits are at most 2^11 numbers, those over
    blocks a window per digit. Rows are shuffled by (digit, block), so a digit that many rows share is
    spread over as many tasks as there are blocks. Every pass is written, so a lost executor repeats one.
    """
    spark = rows.sparkSession
    rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), "radix-rows")
    first = True
    for digit in passes or [F.lit(0).cast("long")]:
        # At first a place is (partition, row of it); later it is the rank so far.
        at = F.shiftright("place", 33) if first else F.floor(F.col("place") / block)
        marked = rows.withColumn("digit", digit).withColumn("block", at.cast("long"))
        counts = marked.groupBy("digit", "block").agg(F.count("*").alias("n"))
        totals = sorted(tuple(r) for r in counts.groupBy("digit").agg(F.sum("n")).collect())
        bases, base = [], 0
        for value, n in totals:
            bases.append((value, base))
            base += n
        earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
            F.broadcast(spark.createDataFrame(bases, "digit long, base long")), "digit").select(
            "digit", "block", (F.col("before") + F.col("base")).alias("offset"))
        within = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
        placed = marked.withColumn("within", within).join(offsets, ["digit", "block"])
        rows = saved(placed.withColumn("place", F.col("offset") + F.col("within")).select(*rows.columns), "radix-pass")
        first = False
    return rows


def importance_ranks(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1,
    buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(``id_col``, *keep, n_features, weight, score, rank) of every document; rank is null unless drawn.

    Features are the runs of 1 to ``longest`` words, hashed into buckets. A bucket's gain compares its
    share of the target's features with its share of the documents'; a weight is the sum of gains over a
    document, and the score adds a Gumbel variate that only the id and the seed decide, which draws
    without replacement in proportion to exp(weight / 1000). Of the documents with ``least_words`` words
    or more, ``percent`` in a hundred with the highest scores are drawn, ties to the smaller id.

    Scores are ranked by a least-significant-digit radix sort over the digits of (score, id): see
    ``radix_sort``. The driver sees the 2 x ``buckets`` counts and at most 2^11 digit counts a pass.

    Null and empty texts have no features, weight 0 and are never drawn. Null ids come last among
    equal scores and share one variate. Rows that repeat an id are rows of their own; if their scores
    are equal too, a checksum of the text orders them, and rows equal in that are alike but for their place.
    ``keep`` names integer columns that come along.
    """
    spark = prepare(docs.sparkSession)
    gain = gains(docs, target, text_col, longest, buckets)
    weighed = weigh(docs, gain, id_col, text_col, longest, keep)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    scored = saved(weighed.withColumn("score", (F.col("weight") + chance(key)).cast("long")), "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    n, low, high, low_id, high_id, nulls = able.agg(
        F.count("*"), F.min("score"), F.max("score"), F.min("id"), F.max("id"), F.count_if(F.col("id").isNull())).first()
    columns = [F.col("id").alias(id_col), *keep, "n_features", "weight", "score"]
    rank = F.lit(None).cast("long").alias("rank")
    if not n:
        return scored.select(*columns, rank)
    passes: list[Column] = []
    repeated = able.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        passes += digits(F.col("tie"), (1 << 32) - 1)
    if low_id is not None:
        if high_id - low_id < 1 << 62:
            passes += digits(F.coalesce(F.col("id") - F.lit(low_id), F.lit(0).cast("long")), high_id - low_id)
        else:  # the sign bit turned, ids are in order as unsigned numbers
            turned = F.coalesce(F.col("id"), F.lit(0).cast("long")).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
            passes += digits(turned, (1 << 64) - 1)
    if nulls:
        passes.append(F.col("id").isNull().cast("long"))
    passes += digits(F.lit(high) - F.col("score"), high - low)
    ranked = radix_sort(able, passes)
    drawn = F.when(F.col("place") < n * percent // 100, F.col("place") + 1)
    return ranked.select(*columns, drawn.alias("rank")).unionAll(
        scored.filter(F.col("n_words") < least_words).select(*columns, rank))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and ``__rank``, ``__score``.

    The name ``__row`` is reserved: a column of that name is an error.
    """
    if "__row" in docs.columns:
        raise ValueError("the column name __row is reserved")
    prepare(docs.sparkSession)
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "resampled-rows")
    ranks = importance_ranks(rows, target, id_col, text_col, keep=("__row",), **settings).filter("rank is not null")
    return rows.join(ranks.select("__row", F.col("rank").alias("__rank"), F.col("score").alias("__score")), "__row").drop("__row")
