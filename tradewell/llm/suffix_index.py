"""Repeated long strings by a family of sparse suffix arrays that merge geometrically."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.llm.common import (
    BLOCK, Rolling, few, prepare, remove, saved, shared_folder, signed, texts_of, unique_ids,
)

#: Distinct runs of one anchor that are compared within a task; more are compared by a shuffle.
RUNS = 20_000
#: Runs compared in a task.
GROUP = 4_000
LEVEL = "key long, run long, node long, start long, windows int"
_FIRST, _SECOND = Rolling(21), Rolling(22)


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by running minima within aligned pieces."""
    n = len(x)
    full = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    pieces = full.reshape(-1, size)
    up = np.minimum.accumulate(pieces, 1).ravel()
    down = np.minimum.accumulate(pieces[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(down[: n - size + 1], up[size - 1 : n])


def _blocks(texts: list[bytes], long: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Pieces of about BLOCK bytes, with (text, offset in the text, from, to) of their parts.

    Parts of one long text overlap by ``long - 1`` bytes, so that no window is lost.
    """
    held: list[bytes] = []
    parts: list[tuple[int, int, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - long + 1, 0), BLOCK):
            piece = text[at : at + BLOCK + long - 1]
            held.append(piece)
            parts.append((i, at, size, size + len(piece)))
            size += len(piece)
            if size >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), parts
                held, parts, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), parts


def _runs(data: np.ndarray, parts: list[tuple[int, int, int, int]], long: int, anchor: int) -> tuple[np.ndarray, ...]:
    """The runs of windows that share an anchor: part, first window, windows, key, fingerprint."""
    n = len(data)
    prefix = _FIRST.prefix(data)
    grams = _FIRST.windows(prefix, anchor)
    low = np.uint64(max(1, n.bit_length()))
    mask = np.uint64((1 << int(low)) - 1)
    # The smallest hash of a window, leftmost among equals: equal windows have it at one place.
    least = _sliding_least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), long - anchor + 1)
    place = (least & mask).astype(np.int64)
    owner = np.full(len(place), -1, np.int32)
    for k, (_, _, start, end) in enumerate(parts):
        owner[start : end - long + 1] = k
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    start = np.flatnonzero(fresh)
    windows = np.diff(np.concatenate([start, [len(place)]]))
    inside = owner[start] >= 0
    start, windows = start[inside], windows[inside]
    at = place[start]
    lead = (data[at].astype(np.uint64) << np.uint64(56)) | (data[at + 1].astype(np.uint64) << np.uint64(48))
    key = lead | (grams[at] >> np.uint64(16))
    run = _SECOND.spans(_SECOND.prefix(data), start, start + windows + long - 1)
    return owner[start], start, windows, key, run


class SuffixIndexFamily:
    """Suffix arrays of 1, 2, 4 ... batches; a new batch is scanned against all, then merged.

    Each array is sparse: it holds the suffixes that begin at an *anchor*, the ``anchor``-byte
    string of smallest hash within a window of ``long`` bytes. Equal windows have the same
    anchor, so a match of ``long`` bytes always shows as two entries with one key. An entry's
    key is its suffix's first two bytes followed by a fingerprint of its first ``anchor``
    bytes; arrays are dealt by key and sorted by it within each part, which puts all suffixes
    that agree so far next to each other. An entry also carries the run of windows that share the
    anchor and a fingerprint of all of the run's bytes.

    ``add`` writes the sorted array of a batch, scans it together with the existing levels for
    keys that repeat, and merges arrays of equal size. Files live in the shared folder.
    """

    def __init__(self, spark: SparkSession, long: int = 200, anchor: int = 64):
        if not 2 <= anchor <= long:
            raise ValueError("an anchor has 2 bytes at least and fits the window")
        self.spark, self.long, self.anchor = prepare(spark), long, anchor
        self.levels: list[tuple[int, str]] = []  # size in batches, path
        self.found: list[DataFrame] = []

    def _write(self, df: DataFrame) -> str:
        path = f"{shared_folder(self.spark)}/suffixes-{uuid.uuid4().hex[:12]}"
        df.repartition("key").sortWithinPartitions("key").write.parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(path)

    def entries(self) -> DataFrame:
        out = self._read(self.levels[0][1])
        for _, path in self.levels[1:]:
            out = out.union(self._read(path))
        return out

    def add(self, texts: DataFrame) -> DataFrame:
        """Adds the rows (node, text); returns the keys that repeat within them or in older ones."""
        long, anchor = self.long, self.anchor

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes = np.array(batch.column("node").to_pylist(), np.int64)
                for data, parts in _blocks(texts_of(batch.column("text")), long):
                    owner, start, windows, key, run = _runs(data, parts, long, anchor)
                    text, shift = (np.array([f(p) for p in parts], np.int64) for f in (
                        lambda p: p[0], lambda p: p[1] - p[2]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key)), pa.array(signed(run)), pa.array(nodes[text[owner]]),
                         pa.array(start + shift[owner]), pa.array(windows.astype(np.int32))],
                        ["key", "run", "node", "start", "windows"])

        path = self._write(texts.mapInArrow(index, LEVEL))
        scan = self._read(path).select("key", F.lit(1).alias("new"))
        for _, old in self.levels:
            scan = scan.union(self._read(old).select("key", F.lit(0).alias("new")))
        hits = scan.groupBy("key").agg(F.sum("new").alias("new"), F.count("*").alias("all"))
        hits = saved(hits.filter("new > 0 and all > 1").select("key"), "suffix-hits")
        self.found.append(hits)
        self.levels.append((1, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._write(self._read(one).union(self._read(two)))))
            remove(self.spark, one)
            remove(self.spark, two)
        return hits

    def repeated_entries(self) -> DataFrame:
        """The entries whose key repeats anywhere in the family."""
        keys = self.found[0]
        for more in self.found[1:]:
            keys = keys.union(more)
        return self.entries().join(keys.distinct(), "key")


def _repeated_windows(segments: list[bytes], long: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur more than once in all of them."""
    one, two = [], []
    for at in range(0, len(segments), 500):
        part = segments[at : at + 500]
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(x) for x in part])
        inside = np.concatenate([np.arange(e - len(x), e - long + 1) for e, x in zip(ends, part, strict=True)])
        for out, hashes in ((one, _FIRST), (two, _SECOND)):
            out.append(hashes.windows(hashes.prefix(data), long)[inside])
    one, two = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    seen = np.zeros(len(one), bool)
    seen[order[1:]] |= same
    seen[order[:-1]] |= same
    return np.split(seen, np.cumsum([len(x) - long + 1 for x in segments])[:-1])


def repeated_spans(texts: DataFrame, long: int = 200, anchor: int = 64, batches: int = 2, runs: int = RUNS) -> DataFrame:
    """(node, from, to): byte ranges whose union is every byte in a ``long``-byte string that repeats.

    Runs whose whole content repeats are settled by their fingerprints. The others, at the ends of
    matches, are compared window by window with all different runs of the same anchor; an anchor
    with more than ``runs`` different ones is compared by a shuffle on the windows instead.
    """
    family = SuffixIndexFamily(texts.sparkSession, long, anchor)
    for k in range(batches):
        family.add(texts.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == k))
    rows = saved(family.repeated_entries(), "suffix-runs")
    same = saved(rows.groupBy("key", "run", "windows").agg(
        F.count("*").alias("n"), F.min(F.struct("node", "start")).alias("one")), "suffix-same")
    spans = rows.join(same.filter("n > 1").select("key", "run", "windows"), ["key", "run", "windows"], "left_semi").select(
        "node", F.col("start").alias("from"), (F.col("start") + F.col("windows") + long - 1).alias("to"))

    keys = same.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter(
        "kinds > 1 and least = 1").select("key", "kinds")
    open_runs = saved(same.join(keys, "key").select(
        "key", "kinds", (F.col("n") == 1).alias("single"), "one.node", "one.start", "windows"), "suffix-open")
    count = open_runs.count()
    if not count:
        return spans
    wanted = open_runs.groupBy("node").agg(
        F.collect_list(F.struct("key", "kinds", "single", "start", "windows")).alias("wanted"))
    cut = texts.join(few(wanted.select("node")), "node", "left_semi").withColumn("text", F.col("text").cast("binary"))
    cut = cut.join(wanted, "node").withColumn("w", F.explode("wanted")).select(
        "w.key", "w.kinds", "w.single", "node", "w.start", "w.windows",
        F.expr(f"substring(text, int(w.start) + 1, w.windows + {long - 1})").alias("bytes"))
    cut = saved(cut, "suffix-cuts")
    form = "node long, `from` long, `to` long"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for node, start, single, seen in zip(
            pdf["node"].tolist(), pdf["start"].tolist(), pdf["single"].tolist(),
            _repeated_windows(pdf["bytes"].tolist(), long), strict=True,
        ):
            if single and seen.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], seen, [False]]).astype(np.int8)))
                out += [(node, start + a, start + b + long - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["node", "from", "to"]).astype("int64")

    groups = max(1, count // GROUP)
    close = cut.filter(F.col("kinds") <= runs).withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    spans = spans.union(close.select("g", "single", "node", "start", "bytes").groupBy("g").applyInPandas(settle, form))
    wide = cut.filter(F.col("kinds") > runs)
    if wide.limit(1).count():
        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for segment, node, start, single in zip(*(batch.column(c).to_pylist() for c in (
                        "bytes", "node", "start", "single")), strict=True):
                    data = np.frombuffer(segment, np.uint8)
                    one, two = (h.windows(h.prefix(data), long) for h in (_FIRST, _SECOND))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(one)), pa.array(signed(two)), pa.array(np.full(len(one), node)),
                         pa.array(start + np.arange(len(one))), pa.array(np.full(len(one), single))],
                        ["one", "two", "node", "start", "single"])

        seen = saved(wide.mapInArrow(explode, "one long, two long, node long, start long, single boolean"), "suffix-wide")
        twice = seen.groupBy("one", "two").count().filter("count > 1").select("one", "two")
        spans = spans.union(seen.filter("single").join(twice, ["one", "two"], "left_semi").select(
            "node", F.col("start").alias("from"), (F.col("start") + long).alias("to")))
    return spans


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = 200, anchor: int = 64,
    batches: int = 2, runs: int = RUNS,
) -> DataFrame:
    """(id, n_bytes, n_removed, removed, kept) of every row: its text without repeated strings.

    A byte goes if it lies in a string of ``long`` bytes that also starts anywhere else in the
    table, the same text included; overlaps count and all strings are judged on the input.
    ``removed`` are the maximal removed byte ranges [from, to), ``kept`` the remaining bytes.

    Null texts count as empty and texts shorter than ``long`` never lose anything. Rows are
    told apart even if ids are null or repeat: rows with the same text repeat each other.
    """
    prepare(docs.sparkSession)
    texts, names = unique_ids(docs, id_col, text_col)
    spans = saved(repeated_spans(texts, long, anchor, batches, runs), "suffix-spans")
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    touched = few(spans.select("node"))
    none = F.lit(None).cast("array<struct<from:bigint,to:bigint>>")
    every = texts.join(touched, "node", "left_semi").join(spans, "node").select("node", "text", "spans").union(
        texts.join(touched, "node", "left_anti").select("node", "text", none))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, sizes, gone = [], [], [], []
            for text, ranges in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((r["from"], r["to"]) for r in ranges or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"from": a, "to": b} for a, b in runs])
                sizes.append(len(text))
                gone.append(len(text) - len(kept[-1]))
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(removed, kind), pa.array(kept, pa.binary())],
                ["node", "n_bytes", "n_removed", "removed", "kept"])

    out = every.mapInArrow(
        strip, "node long, n_bytes long, n_removed long, removed array<struct<from:long,to:long>>, kept binary")
    if names is not None:
        out = out.join(names, "node").withColumn("node", F.col("id"))
    return out.select(F.col("node").alias(id_col), "n_bytes", "n_removed", "removed", "kept")
