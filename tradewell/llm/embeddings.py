"""Near-duplicate vectors by random-hyperplane signs, exact cosine and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import components, prepare, saved

#: Vectors of a block; a bucket of more is compared block against block.
BLOCK_ROWS = 512


def tables_needed(cosine: float, bits: int, recall: float) -> int:
    """Hash tables until a pair at the threshold shares a bucket with probability ``recall``."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _planes(dimension: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, tables * bits))


def _unit(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and double vector of length 1 of every usable row."""
    for i, x in enumerate(column.to_pylist()):
        if not x or any(v is None for v in x):
            continue
        v = np.asarray(x, np.float64)
        top = np.abs(v).max()
        if np.isfinite(top) and top > 0:
            v = v / top
            yield i, v / np.sqrt(v @ v)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    cosine: float = 0.95, recall: float = 0.9995, seed: int = 7,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Two rows link when their cosine, in double precision, is at least ``cosine`` and they share
    a bucket in one of the hash tables. The bits of a table grow with the logarithm of the
    number of distinct vectors; the number of tables then follows from ``recall``, the
    probability that a pair at the threshold meets. Equal vectors are counted once and stand
    for all their copies, so they are never compared with each other. Buckets are cut into
    blocks and every two blocks of a bucket meet in a task; tasks return counts and a spanning
    forest, not pairs. A pair counts in the first table in which it meets.

    Null, empty, zero vectors and those with null or non-finite components link with nothing;
    nor do vectors of different length. Rows are told apart by their id; rows that repeat an
    id are each returned, and count as copies of each other if their vectors agree. A null id
    cannot be a component, so its row keeps null there unless it links with others.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    digest = F.sha2(F.transform("vector", lambda x: F.coalesce((x + 0.0).cast("string"), F.lit("null")))
                    .cast("string").cast("binary"), 256)
    keyed = rows.withColumn("digest", digest)
    usable = F.col("digest").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists(
        "vector", lambda x: x.isNull() | x.isNaN() | (F.abs(x) == float("inf")))
    distinct = saved(
        keyed.filter(usable).groupBy("digest").agg(
            F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")
        ), "vectors",
    ).withColumn("node", F.coalesce("node", F.xxhash64("digest")))
    count = distinct.count()
    bits = max(6, math.ceil(math.log2(max(count, 1) / 50)) if count > 50 else 6)
    tables = tables_needed(cosine, bits, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(_unit(batch.column("vector")))
            for size in {len(v) for _, v in got}:
                own = [(i, v) for i, v in got if len(v) == size]
                index, unit = pa.array([i for i, _ in own]), np.stack([v for _, v in own])
                planes = _planes(size, tables, bits, seed)
                signs = (unit @ planes > 0).reshape(len(own), tables, bits)
                codes = (signs * (1 << np.arange(bits))).sum(2).astype(np.int64) + (size << 40)
                node, copies = batch.column("node").take(index), batch.column("copies").take(index)
                packed = [x.tobytes() for x in unit]
                all_codes = [x.tobytes() for x in codes]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), t, np.int32)), pa.array(codes[:, t]), node, copies,
                         pa.array(all_codes, pa.binary()), pa.array(packed, pa.binary())],
                        ["t", "code", "node", "copies", "codes", "unit"])

    signed = distinct.mapInArrow(
        sign, "t int, code long, node long, copies long, codes binary, unit binary")
    sizes = distinct.mapInArrow(sign, signed.schema).groupBy("t", "code").count()
    # A row goes to its own block and meets every block of its bucket. Sixteen buckets share a
    # group, for fewer and fuller ones.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK_ROWS)).cast("int")
    placed = signed.join(sizes.filter("count > 1").withColumn("blocks", blocks), ["t", "code"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "t", F.shiftright("code", 4).alias("g"), "code", F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"), "block", "node", "copies", "codes", "unit")

    def linked(left: pd.DataFrame, right: pd.DataFrame, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.frombuffer(b"".join(z["unit"]), np.float64).reshape(len(z), -1) for z in (left, right))
        ca, cb = (np.frombuffer(b"".join(z["codes"]), np.int64).reshape(len(z), -1) for z in (left, right))
        i, j = np.nonzero(a @ b.T >= cosine - 1e-9)
        if left is right:
            i, j = i[i < j], j[i < j]
        new = ~(ca[i, :t] == cb[j, :t]).any(axis=1)
        new[new] = np.einsum("ij,ij->i", a[i[new]], b[j[new]]) >= cosine
        return i[new], j[new]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        t, low, high = int(pdf["t"].iloc[0]), int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        out = [pd.DataFrame({"node": [], "root": [], "links": []}).astype("int64")]
        for _, bucket in pdf.groupby("code", sort=False):
            left = bucket[bucket["block"] == low]
            right = left if low == high else bucket[bucket["block"] == high]
            if not len(left) or not len(right):
                continue
            i, j = linked(left, right, t)
            if not len(i):
                continue
            # Each row's number of links, and the smallest node it reaches within these blocks.
            both = left if left is right else pd.concat([left, right])
            k = j if left is right else j + len(left)
            node, copies = both["node"].to_numpy(), both["copies"].to_numpy()
            links = np.bincount(i, copies[k], len(both)) + np.bincount(k, copies[i], len(both))
            reach, before = node.copy(), None
            while before is None or (reach != before).any():
                before = reach.copy()
                np.minimum.at(reach, i, before[k])
                np.minimum.at(reach, k, before[i])
            some = links > 0
            out.append(pd.DataFrame({"node": node[some], "root": reach[some], "links": links[some].astype("int64")}))
        return pd.concat(out)

    found = dealt.groupBy("t", "g", "x", "y").applyInPandas(compare, "node long, root long, links long")
    found = saved(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = distinct.select("digest", "node", "copies").join(links, "node", "left").join(groups, "node", "left")
    return keyed.select("id", "digest").join(classes, "digest", "left").select(
        F.col("id").alias(id_col),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "node", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
