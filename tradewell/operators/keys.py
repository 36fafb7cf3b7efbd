"""One row per key, required keys and stable surrogate keys."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_one(df: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) in ``order``, ties broken by the other columns.

    It is an aggregate, not a window: rows are reduced before the shuffle, so a key
    that holds a large share of the rows never meets in one task. Null order values
    come before all others.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    best = F.max(row) if keep == "last" else F.min(row)
    return df.groupBy(*keys).agg(best.alias("__row")).select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )


def any_null(columns: list[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def require_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a complete key, rows with a null in the key)."""
    return df.filter(~any_null(keys)), df.filter(any_null(keys))


def assign_ids(
    df: DataFrame, keys: list[str], id_column: str, existing: DataFrame | None = None,
    bucket_rows: int = 100_000,
) -> DataFrame:
    """Fill null ids with consecutive numbers above every id in use.

    Rows that have an id keep it. New rows are counted and hashed into buckets of about
    ``bucket_rows`` by their (unique) key; a bucket's ids follow those of the buckets before it. The only window without a
    wide partitioning key runs over one row per bucket. The numbering depends on nothing
    but the keys, so a task that is run again gives the same ids.
    """
    new = df.filter(F.col(id_column).isNull())
    buckets = new.count() // bucket_rows + 1
    new = new.withColumn(
        "__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    )
    in_use = df if existing is None else existing
    # The largest id in use takes part as bucket -1, in front of all others.
    sizes = (
        new.groupBy("__bucket").agg(F.count("*").alias("__n"))
        .unionByName(in_use.select(
            F.lit(-1).alias("__bucket"),
            F.coalesce(F.max(F.col(id_column)), F.lit(0)).cast("bigint").alias("__n"),
        ))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn("__offset", F.sum("__n").over(before)).select(
        F.col("__bucket").alias("__b"), "__offset"
    )
    within = Window.partitionBy("__bucket").orderBy(*keys)
    numbered = (
        new.withColumn("__rank", F.row_number().over(within))
        .join(offsets, F.col("__bucket") == F.col("__b"))
        .withColumn(id_column, (F.col("__offset") + F.col("__rank")).cast(df.schema[id_column].dataType))
        .select(*df.columns)
    )
    return df.filter(F.col(id_column).isNotNull()).unionByName(numbered)
