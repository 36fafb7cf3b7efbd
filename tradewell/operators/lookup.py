"""Key lookups: attributes, corrections, first match, filling missing links."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.operators.keys import pick_one


def lookup(
    df: DataFrame, table: DataFrame, on: dict[str, str], take: dict[str, str],
    null_safe: bool = False,
) -> DataFrame:
    """Left join that adds ``take`` (table column -> new column) by ``on`` (own -> table column).

    ``table`` must have one row per key, else rows are repeated. No hint is given: Spark
    broadcasts the table when its size allows it and otherwise shuffles, splitting skewed
    partitions.
    """
    clash = set(take.values()) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    names = {own: f"__key{i}" for i, own in enumerate(on)}
    right = table.select(
        *[F.col(theirs).alias(names[own]) for own, theirs in on.items()],
        *[F.col(source).alias(new) for source, new in take.items()],
    )
    equal = Column.eqNullSafe if null_safe else Column.__eq__
    condition = reduce(and_, [equal(F.col(own), F.col(names[own])) for own in on])
    return df.join(right, condition, "left").drop(*names.values())


def last_mapping(mapping: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A correction table with one row per key; the last entry wins."""
    return pick_one(mapping, keys, [order], keep="last").drop(order)


def override(
    df: DataFrame, mapping: DataFrame, on: dict[str, str], column: str, corrected: str
) -> DataFrame:
    """Replace ``column`` by the corrected value where the mapping has one."""
    found = lookup(df, mapping, on, {corrected: "__corrected"})
    return found.withColumn(
        column, F.coalesce("__corrected", column)
    ).select(*df.columns)


def first_match(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The smallest ``value`` per key, whatever else the key is repeated over."""
    return table.groupBy(*keys).agg(F.min(value).alias(value))


def fill_null(
    df: DataFrame, table: DataFrame, on: dict[str, str], column: str, source: str
) -> DataFrame:
    """Fill ``column`` from the table where it is null; rows that have it stay out of the join."""
    pending = lookup(df.filter(F.col(column).isNull()), table, on, {source: "__found"})
    filled = pending.withColumn(
        column, F.col("__found").cast(df.schema[column].dataType)
    ).select(*df.columns)
    return df.filter(F.col(column).isNotNull()).unionByName(filled)
