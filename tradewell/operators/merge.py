"""Write modes as pure functions: (target, source) -> new target.

Keys are complete (``require_keys``) and unique in the target. Sources may repeat a key:
``pick_one`` decides before the merge. Plain files know no MERGE, so each function returns
the whole new content; ``plans.store`` writes it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.operators.sizing import is_small


def _aligned(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """Source with exactly the target's columns and types; missing ones are null."""
    return source.select(*[
        (F.col(c) if c in source.columns and c in columns else F.lit(None))
        .cast(target.schema[c].dataType).alias(c)
        for c in target.columns
    ])


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None
) -> DataFrame:
    """Insert new keys with all source columns, update ``update`` on known keys.

    ``update`` defaults to every non-key column of the source. Other columns stay as first
    inserted. A null in the source overwrites. Rows missing from the source stay.

    A source small enough to broadcast leaves the target unshuffled (one full scan and one
    of its keys); otherwise both sides meet in one full outer join.
    """
    if update is None:
        update = [c for c in source.columns if c not in keys]
    rows = _aligned(source, target, source.columns)
    incoming = rows.select(
        F.lit(True).alias("__new"), *[F.col(c).alias(f"__s_{c}") for c in target.columns]
    )
    same_key = reduce(and_, [F.col(k) == F.col(f"__s_{k}") for k in keys])
    matched = F.col("__new").isNotNull()

    def updated(c: str) -> Column:
        if c in update:
            return F.when(matched, F.col(f"__s_{c}")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    if is_small(rows):
        kept = target.join(incoming, same_key, "left").select(*map(updated, target.columns))
        return kept.unionByName(_new_keys(target, rows, keys))
    both = target.withColumn("__old", F.lit(True)).join(incoming, same_key, "full_outer")
    inserted = F.col("__old").isNull()
    return both.select(*[
        F.when(inserted, F.col(f"__s_{c}")).otherwise(updated(c)).alias(c) for c in target.columns
    ])


def known_rows(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows that can match ``rows``.

    A small frame reduces the target to its keys without shuffling it; what is left is no
    larger than the frame. For a large one the target stays whole.
    """
    if is_small(rows):
        return target.join(rows.select(*keys), keys, "left_semi")
    return target


def _new_keys(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target lacks."""
    return rows.join(known_rows(target.select(*keys), rows, keys), keys, "left_anti")


def insert_ignore(
    target: DataFrame, source: DataFrame, keys: list[str]
) -> DataFrame:
    """Add rows of unknown keys; existing rows win."""
    return target.unionByName(_new_keys(target, _aligned(source, target, source.columns), keys))


def new_snapshot_rows(
    history: DataFrame, current: DataFrame, keys: list[str], day_column: str, day: Column
) -> DataFrame:
    """Rows of today's picture that are not in the snapshot history yet.

    Only the history of that day is read, which is one partition of a table kept by day.
    """
    taken = history.filter(F.col(day_column) == day)
    picture = current.withColumn(day_column, day)
    return _new_keys(taken, picture.select(*history.columns), [day_column, *keys])


def append_snapshot(
    history: DataFrame, current: DataFrame, keys: list[str], day_column: str, day: Column
) -> DataFrame:
    return history.unionByName(new_snapshot_rows(history, current, keys, day_column, day))


def reload_range(
    target: DataFrame, new: DataFrame, day_column: str, low: Column, high: Column
) -> DataFrame:
    """Replace all days of the range, also days without new rows.

    Nothing is deleted when there are no new rows at all.
    """
    if new.isEmpty():
        return target
    # Spelled out so that it reaches the scan and prunes partitions.
    outside = (F.col(day_column) < low) | (F.col(day_column) > high) | F.col(day_column).isNull()
    return target.filter(outside).unionByName(_aligned(new, target, new.columns))
