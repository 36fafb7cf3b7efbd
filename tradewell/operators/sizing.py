"""Size checks behind the choice between a shuffling and a non-shuffling plan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame: above the truth for joins, below it for exploded arrays."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def _bytes_setting(df: DataFrame, name: str) -> int:
    raw = df.sparkSession.conf.get(name).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    digits = raw.rstrip("bkmg")
    suffix = raw[len(digits):]
    return int(digits) * (units[suffix[0]] if suffix else 1)


def broadcast_limit(df: DataFrame) -> int:
    """Bytes up to which Spark broadcasts by itself; -1 when that is switched off."""
    return _bytes_setting(df, "spark.sql.autoBroadcastJoinThreshold")


def is_small(df: DataFrame) -> bool:
    """Whether the frame fits below the size that Spark broadcasts without any hint.

    The estimate misses the rows that an exploded array adds, and knows nothing of local rows; there
    the rows are counted, up to the limit.
    """
    limit = broadcast_limit(df)
    plan = str(df._jdf.queryExecution().optimizedPlan().toString())
    if limit < 0 or not ("Generate " in plan or "LogicalRDD" in plan):
        return estimated_bytes(df) <= limit
    width = 8 + int(df._jdf.schema().defaultSize())
    return df.limit(limit // width + 1).count() <= limit // width
