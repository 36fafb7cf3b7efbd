"""Text and feed-value clean-up as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the date layout of the sales feed. One-digit parts are accepted.
FEED_DATE_LAYOUT = "d/M/yyyy"


def strip_text(column: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` only removes blanks)."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def standard_text(column: Column) -> Column:
    """Comparable form of a text: stripped, upper case, null as the empty text."""
    return F.coalesce(F.upper(strip_text(column.cast("string"))), F.lit(""))


def blank_to(column: Column, replacement: Column) -> Column:
    """``replacement`` where the text is null or empty."""
    return F.when(F.coalesce(column, F.lit("")) == "", replacement).otherwise(column)


def feed_date(column: Column, layout: str = FEED_DATE_LAYOUT) -> Column:
    """Date of a feed text; null where it is no date."""
    return F.try_to_date(column, layout)


def feed_number(column: Column, precision: int = 18, scale: int = 4) -> Column:
    """Decimal of a feed text; null where it is no number."""
    return column.try_cast(f"decimal({precision},{scale})")


def feed_integer(column: Column) -> Column:
    return column.try_cast("bigint")
