"""Validity-interval history: as-of join, current rows, overlap check, maintenance.

Intervals are closed days ``[start, end]``; an open version ends on 9999-12-31.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewell.operators.keys import pick_one

OPEN_END = "9999-12-31"  # fixed value


def open_end() -> Column:
    return F.lit(OPEN_END).cast("date")


def point_in_time(
    fact: DataFrame, history: DataFrame, on: dict[str, str], day: str,
    start: str, end: str, take: dict[str, str], window: tuple[Column, Column] | None = None,
    by_year: bool = False,
) -> DataFrame:
    """Left join of each fact row to the version valid on its day, in one join condition.

    ``on`` maps fact columns to history columns. A key whose versions overlap repeats fact
    rows (see :func:`overlap_report`).

    ``window`` (first and last day of the fact) drops versions that cannot match. With
    ``by_year`` versions are also cut into one piece per year of the window and the year
    joins the equality keys: a key with very many versions is then compared with those of
    one year only, and the rows of a hot key spread over its years.
    """
    if by_year and window is None:
        raise ValueError("by_year needs the window of the fact")
    keys = {own: f"__key{i}" for i, own in enumerate(on)}
    versions = history.select(
        *[F.col(theirs).alias(keys[own]) for own, theirs in on.items()],
        F.col(start).alias("__start"), F.col(end).alias("__end"),
        *[F.col(source).alias(new) for source, new in take.items()],
    )
    condition = reduce(and_, [F.col(own) == F.col(name) for own, name in keys.items()])
    helpers = [*keys.values(), "__start", "__end"]
    if window is not None:
        low, high = window
        versions = versions.filter((F.col("__start") <= high) & (F.col("__end") >= low))
    if by_year:
        versions = versions.withColumn("__year", F.explode(F.sequence(
            F.greatest(F.year("__start"), F.year(low)), F.least(F.year("__end"), F.year(high))
        )))
        condition = condition & (F.year(day) == F.col("__year"))
        helpers.append("__year")
    valid = F.col(day).between(F.col("__start"), F.col("__end"))
    return fact.join(versions, condition & valid, "left").drop(*helpers)


def day_window(fact: DataFrame, day: str) -> tuple[Column, Column]:
    """First and last day of a fact as scalar subqueries."""
    return (
        fact.select(F.min(day)).scalar(),
        fact.select(F.max(day)).scalar(),
    )


def current_rows(history: DataFrame, as_of: Column, end: str) -> DataFrame:
    """Versions that have not ended before ``as_of``."""
    return history.filter(F.col(end) >= as_of)


def overlap_report(history: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Start days at which a key's history overlaps an earlier version or leaves a gap.

    Versions are first reduced to one row per key and start day, so a window partition
    holds at most one row per calendar day whatever the number of versions. Columns:
    keys, the start day, ``versiones`` (starting that day), ``fin_anterior`` (latest end
    among earlier starts), ``estado`` (``SOLAPE`` or ``HUECO``) and ``dias``.
    """
    days = history.groupBy(*keys, start).agg(
        F.count("*").alias("versiones"), F.max(end).alias("__end"), F.min(end).alias("__first_end")
    )
    earlier = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    checked = days.withColumn("fin_anterior", F.max("__end").over(earlier))
    covered = F.greatest(
        # days shared with earlier starts, and among versions of the same start
        F.when(
            F.col("fin_anterior").isNotNull(),
            F.datediff(F.least("fin_anterior", "__end"), F.col(start)) + 1,
        ),
        F.when(F.col("versiones") > 1, F.datediff("__first_end", F.col(start)) + 1),
    )
    gap = F.datediff(F.col(start), F.col("fin_anterior")) - 1
    state = F.when(covered > 0, "SOLAPE").when(gap > 0, "HUECO")
    return (
        checked.withColumn("estado", state)
        .filter(F.col("estado").isNotNull())
        .select(
            *keys, start, "versiones", "fin_anterior", "estado",
            F.when(F.col("estado") == "SOLAPE", covered).otherwise(gap).cast("int").alias("dias"),
        )
    )


def close_overlaps(history: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """History in which a later start ends the versions before it, so no fact row is repeated.

    Among versions of one start day the one that ends last stays. A version cut short does
    not come back after the one that cut it. The window sees one row per key and start day.
    """
    starts = pick_one(history, [*keys, start], [end])
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return starts.withColumn("__next", F.date_sub(following, 1)).withColumn(
        end, F.when(F.col("__next") < F.col(end), F.col("__next")).otherwise(F.col(end))
    ).drop("__next")


def apply_changes(
    history: DataFrame, incoming: DataFrame, keys: list[str], tracked: list[str],
    start: str, end: str, as_of: Column,
) -> DataFrame:
    """New history after a feed: changed keys close their open version and open a new one.

    ``incoming`` has one row per key. Keys that are absent from it and closed versions stay
    as they are. A version opened on ``as_of`` itself is replaced instead of closed, so a
    second run on the same day, or with the same feed, changes nothing more. Only open
    versions take part in the join. Other columns of the history are null in new versions.
    """
    columns = history.columns
    ended = history.filter(F.col(end) != open_end())
    current = history.filter(F.col(end) == open_end()).select(
        F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in columns]
    )
    feed = incoming.select(
        F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in keys + tracked]
    )
    both = current.join(
        feed, reduce(and_, [F.col(f"__o_{k}") == F.col(f"__n_{k}") for k in keys]), "full_outer"
    )
    was, now = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    differs = reduce(or_, [~F.col(f"__o_{c}").eqNullSafe(F.col(f"__n_{c}")) for c in tracked])
    changed = was & now & differs
    opened_today = F.col(f"__o_{start}") >= as_of

    def old_value(c: str) -> Column:
        if c == end:
            return F.when(changed, F.date_sub(as_of, 1)).otherwise(F.col(f"__o_{end}"))
        return F.col(f"__o_{c}")

    def new_value(c: str) -> Column:
        if c in keys or c in tracked:
            return F.col(f"__n_{c}")
        return {start: as_of, end: open_end()}.get(c, F.lit(None))

    def version(value) -> Column:
        return F.struct(*[value(c).cast(history.schema[c].dataType).alias(c) for c in columns])

    versions = F.array(
        F.when(was & ~(changed & opened_today), version(old_value)),
        F.when(changed | (now & ~was), version(new_value)),
    )
    return ended.unionByName(
        both.select(F.explode(F.array_compact(versions)).alias("__v")).select("__v.*")
    )


def apply_dated(
    history: DataFrame, changes: DataFrame, keys: list[str], tracked: list[str],
    start: str, end: str, id_column: str,
) -> DataFrame:
    """New history after changes that each say from which day on they hold, in any order of days.

    ``history`` has one row per key and start and no overlaps, ``changes`` the keys, ``tracked`` and
    ``start``, at most one row per key and day. From its day on a change holds until the key's next start:
    * inside a version it splits it: the old part ends the day before, the new one ends where the version did;
    * on the start of a version it corrects that version, which keeps its id;
    * before the first version or in a gap it opens a version that ends before the next start, or never;
    * if it says what already holds on its day, it changes nothing, so a second run changes nothing.

    Untracked columns of a split version carry over. Versions that were there keep their id, new ones have
    none (see ``keys.assign_ids``). All rows of a key meet once, ordered by day: one shuffle by the key.
    """
    columns = history.columns
    own = history.select(*keys, start, F.struct(*columns).alias("__h"))
    fresh = changes.select(*keys, F.col(start).cast(history.schema[start].dataType).alias(start), F.struct(*[
        F.col(c).cast(history.schema[c].dataType).alias(c) for c in tracked]).alias("__c"))
    events = own.unionByName(fresh, allowMissingColumns=True).repartition(*keys).groupBy(*keys, start).agg(
        F.max("__h").alias("__h"), F.max("__c").alias("__c"))
    by_day = Window.partitionBy(*keys).orderBy(start)
    covering = F.last("__h", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("__version", covering).withColumn(
        "__covered", F.coalesce(F.col(f"__version.{end}") >= F.col(start), F.lit(False)))
    events = events.withColumns({
        "__values": F.coalesce("__c", F.struct(*[F.col(f"__h.{c}").alias(c) for c in tracked])),
        "__end": F.when(F.col("__covered"), F.col(f"__version.{end}")).otherwise(open_end()),
    })
    says_nothing = (
        F.col("__h").isNull()
        & F.lag("__values").over(by_day).eqNullSafe(F.col("__values"))
        & (F.lag("__end").over(by_day) >= F.col(start))
    )
    kept = events.withColumn("__idle", says_nothing).filter(~F.coalesce("__idle", F.lit(False)))
    until = F.date_sub(F.lead(start).over(by_day), 1)
    kept = kept.withColumn("__until", F.least("__end", until))

    def value(c: str) -> Column:
        if c in keys or c == start:
            return F.col(c)
        if c == end:
            return F.col("__until").alias(end)
        if c in tracked:
            return F.col(f"__values.{c}").alias(c)
        if c == id_column:
            return F.col(f"__h.{c}").alias(c)
        return F.when(F.col("__covered"), F.col(f"__version.{c}")).alias(c)

    return kept.select(*map(value, columns))


def upkeep_report(before: DataFrame, after: DataFrame, keys: list[str], tracked: list[str], start: str, end: str) -> DataFrame:
    """What an upkeep did, one row per version touched: ``ABIERTA``, ``CERRADA`` or ``CORREGIDA``, and its ends."""
    old = before.select(
        F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in [*keys, start, end, *tracked]])
    same = reduce(and_, [F.col(c) == F.col(f"__o_{c}") for c in [*keys, start]])
    corrected = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in tracked])
    state = F.when(F.col("__old").isNull(), "ABIERTA").when(corrected, "CORREGIDA").when(
        F.col(end) != F.col(f"__o_{end}"), "CERRADA")
    return after.join(old, same, "left").withColumn("estado", state).filter(F.col("estado").isNotNull()).select(
        "estado", *keys, start, F.col(f"__o_{end}").alias("fin_anterior"), end, *tracked)
