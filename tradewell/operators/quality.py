"""Checks that a store without constraints needs, gates and load metrics."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """Input that must match completely did not."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows (``filas``)."""
    return df.groupBy(*keys).agg(F.count("*").alias("filas")).filter(F.col("filas") > 1)


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: DataFrame
    column: str
    parent: DataFrame
    parent_column: str


def orphan_counts(foreign_keys: list[ForeignKey]) -> DataFrame:
    """One row per foreign key: ``fk``, orphan rows, distinct orphan values and nulls.

    A child is read once for all its keys: its rows become (fk, value) pairs, counted per pair
    before the join, so the join sees each value once. Values are compared as texts.
    """
    children: dict[int, list[ForeignKey]] = {}
    for fk in foreign_keys:
        children.setdefault(id(fk.child), []).append(fk)

    def pairs(own: list[ForeignKey]) -> DataFrame:
        return own[0].child.select(F.inline(F.array(*[
            F.struct(F.lit(fk.name).alias("fk"), F.col(fk.column).cast("string").alias("__v")) for fk in own
        ])))

    counts = reduce(DataFrame.unionByName, map(pairs, children.values())).groupBy("fk", "__v").agg(
        F.count("*").alias("__n"))
    names = foreign_keys[0].child.sparkSession.createDataFrame(
        [(fk.name, None, 0) for fk in foreign_keys], "fk string, __v string, __n long")
    known = reduce(DataFrame.unionByName, [fk.parent.select(
        F.lit(fk.name).alias("fk"), F.col(fk.parent_column).cast("string").alias("__v")) for fk in foreign_keys])
    lost = counts.unionByName(names).join(known.filter(F.col("__v").isNotNull()), ["fk", "__v"], "left_anti")
    null = F.col("__v").isNull()
    return lost.groupBy("fk").agg(
        F.coalesce(F.sum(F.when(~null, F.col("__n"))), F.lit(0)).alias("filas_huerfanas"),
        F.count_if(~null).alias("valores_huerfanos"),
        F.coalesce(F.sum(F.when(null, F.col("__n"))), F.lit(0)).alias("filas_nulas"),
    )


@dataclass(frozen=True)
class ColumnRule:
    """What the table definition demands of a column."""

    name: str
    required: bool = False
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None


def column_profile(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """One row per rule from a single pass: rows, nulls, longest text and violations.

    ``largos`` counts texts over the declared length, ``fuera_de_rango`` numbers with more
    integer digits than the declared precision leaves.
    """

    def measures(rule: ColumnRule) -> Column:
        value = F.col(rule.name)
        length = F.length(value.cast("string"))
        zero = F.lit(0).cast("bigint")
        too_long = F.count_if(length > rule.max_length) if rule.max_length else zero
        beyond = (
            F.count_if(F.abs(value) >= F.lit(Decimal(10) ** (rule.precision - (rule.scale or 0))))
            if rule.precision else zero
        )
        nulls = F.count_if(value.isNull())
        return F.struct(
            F.lit(rule.name).alias("columna"),
            F.count(F.lit(1)).alias("filas"),
            nulls.alias("nulos"),
            F.coalesce(F.max(length), F.lit(0)).cast("bigint").alias("largo_maximo"),
            too_long.alias("largos"),
            beyond.alias("fuera_de_rango"),
            ((nulls if rule.required else zero) + too_long + beyond).alias("violaciones"),
        )

    return df.agg(F.array(*map(measures, rules)).alias("__r")).select(F.inline("__r"))


def unmatched(
    df: DataFrame, table: DataFrame, on: dict[str, str], null_safe: bool = False
) -> DataFrame:
    """Rows without a match in the table; a null key only matches when ``null_safe``."""
    keys = table.select(*[F.col(theirs).alias(f"__{own}") for own, theirs in on.items()])
    equal = Column.eqNullSafe if null_safe else Column.__eq__
    condition = reduce(and_, [equal(F.col(own), F.col(f"__{own}")) for own in on])
    return df.join(keys, condition, "left_anti")


def gate(report: DataFrame, what: str) -> None:
    """Stop when the report has rows. Nothing has been written by then."""
    if not report.isEmpty():
        raise GateError(f"{what}: unmatched rows, nothing was loaded")


def load_metrics(df: DataFrame, reason: str) -> DataFrame:
    """Read, valid and rejected row counts of an enriched load in one pass."""
    return df.agg(
        F.count("*").alias("leidas"),
        F.count_if(F.col(reason).isNull()).alias("validas"),
        F.count_if(F.col(reason).isNotNull()).alias("rechazadas"),
    )


def observed(df: DataFrame, reason: str) -> tuple[DataFrame, Observation]:
    """The same rows, and the counts of ``load_metrics`` taken while some action computes them.

    The load itself counts, so no second pass over the rows is needed. ``Observation.get`` waits for the
    first action on the frame.
    """
    counts = Observation("carga")
    return df.observe(
        counts, F.count(F.lit(1)).alias("leidas"), F.count_if(F.col(reason).isNull()).alias("validas"),
        F.count_if(F.col(reason).isNotNull()).alias("rechazadas"),
    ), counts


def observed_metrics(spark: SparkSession, counts: Observation) -> DataFrame:
    """The counts of an observed load that has run, as the one row of ``load_metrics``."""
    found = counts.get
    names = ("leidas", "validas", "rechazadas")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))
