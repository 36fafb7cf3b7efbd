"""Keyed comparison of two frames and of two extracts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.functions.text import standard_text, strip_text


def compare(
    ours: DataFrame, theirs: DataFrame, keys: list[str], columns: list[str],
    normalise: Callable[[Column], Column] = standard_text,
) -> DataFrame:
    """Full outer comparison, both sides unique by key; null keys match each other.

    Columns: the keys; ``lado`` (``NUESTRO``, ``SUYO`` or ``AMBOS``); ``cambios``, the names
    of compared columns whose normalised values differ; and each column as
    ``<name>_nuestro`` and ``<name>_suyo`` as it was delivered.
    """
    a = ours.select(
        F.lit(True).alias("__a"), *[F.col(k).alias(f"__a_{k}") for k in keys],
        *[F.col(c).alias(f"{c}_nuestro") for c in columns],
    )
    b = theirs.select(
        F.lit(True).alias("__b"), *[F.col(k).alias(f"__b_{k}") for k in keys],
        *[F.col(c).alias(f"{c}_suyo") for c in columns],
    )
    joined = a.join(
        b, reduce(and_, [F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in keys]), "full_outer"
    )
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    differs = [
        F.when(
            in_a & in_b
            & ~normalise(F.col(f"{c}_nuestro")).eqNullSafe(normalise(F.col(f"{c}_suyo"))),
            F.lit(c),
        )
        for c in columns
    ]
    return joined.select(
        *[F.coalesce(F.col(f"__a_{k}"), F.col(f"__b_{k}")).alias(k) for k in keys],
        F.when(in_a & in_b, "AMBOS").when(in_a, "NUESTRO").otherwise("SUYO").alias("lado"),
        F.array_compact(F.array(*differs)).alias("cambios"),
        *[F.col(f"{c}_{side}") for c in columns for side in ("nuestro", "suyo")],
    )


def change_report(
    stored: DataFrame, feed: DataFrame, keys: list[str], columns: list[str], name: str,
    removed: bool = False,
) -> DataFrame:
    """New and changed records of a feed: estado, keys, nombre_anterior, nombre_nuevo, cambios.

    ``removed`` adds the records the feed no longer has, as ``RETIRADO``.
    """
    diff = compare(stored, feed, keys, columns)
    state = F.when(F.col("lado") == "SUYO", "NUEVO").when(F.size("cambios") > 0, "MODIFICADO")
    if removed:
        state = state.when(F.col("lado") == "NUESTRO", "RETIRADO")
    return diff.select(
        state.alias("estado"), *keys,
        standard_text(F.col(f"{name}_nuestro")).alias("__before"),
        standard_text(F.col(f"{name}_suyo")).alias("__after"),
        F.concat_ws(",", "cambios").alias("cambios"), "lado",
    ).filter(F.col("estado").isNotNull()).select(
        "estado", *keys,
        F.when(F.col("lado") != "SUYO", F.col("__before")).alias("nombre_anterior"),
        F.when(F.col("lado") != "NUESTRO", F.col("__after")).alias("nombre_nuevo"),
        "cambios",
    )


# States and placeholders of the seller report.
NEW_IN_FEED = "NUEVO EN API"
MISSING_IN_FEED = "FALTA EN API (INACTIVO?)"
DOCUMENT_DIFFERS = "INCONSISTENCIA DE DOCUMENTO"
NOT_MANAGED = "No existe"
NOT_FOUND = "No encontrado"


def seller_report(managed: DataFrame, feed: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Managed roles against the sellers of the feed; a null document is a difference."""
    diff = compare(managed, feed, keys, [document], normalise=strip_text)
    ours, theirs = F.col(f"{document}_nuestro"), F.col(f"{document}_suyo")
    state = (
        F.when(F.col("lado") == "SUYO", NEW_IN_FEED)
        .when(F.col("lado") == "NUESTRO", MISSING_IN_FEED)
        .when(F.size("cambios") > 0, DOCUMENT_DIFFERS)
    )
    return diff.select(
        state.alias("estado"), *keys,
        F.when(F.col("lado") == "NUESTRO", NOT_FOUND).otherwise(theirs).alias("documento_en_api"),
        F.when(F.col("lado") == "SUYO", NOT_MANAGED).otherwise(ours).alias("documento_gestionado"),
    ).filter(F.col("estado").isNotNull())


def new_in_second(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Records of the second extract whose key the first lacks; null equals empty."""
    for name, df in (("first", first), ("second", second)):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"{name} extract lacks key columns {missing}")
    return second.na.fill("").join(first.select(*keys).na.fill(""), keys, "left_anti")


def first_rows(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows by key, for a report on screen."""
    return df.orderBy(*keys).limit(n)

