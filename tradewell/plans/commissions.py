"""Indicators, attainment and payout of the commission model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.operators.hierarchy import weighted_tree
from tradewell.operators.sizing import is_small
from tradewell.session import ensure_checkpoint_dir

# Calculation kinds of a rule item and the scope that takes all lines.
SUM_OF_BASE = "SUMA_VALOR_BASE"
CLIENT_IMPACTS = "CONTEO_IMPACTOS_CLIENTE"
WEIGHTED_CHILDREN = "PROMEDIO_PONDERADO_HIJOS"
ALL_LINES = "TOTAL"


def _scopes(line: str) -> Column:
    """A line counts for its own scope and for the scope of all lines."""
    return F.explode(F.array(F.col(line), F.lit(ALL_LINES)))


def _items(items: DataFrame, kind: str) -> DataFrame:
    return items.filter(F.col("tipo_calculo") == kind).select(
        "id_item_regla", F.col("linea_aplicacion").alias("__scope")
    )


def sum_of_base(
    sales: DataFrame, role: str, period: str, line: str, value: str, items: DataFrame
) -> DataFrame:
    """Base value by rule item, role and period.

    Items that may be broadcast meet the rows where they are read, and one aggregate follows. For
    more items, lines are summed by role, period and line first; only those sums are doubled for their
    two scopes and shuffled to the items, so no scope holds a large share of the fact's rows.
    """
    wanted = _items(items, SUM_OF_BASE)
    kind = sales.agg(F.sum(value)).schema[0].dataType
    if is_small(wanted):
        rows = sales.select(role, period, F.col(value).alias("__v"), _scopes(line).alias("__scope"))
    else:
        sums = sales.groupBy(role, period, line).agg(F.sum(value).alias("__v"))
        rows = sums.select(role, period, "__v", _scopes(line).alias("__scope"))
    return rows.join(wanted, "__scope").groupBy("id_item_regla", role, period).agg(
        F.sum("__v").cast(kind).alias("valor_logrado"))


def client_impacts(
    sales: DataFrame, role: str, period: str, line: str, client: str, items: DataFrame
) -> DataFrame:
    """Distinct clients sold to by rule item, role and period; for many items, from distinct clients per line."""
    wanted = _items(items, CLIENT_IMPACTS)
    sold = sales.select(role, period, line, client)
    if not is_small(wanted):
        sold = sold.distinct()
    scoped = sold.select(role, period, client, _scopes(line).alias("__scope"))
    return (
        scoped.join(wanted, "__scope")
        .groupBy("id_item_regla", role, period)
        .agg(F.countDistinct(client).alias("valor_logrado"))
    )


def payout(share: Column) -> Column:
    """What an attainment pays of its parent: nothing below the item's minimum, at most its maximum."""
    zero = F.lit(0).cast("double")
    bounded = (
        F.when(share < F.coalesce(F.col("min_cumplimiento"), zero), zero)
        .otherwise(F.least(share, F.col("max_cumplimiento")))
    )
    return F.when(share.isNotNull(), bounded * F.col("peso_sobre_padre"))


def attainment(
    achieved: DataFrame, goals: DataFrame, rules: DataFrame, keys: list[str]
) -> DataFrame:
    """Achieved over goal, and the payout share of each goal.

    ``goals`` has ``keys`` and ``valor_meta``; ``rules`` has ``id_item_regla``,
    ``peso_sobre_padre``, ``min_cumplimiento`` and ``max_cumplimiento``. Below the minimum
    nothing is paid, above the maximum no more than the maximum. A goal nobody sold against
    counts as zero; a goal of zero has no attainment.
    """
    share = F.try_divide(F.col("valor_logrado").cast("double"), F.col("valor_meta").cast("double"))
    return (
        goals.join(achieved, keys, "left")
        .withColumn("valor_logrado", F.coalesce(F.col("valor_logrado"), F.lit(0)))
        .join(rules.select(
            "id_item_regla", "peso_sobre_padre", "min_cumplimiento", "max_cumplimiento"
        ), "id_item_regla")
        .select(
            *keys, "valor_logrado", "valor_meta",
            share.alias("porcentaje_cumplimiento"), payout(share).alias("porcentaje_liquidacion_final"),
        )
    )


def settlement(
    sales: DataFrame, items: DataFrame, goals: DataFrame, role: str, period: str, line: str, value: str, client: str
) -> DataFrame:
    """Results per goal and, above them, per item that averages its children.

    ``sales`` may be reduced to sums per role, period, line and client. ``goals`` has
    ``id_item_regla``, ``role``, ``period`` and ``valor_meta``; ``items`` the rule items' columns.
    The attainment of an averaging item is the weighted average of its children's, for each role
    and period that has any; its own thresholds and weight then give its payout.
    """
    keys = ["id_item_regla", role, period]
    measured = items.filter(F.col("tipo_calculo") != WEIGHTED_CHILDREN)
    achieved = sum_of_base(sales, role, period, line, value, items).select(
        *keys, F.col("valor_logrado").cast("decimal(38,4)").alias("valor_logrado")
    ).unionByName(client_impacts(sales, role, period, line, client, items).select(
        *keys, F.col("valor_logrado").cast("decimal(38,4)").alias("valor_logrado")
    ))
    own = attainment(achieved, goals, measured, keys).drop("valor_meta").checkpoint()
    placed = measured.select("id_item_regla", "id_item_padre_fk", "peso_sobre_padre").filter("id_item_padre_fk IS NOT NULL")
    leaves = own.select(
        *keys, F.col("porcentaje_cumplimiento").cast("decimal(18,4)").alias("porcentaje_cumplimiento")
    ).join(placed, "id_item_regla").drop("id_item_regla")
    averaging = items.filter(F.col("tipo_calculo") == WEIGHTED_CHILDREN)
    tree = weighted_tree(
        averaging.select("id_item_regla", "id_item_padre_fk", "peso_sobre_padre"), leaves,
        "id_item_regla", "id_item_padre_fk", "peso_sobre_padre", "porcentaje_cumplimiento", [role, period],
    )
    share = F.col("porcentaje_cumplimiento").cast("double")
    above = tree.join(averaging, "id_item_regla").select(
        *keys, F.lit(None).cast("decimal(38,4)").alias("valor_logrado"), share.alias("porcentaje_cumplimiento"),
        payout(share).alias("porcentaje_liquidacion_final"),
    )
    return own.unionByName(above)


def rule_products(items: DataFrame, parameters: str = "parametros_json") -> DataFrame:
    """One row per rule item and product of its JSON parameters, with the minimum quantity.

    Texts that are no JSON, or have no products, give no rows.
    """
    layout = "productos array<string>, minimo bigint"
    parsed = items.withColumn("__p", F.from_json(parameters, layout))
    return parsed.select(
        "id_item_regla", F.explode("__p.productos").alias("codigo_erp"),
        F.col("__p.minimo").alias("minimo"),
    ).distinct()


BAD_JSON = "ERROR"
_KINDS = {"STRING": "texto", "BOOLEAN": "logico", "VOID": "nulo"}  # every other scalar is a number


def rule_parameters(items: DataFrame, parameters: str = "parametros_json", item: str = "id_item_regla") -> DataFrame:
    """Every value in the rules' JSON, whatever its shape: (item, ``ruta``, ``tipo``, ``valor``, ``numero``).

    ``ruta`` is the value's path, as ``productos[2]`` or ``escalas[1][0]``; ``tipo`` is texto, numero, logico or
    nulo; ``valor`` the value as text and ``numero`` a number as decimal. Empty lists and objects are
    rows of tipo ``vacio``. A text that is no JSON is one row of tipo ``ERROR`` with the text itself; a null text
    has no rows. Containers are opened level by level, as many times as the deepest parameter has levels.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    texts = items.filter(F.col(parameters).isNotNull()).select(F.col(item), F.col(parameters).alias("__text"))
    parsed = texts.withColumn("__v", F.try_parse_json("__text"))
    none = F.lit(None).cast("decimal(38,10)")
    bad = parsed.filter(F.col("__v").isNull()).select(
        item, F.lit("").alias("ruta"), F.lit(BAD_JSON).alias("tipo"), F.col("__text").alias("valor"), none.alias("numero"))
    level = parsed.filter(F.col("__v").isNotNull()).select(item, F.lit("").alias("ruta"), "__v")
    found = [bad]
    while True:
        level = level.withColumn("__kind", F.schema_of_variant("__v")).checkpoint()
        nested = F.col("__kind").startswith("ARRAY") | F.col("__kind").startswith("OBJECT")
        kind = F.when(nested, "vacio").otherwise(F.coalesce(
            *[F.when(F.col("__kind") == k, F.lit(v)) for k, v in _KINDS.items()], F.lit("numero")))
        text = F.when(~nested, F.variant_get("__v", "$", "string"))
        empty = F.to_json("__v").isin("[]", "{}")
        found.append(level.filter(~nested | empty).select(
            item, "ruta", kind.alias("tipo"), text.alias("valor"),
            F.when(kind == "numero", F.try_variant_get("__v", "$", "decimal(38,10)")).alias("numero")))
        inner = level.filter(nested & ~empty)
        if inner.isEmpty():
            break
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(
            F.col("ruta") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = opened.select(item, F.concat("ruta", step).alias("ruta"), F.col("value").alias("__v"))
    return reduce(DataFrame.unionByName, found)
