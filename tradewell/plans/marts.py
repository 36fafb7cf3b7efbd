"""Reports on the star schema.

Dimensions that may be broadcast are joined where the fact row is read; for larger ones the fact
is first reduced to its foreign keys and days, so a key that holds a large share of the rows
is one row per day when it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewell.operators.lookup import lookup
from tradewell.operators.scd2 import point_in_time
from tradewell.operators.sizing import is_small


def _typed(result: DataFrame, fact: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Sums of sums in the type of one sum, so that both formulations of a report agree."""
    types = fact.agg(*[F.sum(c).alias(n) for n, c in measures.items()], F.count("*").alias("lineas")).schema
    return result.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in types})


@dataclass(frozen=True)
class Star:
    """A dimension of a report: its key, the fact's key and the attributes to take."""

    table: DataFrame
    fk: str
    key: str
    take: dict[str, str]


def sums_by(
    fact: DataFrame, measures: dict[str, Column], stars: list[Star], by: list[str],
    own: dict[str, Column] | None = None,
) -> DataFrame:
    """Sums of ``measures`` and row count ``lineas`` by fact columns and dimension attributes.

    ``own`` are grouping columns computed on the fact. A fact key without a dimension row
    keeps its measures under null attributes. Dimensions that are all small enough to be
    broadcast are joined to the fact rows, which are then shuffled once, reduced. Otherwise
    the fact is first reduced to its foreign keys.
    """
    own = own or {}
    columns = [c.alias(name) for name, c in own.items()]
    fks = list(dict.fromkeys(star.fk for star in stars if star.fk in fact.columns))
    fks = [fk for fk in fks if fk not in own]
    if all(is_small(star.table) for star in stars):
        rows = fact.select(*fks, *columns, *[c.alias(f"__{n}") for n, c in measures.items()])
        for star in stars:
            rows = lookup(rows, star.table, {star.fk: star.key}, star.take)
        return rows.groupBy(*by).agg(
            *[F.sum(f"__{n}").alias(n) for n in measures], F.count("*").alias("lineas")
        )
    result = fact.groupBy(*fks, *columns).agg(
        *[F.sum(c).alias(name) for name, c in measures.items()], F.count("*").alias("lineas")
    )
    for star in stars:
        result = lookup(result, star.table, {star.fk: star.key}, star.take)
    return _typed(result.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in measures], F.sum("lineas").alias("lineas")
    ), fact, measures)


def rollup_levels(grouped: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Subtotals of an already grouped frame; ``nivel`` is the number of rolled-up columns.

    Rolling up groups instead of fact rows keeps the row multiplication off the fact.
    """
    return grouped.rollup(*by).agg(
        *[F.sum(m).alias(m) for m in measures],
        sum((F.grouping(c).cast("int") for c in by), F.lit(0)).alias("nivel"),
    )


def sales_rollup(
    fact: DataFrame, measures: dict[str, Column], stars: list[Star], by: list[str],
    own: dict[str, Column] | None = None,
) -> DataFrame:
    grouped = sums_by(fact, measures, stars, by, own)
    return rollup_levels(grouped, by, [*measures, "lineas"])


def with_margin(sums: DataFrame, base: str = "valor_base", cost: str = "costo_total") -> DataFrame:
    """Adds the difference of two sums, and it as a share of the base."""
    difference = F.col(base) - F.col(cost)
    return sums.withColumn("margen", difference).withColumn(
        "margen_pct", F.try_divide(difference.cast("double"), F.col(base).cast("double"))
    )


def margin(
    fact: DataFrame, base: Column, cost: Column, stars: list[Star], by: list[str],
    own: dict[str, Column] | None = None,
) -> DataFrame:
    """Base value, cost and their difference, with the margin as a share of the base."""
    return with_margin(sums_by(fact, {"valor_base": base, "costo_total": cost}, stars, by, own))


def margin_by_price(
    fact: DataFrame, base: Column, quantity: Column, product: Star, price: Column, by: list[str],
    own: dict[str, Column] | None = None,
) -> DataFrame:
    """``margin`` where the cost of a unit is the product's: quantities are summed per product before its row is met.

    ``price`` is a column over what ``product`` takes.
    """
    own = own or {}
    sums = sums_by(fact, {"valor_base": base, "__cantidad": quantity}, [], [product.fk, *own], own | {product.fk: F.col(product.fk)})
    costed = lookup(sums, product.table, {product.fk: product.key}, product.take)
    total = price * F.col("__cantidad")
    return with_margin(costed.groupBy(*by).agg(
        F.sum("valor_base").alias("valor_base"), F.sum(total).alias("costo_total"), F.sum("lineas").alias("lineas")))


def returns(
    fact: DataFrame, is_return: Column, reason: Column, value: Column, units: Column, day: str
) -> DataFrame:
    """Returned lines, units and value by reason and year."""
    return fact.filter(is_return).groupBy(
        reason.alias("motivo_devolucion"), F.year(day).alias("anio")
    ).agg(
        F.count("*").alias("lineas"), F.sum(units).alias("cantidad"), F.sum(value).alias("valor")
    )


def stock_trend(snapshots: DataFrame, keys: list[str], day: str, quantity: str) -> DataFrame:
    """Quantity per key and snapshot, the one before and the difference.

    The window runs over one row per key and snapshot day.
    """
    per_day = snapshots.groupBy(*keys, day).agg(F.sum(quantity).alias("cantidad"))
    before = F.lag("cantidad").over(Window.partitionBy(*keys).orderBy(day))
    return per_day.withColumn("cantidad_anterior", before).withColumn(
        "variacion", F.col("cantidad") - F.col("cantidad_anterior")
    )


def drill_across(
    left: DataFrame, right: DataFrame, keys: list[str], left_sum: dict[str, Column],
    right_sum: dict[str, Column],
) -> DataFrame:
    """Measures of two facts side by side on a shared dimension; each is summed first."""
    a = left.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in left_sum.items()])
    b = right.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in right_sum.items()])
    return a.join(b, keys, "full_outer")


def pacing(
    fact: DataFrame, day: str, value: Column, calendar: DataFrame, by: list[str]
) -> DataFrame:
    """Sales of the month to date against the share of its business days that have passed.

    One row per group and day with sales. ``dias_habiles`` is the number of business days up
    to that day. The window holds the days of one month.
    """
    daily = fact.groupBy(*by, F.col(day).alias("fecha_sk")).agg(F.sum(value).alias("valor_dia"))
    elapsed = Window.partitionBy("__month").orderBy("fecha_sk").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    days = calendar.withColumn("__month", F.trunc("fecha_sk", "month")).select(
        F.col("fecha_sk").alias("__day"),
        F.coalesce(F.max("dia_habil_del_mes").over(elapsed), F.lit(0)).alias("dias_habiles"),
        "total_dias_habiles_mes",
    )
    joined = daily.join(days, F.col("fecha_sk") == F.col("__day")).drop("__day")
    to_date = Window.partitionBy(*by, F.trunc("fecha_sk", "month")).orderBy("fecha_sk").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return joined.withColumn("valor_acumulado", F.sum("valor_dia").over(to_date)).withColumn(
        "avance_dias", F.col("dias_habiles") / F.col("total_dias_habiles_mes")
    )


def sums_as_of(
    fact: DataFrame, key: str, day: str, measures: dict[str, Column], history: DataFrame,
    on: str, start: str, end: str, take: dict[str, str], by: dict[str, Column] | None = None,
) -> DataFrame:
    """Measures and ``lineas`` by the attributes valid on the day of the row, and by ``by``.

    A history too large to broadcast is joined to one row per key and day instead of to the
    fact rows. ``by`` may use the key, the day and taken attributes.
    """
    groups = [c.alias(n) for n, c in (by or {}).items()] or list(take.values())
    if is_small(history):
        rows = fact.select(key, day, *[c.alias(n) for n, c in measures.items()], F.lit(1).alias("lineas"))
    else:
        rows = fact.groupBy(key, day).agg(
            *[F.sum(c).alias(n) for n, c in measures.items()], F.count("*").alias("lineas")
        )
    dated = point_in_time(rows, history, {key: on}, day, start, end, take)
    return _typed(dated.groupBy(*groups).agg(
        *[F.sum(n).alias(n) for n in measures], F.sum("lineas").alias("lineas")
    ), fact, measures)


def category_as_of(
    fact: DataFrame, key: str, day: str, measures: dict[str, Column], history: DataFrame,
    categories: DataFrame, businesses: DataFrame,
) -> DataFrame:
    """Measures by business and category, with the category the product had at the sale.

    Expects the columns of map_producto_tq_categoria, dim_tq_categorias and dim_tq_negocios.
    """
    by_category = sums_as_of(
        fact, key, day, measures, history, "id_producto_fk",
        "fecha_inicio_validez", "fecha_fin_validez", {"id_categoria_tq_fk": "__category"},
    )
    named = lookup(by_category, categories, {"__category": "id_categoria_tq"}, {
        "nombre_categoria_tq": "nombre_categoria_tq", "id_negocio_tq_fk": "__business"})
    return lookup(named, businesses, {"__business": "id_negocio_tq"}, {
        "nombre_negocio_tq": "nombre_negocio_tq"}).drop("__category", "__business")


def portfolio_coverage(
    fact: DataFrame, seller: str, product: str, value: Column, products: DataFrame,
    product_key: str, line: str, portfolio: DataFrame, portfolio_seller: str, portfolio_line: str,
) -> DataFrame:
    """Sales per seller inside and outside the product lines of the seller's portfolio."""
    by_line = sums_by(
        fact, {"valor": value}, [Star(products, product, product_key, {line: "__line"})],
        [seller, "__line"], {seller: F.col(seller)},
    )
    allowed = portfolio.select(
        F.col(portfolio_seller), F.col(portfolio_line), F.lit(True).alias("__in")
    ).distinct()
    flagged = lookup(
        by_line, allowed, {seller: portfolio_seller, "__line": portfolio_line}, {"__in": "__in"}
    )
    inside = F.col("__in").isNotNull()
    zero = F.lit(0)
    return flagged.groupBy(seller).agg(
        F.coalesce(F.sum(F.when(inside, F.col("valor"))), zero).alias("valor_dentro"),
        F.coalesce(F.sum(F.when(~inside, F.col("valor"))), zero).alias("valor_fuera"),
        F.coalesce(F.sum(F.when(inside, F.col("lineas"))), zero).alias("lineas_dentro"),
        F.coalesce(F.sum(F.when(~inside, F.col("lineas"))), zero).alias("lineas_fuera"),
    )


def assortment_coverage(
    fact: DataFrame, client: str, product: str, assortment: DataFrame, category: str,
    assortment_product: str,
) -> DataFrame:
    """Products of an agreement category each client bought, of all in the category.

    Clients that bought nothing of a category have no row for it. A small assortment is
    joined first, which leaves few lines to reduce; for a large one each client's products
    are made distinct before they are shuffled for the join.
    """
    items = assortment.select(
        F.col(category).alias(category), F.col(assortment_product).alias("__product")
    ).distinct()
    totals = items.groupBy(F.col(category).alias("__category")).agg(
        F.count("*").alias("productos_surtido")
    )
    pairs, matches = fact.select(client, product), F.col(product) == F.col("__product")
    if is_small(items):
        bought = pairs.join(items, matches).select(client, category, product).distinct()
    else:
        bought = pairs.distinct().join(items, matches)
    counted = bought.groupBy(client, category).agg(F.count("*").alias("productos_comprados"))
    return counted.join(totals, F.col(category) == F.col("__category")).select(
        client, category, "productos_comprados", "productos_surtido",
        (F.col("productos_comprados") / F.col("productos_surtido")).alias("cobertura"),
    )
