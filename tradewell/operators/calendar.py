"""The business calendar, one row per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewell.functions.dates import day_name, holidays_of, month_name, two_month_period

# The span of the calendar table.
FIRST_DAY = "2020-01-01"
LAST_DAY = "2030-12-31"


def date_spine(spark: SparkSession, first: str = FIRST_DAY, last: str = LAST_DAY) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY")
    )).alias("fecha_sk"))


def spine_over(df: DataFrame, day: str) -> DataFrame:
    """All days of the calendar years a frame's dates span."""
    years = df.agg(
        F.trunc(F.min(day), "year").alias("__first"),
        F.last_day(F.add_months(F.trunc(F.max(day), "year"), 11)).alias("__last"),
    ).filter(F.col("__first").isNotNull())
    return years.select(F.explode(F.sequence(
        "__first", "__last", F.expr("INTERVAL 1 DAY")
    )).alias("fecha_sk"))


def business_calendar(spine: DataFrame) -> DataFrame:
    """Calendar columns for the days of a spine, which must cover whole months.

    The weekend is Sunday; business days are Monday to Saturday without holidays, numbered
    within the month (null on other days). Windows are one month wide.
    """
    day = F.col("fecha_sk")
    days = spine.withColumn("anio", F.year(day))
    marked = (
        days.join(holidays_of(days, "anio"), day == F.col("festivo"), "left")
        .withColumn("es_festivo", F.col("festivo").isNotNull())
        .withColumn("es_dia_habil", (F.weekday(day) < 6) & ~F.col("es_festivo"))
        .withColumn("__month", F.trunc(day, "month"))
    )
    business = F.col("es_dia_habil").cast("int")
    month = Window.partitionBy("__month")
    so_far = month.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.select(
        day, day.alias("fecha_completa"), "anio", F.month(day).alias("mes_del_anio"),
        month_name(day).alias("nombre_mes"), F.quarter(day).alias("trimestre_del_anio"),
        two_month_period(day).alias("bimestre_del_anio"),
        F.weekofyear(day).alias("semana_del_anio"), F.dayofmonth(day).alias("dia_del_mes"),
        day_name(day).alias("nombre_dia"), (F.weekday(day) == 6).alias("es_fin_de_semana"),
        "es_dia_habil", "es_festivo",
        F.when(F.col("es_dia_habil"), F.sum(business).over(so_far)).cast("int").alias("dia_habil_del_mes"),
        F.sum(business).over(month).cast("int").alias("total_dias_habiles_mes"),
    )
