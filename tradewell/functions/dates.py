"""Calendar columns, month windows and the public holidays of Colombia."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spanish month and day names, capitalised.
MONTH_NAMES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]
DAY_NAMES = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]

# Public holidays by law, as (month, day) or days from Easter Sunday.
FIXED_HOLIDAYS = [(1, 1), (5, 1), (7, 20), (8, 7), (12, 8), (12, 25)]
MONDAY_HOLIDAYS = [(1, 6), (3, 19), (6, 29), (8, 15), (10, 12), (11, 1), (11, 11)]
EASTER_HOLIDAYS = [-3, -2, 43, 64, 71]


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(day))


def day_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.weekday(day) + 1)


def two_month_period(day: Column) -> Column:
    return F.ceil(F.month(day) / 2).cast("int")


def months_before(as_of: Column, months: int) -> Column:
    """First day of a recent-activity window; that day belongs to the window."""
    return F.add_months(as_of, -months)


def next_monday(day: Column) -> Column:
    """The day itself on a Monday, else the Monday after it."""
    return F.date_add(day, F.pmod(7 - F.weekday(day), F.lit(7)))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the Gauss/Knuth golden-number method, integer columns only."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b)).cast("int")

    golden = year % 19 + 1
    century = div(year, 100) + 1
    dropped_leaps = div(3 * century, 4) - 12
    lunar_shift = div(8 * century + 5, 25) - 5
    sunday = div(5 * year, 4) - dropped_leaps - 10
    raw_epact = F.pmod(11 * golden + 20 + lunar_shift - dropped_leaps, F.lit(30))
    epact = F.when(
        ((raw_epact == 25) & (golden > 11)) | (raw_epact == 24), raw_epact + 1
    ).otherwise(raw_epact)
    moon = F.when(44 - epact < 21, 74 - epact).otherwise(44 - epact)
    march_day = moon + 7 - F.pmod(sunday + moon, F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (march_day - 1).cast("int"))


def holidays_of(years: DataFrame, year: str) -> DataFrame:
    """Distinct holiday dates (column ``festivo``) of the years in a frame.

    Two rules can meet on one day, hence the distinct.
    """

    def on(month: int, day: int) -> Column:
        return F.make_date(F.col(year), F.lit(month), F.lit(day))

    easter = F.col("__easter")
    dates = (
        [on(m, d) for m, d in FIXED_HOLIDAYS]
        + [next_monday(on(m, d)) for m, d in MONDAY_HOLIDAYS]
        + [F.date_add(easter, n) for n in EASTER_HOLIDAYS]
    )
    return (
        years.select(year)
        .distinct()
        .withColumn("__easter", easter_sunday(F.col(year)))
        .select(F.explode(F.array(*dates)).alias("festivo"))
        .distinct()
    )
