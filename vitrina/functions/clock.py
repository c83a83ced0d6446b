"""Times of day, durations, HH:MM text and calendar columns.

Durations are whole microseconds (BIGINT): sums of them are exact and independent of
row order. Everything works on TIMESTAMP_NTZ without going through the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.numbers import ColumnLike, as_column

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND


def micros_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Microseconds from ``start`` to ``end``; negative when ``end`` comes first."""
    span = (as_column(end) - as_column(start)).cast("interval second")
    return (span.cast("decimal(18,6)") * F.lit(MICROS_PER_SECOND)).cast("bigint")


def micros_of_day(moment: ColumnLike) -> Column:
    moment = as_column(moment).cast("timestamp_ntz")
    return micros_between(moment.cast("date").cast("timestamp_ntz"), moment)


def hours(micros: ColumnLike) -> Column:
    return as_column(micros) / F.lit(float(MICROS_PER_HOUR))


def _two_digits(n: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(2)), F.lit("0"))


def hhmm_from_minutes(minutes: ColumnLike) -> Column:
    whole = F.floor(as_column(minutes)).cast("bigint")
    return F.concat(_two_digits(F.floor(whole / 60)), F.lit(":"), _two_digits(whole % 60))


def hhmm(seconds: ColumnLike) -> Column:
    """Seconds to HH:MM, cut to the minute."""
    return hhmm_from_minutes(as_column(seconds) / F.lit(60.0))


def minutes_of(text: ColumnLike) -> Column:
    """HH:MM text, with two or more digits for the hours, to minutes; other text gives NULL."""
    text = as_column(text)
    parts = F.split(text, ":")
    return F.when(text.rlike(r"^\d{2,}:\d{2}$"), parts[0].try_cast("int") * 60 + parts[1].try_cast("int"))


def clock_text(moment: ColumnLike) -> Column:
    return F.date_format(as_column(moment), "HH:mm")


def date_text(moment: ColumnLike) -> Column:
    return F.date_format(as_column(moment), "dd/MM/yyyy")


def period_text(year: ColumnLike = "anio", month: ColumnLike = "mes") -> Column:
    """``YYYY-MM``"""
    return F.concat_ws("-", as_column(year).cast("string"), _two_digits(as_column(month)))


def year_month(year: ColumnLike = "anio", month: ColumnLike = "mes") -> Column:
    """Sortable integer ``YYYYMM``."""
    return as_column(year) * 100 + as_column(month)


def with_calendar(df: DataFrame, moment: str, week: bool = False, day_name: bool = False) -> DataFrame:
    """Add ``anio`` and ``mes``, optionally the ISO week ``semana`` and ``dia_semana``."""
    added = {"anio": F.year(moment), "mes": F.month(moment)}
    if week:
        added["semana"] = F.weekofyear(moment)
    if day_name:
        added["dia_semana"] = F.date_format(moment, "EEEE")
    return df.withColumns(added)


def first_of_month(day: ColumnLike) -> Column:
    return F.trunc(as_column(day), "MM")
