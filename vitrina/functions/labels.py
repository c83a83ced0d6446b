"""Flags, bins, traffic lights and code labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.numbers import ColumnLike, as_column

# How a BIT column appears in exported text.
TRUE_MARKS = ("1", "0x01", "True", "true")
FALSE_MARKS = ("0", "0x00", "False", "false")

# Right-closed bins as (upper bound, label) above an exclusive lower bound.
STOCKOUT_BINS = (-1, ((0, "Sin quiebre"), (5, "Bajo"), (15, "Medio"), (100, "Alto")))
PLANOGRAM_BINS = (-1, ((49, "Bajo"), (79, "Medio"), (100, "Alto")))

# Fixed values: (green, yellow) thresholds of the traffic lights.
VISIT_LEVELS = (80, 60)
START_LEVELS = (70, 40)
END_LEVELS = (50, 25)
PLANOGRAM_LEVELS = (80, 50)
STOCKOUT_LEVELS = (10, 5)
NEAR_STOCKOUT_LIMIT = 5
MANAGERIAL_LEVELS = (85, 70)
MANAGERIAL_STOCKOUT_LIMIT = 15

OWN = "Propio"
COMPETITOR = "Competencia"


def bit(c: ColumnLike) -> Column:
    """Exported BIT text to boolean, NULL for anything else."""
    mark = as_column(c).cast("string")
    return F.when(mark.isin(*TRUE_MARKS), True).when(mark.isin(*FALSE_MARKS), False)


def binned(c: ColumnLike, bins: tuple[float, tuple[tuple[float, str], ...]]) -> Column:
    """Label of the right-closed bin; NULL counts as 0, out of range gives NULL."""
    value = F.coalesce(as_column(c), F.lit(0))
    below, steps = bins
    label = F.when(F.isnan(value.cast("double")) | (value <= below), F.lit(None))
    for upper, name in steps:
        label = label.when(value <= upper, name)
    return label


def at_least(c: ColumnLike, limit: float) -> Column:
    """Boolean, false for NULL and NaN."""
    value = as_column(c).cast("double")
    return F.coalesce((value >= limit) & ~F.isnan(value), F.lit(False))


def level(c: ColumnLike, limits: tuple[float, float], higher_is_better: bool = True) -> Column:
    """``green`` / ``yellow`` / ``red``; NULL counts as 0."""
    value = F.coalesce(as_column(c), F.lit(0))
    strict, loose = limits
    if higher_is_better:
        return F.when(value >= strict, "green").when(value >= loose, "yellow").otherwise("red")
    return F.when(value > strict, "red").when(value > loose, "yellow").otherwise("green")


def over(c: ColumnLike, limit: float, above: str, within: str = "green") -> Column:
    """Two-step light: ``above`` the limit or ``within`` it; NULL counts as 0."""
    return F.when(F.coalesce(as_column(c), F.lit(0)) > limit, above).otherwise(within)


def price_kind(is_own: ColumnLike = "is_propio") -> Column:
    """Own or competitor; an unknown owner counts as competitor."""
    return F.when(as_column(is_own).cast("int") == 1, OWN).otherwise(COMPETITOR)


def price_kind_or_unknown(is_own: ColumnLike = "is_propio", unknown: str = "Sin dato") -> Column:
    flag = as_column(is_own)
    return F.when(flag, OWN).when(~flag, COMPETITOR).otherwise(unknown)


def workday_event(code: ColumnLike = "tipo") -> Column:
    code = as_column(code)
    return F.when(code == 0, "Check-in").when(code == 1, "Check-out").otherwise(code.cast("string"))


def is_supervisor(username: ColumnLike = "username") -> Column:
    return F.coalesce(as_column(username).rlike(r"^PRC0\d{2}$"), F.lit(False))
