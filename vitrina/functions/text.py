"""Text repair and name normalisation."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.numbers import ColumnLike, as_column
from vitrina.functions.place_names import (
    BROKEN_TEXT,
    CHAINS_AT_INGEST,
    CHAINS_IN_REPORTS,
    MUNICIPALITIES,
    STATES,
)

NO_DATA = "Sin dato"


def repair_text(c: ColumnLike) -> Column:
    """Undo UTF-8 text that was once read as Latin-1. Every occurrence is replaced, in the
    order of the table; text without a marker character skips the whole chain."""
    c = as_column(c)
    fixed = reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), BROKEN_TEXT, c)
    return F.when(F.contains(c, F.lit("Ã")) | F.contains(c, F.lit("Â")), fixed).otherwise(c)


def looks_broken(c: ColumnLike) -> Column:
    return as_column(c).like("%Ã%")


def looked_up(key: Column, names: dict[str, str]) -> Column:
    """Value of a constant dictionary, NULL when the key is absent. The map folds into one
    literal, so the generated code does not grow with the dictionary."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.try_element_at(literal, key)


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(F.trim(as_column(c)), F.lit(""))


def or_default(c: ColumnLike, default: str = NO_DATA) -> Column:
    return F.coalesce(as_column(c), F.lit(default))


def report_chain(c: ColumnLike) -> Column:
    """Chain name for reports: known spellings, ``Sin cadena`` when missing, else as is."""
    name = F.trim(as_column(c))
    missing = name.isNull() | (name == "") | (F.upper(name) == "NAN")
    return F.coalesce(
        looked_up(F.upper(name), CHAINS_IN_REPORTS),
        F.when(missing, F.lit("Sin cadena")).otherwise(name),
    )


def clean_chain(c: ColumnLike) -> Column:
    """Chain name at ingest: known spellings, NULL when missing, else as is."""
    name = F.trim(as_column(c))
    return F.coalesce(
        looked_up(F.upper(name), CHAINS_AT_INGEST), F.when(~name.isin("", "nan"), name)
    )


def clean_state(c: ColumnLike) -> Column:
    """State name: known spellings of the repaired text win over the junk guards, which
    look at the raw text (codes of up to two characters, digits, placeholders)."""
    raw = F.trim(as_column(c))
    fixed = F.trim(repair_text(c))
    junk = raw.isin("", "nan", "S/A") | (F.length(raw) <= 2) | raw.rlike("^[0-9]+$")
    return F.coalesce(looked_up(fixed, STATES), F.when(~junk, fixed))


def clean_municipality(c: ColumnLike) -> Column:
    raw = F.trim(as_column(c))
    fixed = F.trim(repair_text(c))
    return F.coalesce(looked_up(fixed, MUNICIPALITIES), F.when(~raw.isin("", "nan", "S/A"), fixed))
