"""Scalar expressions with the rounding, stripping and date rules that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space and the separators 0x1C-0x1F at either end.
EDGES = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole in doubles, rounded half up; null where whole is 0 or null."""
    return F.round(F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), digits)


def change_pct(now: Column, before: Column, digits: int = 1) -> Column:
    return F.when(before != 0, F.round(F.lit(100.0) * (now - before).cast("double") / before.cast("double"), digits))


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def maker_key(x: Column) -> Column:
    """Labels that differ only in case or outer white space are one maker."""
    return F.upper(strip(x))


def iso_date(x: Column) -> Column:
    """The date of a strict YYYY-MM-DD text, else null."""
    return F.when(x.rlike(ISO_DATE), x.try_cast("date"))


def year_month(year: Column, month: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two_digits(month))


def two_digits(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")


def optional(value, condition) -> Column:
    """condition(value) where a value is given; otherwise no condition at all, so nothing reaches the plan."""
    return F.lit(True) if value is None else condition(value)
