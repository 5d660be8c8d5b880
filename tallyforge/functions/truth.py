"""Conditions that are written once and evaluated twice: over columns by Spark, or over one row's values by the driver.

A rule is (code, condition), where a condition combines a row's signals with &, | and ~. Signals are Columns, or Truths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Callable[[Any], Any]]


@dataclass(frozen=True)
class Truth:
    """A bool with the operators of a Column."""

    holds: bool

    def __and__(self, other: Truth) -> Truth:
        return Truth(self.holds and other.holds)

    def __or__(self, other: Truth) -> Truth:
        return Truth(self.holds or other.holds)

    def __invert__(self) -> Truth:
        return Truth(not self.holds)

    def __bool__(self) -> bool:
        return self.holds


def sure(condition: Column) -> Column:
    """The condition, false where it is null."""
    return F.coalesce(condition, F.lit(False))


def first_code(rules: Iterable[Rule], signals: Any) -> Column:
    """The code of the first rule that holds, null if none does. Signals are never null, see sure()."""
    return F.coalesce(*[F.when(condition(signals), F.lit(code)) for code, condition in rules])


def all_codes(rules: Iterable[Rule], signals: Any) -> Column:
    """The codes of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition(signals), F.lit(code)) for code, condition in rules]))


def first_held(rules: Iterable[Rule], signals: Any) -> str | None:
    return next((code for code, condition in rules if condition(signals)), None)
