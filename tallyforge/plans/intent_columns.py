"""The question rules compiled to columns: any number of questions are read without a Python worker."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import strip
from ..functions.truth import all_codes, first_code, sure
from . import intent
from .intent import LATEST, MONTH_WORDS, ORDER, YEARS, Signals

#: Patterns are read as Python reads them: classes and boundaries of all scripts, a dot that stops at line feeds only.
_AS_PYTHON = "(?Ud)"
#: Alternatives of a pattern that stand in no group, and those that are plain words.
_BAR, _PLAIN = re.compile(r"\|(?![^(]*\))"), re.compile(r"[^\\^$.|?*+()\[\]{}]+")
FIELDS = ("task", "metric", "year", "month", "brand_id", "region_id", "energy", "origin", "hitl_code", "n_guesses")


def occurs(text: Column, pattern: str) -> Column:
    """Whether the pattern is found: plain words are looked for as they are, only the other alternatives by an expression."""
    parts = [pattern] if pattern.startswith("(?") else _BAR.split(pattern)
    plain = [p for p in parts if _PLAIN.fullmatch(p)]
    rest = "|".join(p for p in parts if p not in plain)
    return reduce(or_, [*[F.contains(text, F.lit(p)) for p in plain], *([text.rlike(_AS_PYTHON + rest)] if rest else [])])


class _Columns:
    """What intent._Values has of one text, of a column of texts."""

    def __init__(self, written: Column, low: Column):
        self.written, self.low = written, low

    def found(self, name: str) -> Column:
        own = name in intent.AS_WRITTEN
        return sure(occurs(self.written if own else self.low, intent.AS_WRITTEN[name] if own else intent.SIGNALS[name]))

    def year(self) -> Column:
        return F.nullif(F.regexp_extract(self.written, _AS_PYTHON + intent.AS_WRITTEN["year"], 1), F.lit("")).cast("int")

    def year_held(self) -> Column:
        return sure(self.year().isin(*YEARS))

    def named(self, words: dict) -> Column:
        return F.coalesce(*[F.when(F.contains(self.low, F.lit(word)), F.lit(value)) for word, value in words.items()])

    def names(self, words: dict) -> Column:
        return self.named(words).isNotNull()

    def month(self) -> Column:
        said = F.regexp_extract(self.low, _AS_PYTHON + f"({intent.SIGNALS['month']})", 1)
        digits = F.nullif(F.regexp_extract(said, r"(\d+)", 1), F.lit("")).cast("int")
        word = F.array_position(F.array(*[F.lit(m) for m in MONTH_WORDS]), said).cast("int")
        return F.when(said != "", F.coalesce(digits, word))


class _Seen:
    """The same of columns that hold it, see _looked()."""

    WORDS = {"brand": intent.BRAND_WORDS, "region": intent.REGION_WORDS, "energy": intent.ENERGY_WORDS}

    def found(self, name: str) -> Column:
        return F.col(f"__found_{name}")

    def year(self) -> Column:
        return F.col("__year")

    def year_held(self) -> Column:
        return F.col("__year_held")

    def month(self) -> Column:
        return F.col("__month")

    def named(self, words: dict) -> Column:
        return F.col(next(f"__{name}" for name, known in self.WORDS.items() if known is words))

    def names(self, words: dict) -> Column:
        return self.named(words).isNotNull()


def _looked(questions: DataFrame, question: str) -> DataFrame:
    """questions with a column for each signal and value, so that each is looked for once however many rules ask for it."""
    rows = questions.withColumn("__written", strip(F.col(question))).withColumn("__low", F.lower("__written"))
    values = _Columns(F.col("__written"), F.col("__low"))
    looked = {f"__found_{name}": values.found(name) for name in (*intent.SIGNALS, *intent.AS_WRITTEN)}
    looked |= {f"__{name}": values.named(words) for name, words in _Seen.WORDS.items()}
    return rows.withColumns(looked | {"__year": values.year(), "__year_held": values.year_held(), "__month": values.month()})


def read(questions: DataFrame, question: str, force: bool = False, prefix: str = "") -> DataFrame:
    """questions with the fields of intent.parse() as columns, named with the prefix. A null question has only nulls."""
    return readings(questions, question, {prefix: force})


def readings(questions: DataFrame, question: str, forced: dict[str, bool]) -> DataFrame:
    """Several readings side by side, of one look at each question: forced says for each prefix whether stops are guessed over."""
    rows = _looked(questions, question)
    for prefix, force in forced.items():
        rows = _ruled(rows, question, force, prefix)
    own = dict.fromkeys([*questions.columns, *(f"{prefix}{f}" for prefix in forced for f in FIELDS)])
    return rows.select(*[F.col(f"`{c}`") for c in own])


def _ruled(rows: DataFrame, question: str, force: bool, prefix: str) -> DataFrame:
    values = _Seen()
    s = Signals(values)
    at = lambda name: F.col(f"__{name}")
    rows = rows.withColumn("__stops", all_codes(intent.STOP_RULES, s))
    first = F.get("__stops", F.lit(0))
    code = F.lit(len(ORDER)) if force else F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in ORDER]), first).cast("int"), F.lit(0)) - 1, F.lit(len(ORDER)))
    rows = rows.withColumns({"__code": first, "__n": F.size("__stops"), "__at": code, "__documents": s.documents})
    past = lambda name: (at("at") > ORDER.index(name)) & ~at("documents")
    scoped = at("at") > ORDER.index("RELATIVE_TIME")
    none = F.lit(None)
    guessed = lambda value: F.lit(value) if force else none
    relative = F.when(s.relative, F.lit(LATEST[0])) if force else none
    metric = F.coalesce(first_code(intent.METRIC_RULES, s), guessed("tiv"))
    year = F.when(s.year, F.when(s.year_held, values.year()).otherwise(F.lit(LATEST[0])))
    month = F.when(s.full_year, none.cast("int")).otherwise(F.coalesce(values.month(), F.when(s.relative & s.last_month, LATEST[1]) if force else none.cast("int")))
    own = F.col(question).isNotNull()
    named = {
        "task": F.when(at("documents") & scoped, "retrieve").when(past("MISSING_YEAR"), F.coalesce(first_code(intent.TASK_RULES, s), F.lit(intent.DEFAULT_TASK))),
        "metric": F.when(at("documents") & scoped, first_code(intent.DOCUMENT_RULES, s)).when(scoped & ~at("documents"), metric),
        "year": F.when(past("YEAR_OUT_OF_RANGE"), F.coalesce(year, relative, F.when(at("at") > ORDER.index("MISSING_YEAR"), guessed(LATEST[0])))).when(at("documents") & scoped, relative),
        "month": F.when(past("YEAR_OUT_OF_RANGE"), month).when(at("documents") & scoped, F.when(s.relative & s.last_month, LATEST[1]) if force else none),
        "brand_id": F.when(past("MISSING_YEAR"), values.named(intent.BRAND_WORDS)), "region_id": F.when(past("MISSING_YEAR"), values.named(intent.REGION_WORDS)),
        "energy": F.when(past("MISSING_YEAR"), values.named(intent.ENERGY_WORDS)), "origin": F.when(past("MISSING_YEAR"), first_code(intent.ORIGIN_RULES, s)),
        "hitl_code": at("code"), "n_guesses": at("n") if force else F.lit(0),
    }
    kinds = dict.fromkeys(("year", "month", "brand_id", "region_id", "n_guesses"), "int")
    rows = rows.withColumns({f"{prefix}{name}": F.when(own, column.cast(kinds.get(name, "string"))) for name, column in named.items()})
    return rows.drop("__stops", "__code", "__n", "__at", "__documents")
