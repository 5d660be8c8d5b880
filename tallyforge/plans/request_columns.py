"""The request rules compiled to columns: requests as JSON texts are judged without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import strip
from ..functions.truth import first_code, sure
from . import serving


class _Columns:
    """What serving._Given has of one request, of a column of queries and one of parameters (VARIANT, null if no JSON)."""

    def __init__(self, query: Column, given: Column, known: dict):
        self.query, self.given = query, given
        self.months, self.makers, self.fuels = (F.array(*[F.lit(v) for v in known[k]]).cast("array<string>") for k in ("available_months", "makers", "fuels"))
        self.is_query = sure(query.isin(*serving.SPECS))
        self.is_object = sure(F.schema_of_variant(given).startswith("OBJECT"))
        self.keys = F.coalesce(F.map_keys(F.try_variant_get(given, "$", "map<string,variant>")), F.array().cast("array<string>"))

    def _field(self, name: str) -> Column:
        return F.try_variant_get(self.given, f"$.{name}", "variant")

    def _text(self, name: str) -> Column:
        """The field's text, null if it is no text."""
        return F.when(sure(F.schema_of_variant(self._field(name)) == "STRING"), F.try_variant_get(self.given, f"$.{name}", "string"))

    def __getattr__(self, name: str) -> Column:
        if not name.startswith("has_"):
            raise AttributeError(name)
        return F.array_contains(self.keys, name[4:])

    def _of_query(self, choose) -> Column:
        out = F.array().cast("array<string>")
        for name, spec in serving.SPECS.items():
            out = F.when(self.query == name, F.array(*[F.lit(x) for x in choose(spec)])).otherwise(out)
        return out

    def _month_number(self, name: str) -> Column:
        text = self._text(name)
        return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int")

    @property
    def has_further(self) -> Column:
        return F.size(F.array_except(self.keys, self._of_query(lambda spec: [*spec[0], *spec[1]]))) > 0

    @property
    def lacks_required(self) -> Column:
        return F.size(F.array_except(self._of_query(lambda spec: spec[0]), self.keys)) > 0

    @property
    def metric_fits(self) -> Column:
        return sure(self._text("metric") == "registrations")

    @property
    def months_fit(self) -> Column:
        return sure(self._text("start_month").rlike(rf"\A{serving.MONTH}\z")) & sure(self._text("end_month").rlike(rf"\A{serving.MONTH}\z"))

    @property
    def ends_before_start(self) -> Column:
        return sure(self._text("start_month") > self._text("end_month"))

    @property
    def leaves_coverage(self) -> Column:
        """The period has more months than the snapshot has between its bounds."""
        start, end = self._text("start_month"), self._text("end_month")
        held = F.size(F.filter(self.months, lambda m: (m >= start) & (m <= end)))
        return sure(self._month_number("end_month") - self._month_number("start_month") + 1 > held)

    def maker_key(self) -> Column:
        return F.upper(strip(self._text("maker")))

    @property
    def maker_known(self) -> Column:
        return sure(F.array_contains(self.makers, self.maker_key()))

    def _list(self) -> Column:
        return F.try_variant_get(self.given, "$.makers", "array<variant>")

    def maker_keys(self) -> Column:
        return F.transform(self._list(), lambda m: F.when(F.schema_of_variant(m) == "STRING", F.upper(strip(F.try_variant_get(m, "$", "string")))))

    @property
    def makers_fit(self) -> Column:
        return sure(F.schema_of_variant(self._field("makers")).startswith("ARRAY")) & sure(F.size(self._list()).between(2, 8))

    @property
    def makers_known(self) -> Column:
        return sure(F.forall(self.maker_keys(), lambda m: F.coalesce(F.array_contains(self.makers, m), F.lit(False))))

    @property
    def makers_repeat(self) -> Column:
        return sure(F.size(F.array_distinct(self.maker_keys())) < F.size(self._list()))

    @property
    def fuel_known(self) -> Column:
        return sure(F.array_contains(self.fuels, self._text("fuel")))

    @property
    def limit_fits(self) -> Column:
        whole = sure(F.schema_of_variant(self._field("limit")) == "BIGINT")
        return whole & sure(F.try_variant_get(self.given, "$.limit", "long").between(1, serving.MOST))


def judged(requests: DataFrame, known: dict, query: str = "query", given: str = "params") -> DataFrame:
    """requests with `code`, the first rule that a request breaks or OK, and `maker_key` and `maker_keys` of good ones.

    params: a JSON text; one that is no JSON is no object. known: what serving.catalog() gives, a few dimensions.
    """
    signals = _Columns(F.col(query), F.col("__given"), known)
    rows = requests.withColumn("__given", F.try_parse_json(given))
    rows = rows.withColumn("code", F.coalesce(first_code(serving.REQUEST_RULES, signals), F.lit("OK")))
    good = F.col("code") == "OK"
    return rows.withColumns({"maker_key": F.when(good, signals.maker_key()), "maker_keys": F.when(good, signals.maker_keys())}).drop("__given")
