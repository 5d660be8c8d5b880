"""Question suites, headline figures, drift between two runs, and serving answers against sums of the families."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import maker_key
from . import serving, serving_batch
from .ask import ask
from .star import Star

#: The questions behind the headline figures, and the fields of an answer that a case may state.
HEADLINES = ("2025全年协会口径TIV哪家第一", "2025年Perodua TIV份额", "2025全年国产车和非国产车TIV")
STATED = ("year", "month", "brand_id", "region_id", "energy", "origin")


def judge(case: dict, result: dict[str, Any]) -> tuple[bool, bool]:
    """(read as stated, answered as stated) for a case that expects an answer."""
    read = result.get("template_id") == case.get("template_id") and result["metric"] == case.get("metric") and all(result["params"][k] == case[k] for k in STATED if k in case)
    top = result["rows"][0].get("name") if result["rows"] else None
    return read, read and bool(result["rows"]) and case.get("top_name") in (None, top)


def evaluate(spark: SparkSession, star: Star, cases: list[dict], retrieval_cases: list[dict] = ()) -> dict:
    rows, stopped = [], 0
    for case in cases:
        result = ask(spark, star, case["q"])
        stopped += result["hitl"]
        read, answered = (result["hitl"],) * 2 if case["expect_hitl"] else judge(case, result)
        rows.append({"id": case["id"], "stop": case["expect_hitl"], "read": read, "ok": answered})
    found = []
    for case in retrieval_cases:
        result = ask(spark, star, case["q"])
        objects = {h["object"] for h in result["retrieve"] or []} | set((result["lineage"] or {}).get("path", []))
        found.append({"id": case["id"], "ok": result["mode"] == "retrieve" and set(case["expect_objects"]) <= objects})
    stops, answers = [r for r in rows if r["stop"]], [r for r in rows if not r["stop"]]
    rate = lambda part, of: round(part / of, 4) if of else 0
    summary = {
        "n": len(rows), "success_rate": rate(sum(r["ok"] for r in answers), len(answers)), "accuracy": rate(sum(r["read"] for r in answers), len(answers)), "hitl_rate": rate(stopped, len(rows)),
        "hitl_precision_on_expected": rate(sum(r["ok"] for r in stops), len(stops)), "retrieve_success_rate": rate(sum(r["ok"] for r in found), len(found)),
    }
    return {"summary": summary, "rows": rows, "retrieve_rows": found}


def headlines(spark: SparkSession, star: Star) -> list[tuple[str, Any]]:
    """The leading brand, the largest brand's share and the home-made brands' volume."""
    rank, share, split = (ask(spark, star, q)["rows"] for q in HEADLINES)
    national = next((r["units"] for r in split if r["name"] == "national"), None)
    return [("2025 TIV 第一名", (rank[0]["name"], rank[0]["units"])), ("Perodua TIV 份额", share[0]["share_pct"]), ("国产 origin=national", national)]


def differences(one: Any, two: Any, at: str = "$") -> list[str]:
    """Places at which two JSON values differ."""
    if isinstance(one, dict) and isinstance(two, dict):
        return [d for k in sorted({*one, *two}) for d in (differences(one[k], two[k], f"{at}.{k}") if k in one and k in two else [f"{at}.{k}: only on one side"])]
    if isinstance(one, list) and isinstance(two, list):
        return ([f"{at}: {len(one)} and {len(two)} items"] if len(one) != len(two) else []) + [d for i, (x, y) in enumerate(zip(one, two, strict=False)) for d in differences(x, y, f"{at}[{i}]")]
    return [] if one == two and type(one) is type(two) else [f"{at}: {one!r} and {two!r}"]


def verify_serving(rows: DataFrame) -> int:
    """Answers for every maker, fuel and all months against one aggregate of the families; the number of requests compared.

    All requests are one plan, so the number of jobs doesn't follow theirs. Each kind of query is then asked once by itself
    and held against the same sums; only those that are no label's request count once more.
    """
    known = serving.catalog(rows)
    months = known["available_months"]
    while months_missing := set(serving.months_between(months[0], months[-1])) - set(months):  # the latest months without a gap
        months = [m for m in months if m > min(months_missing)]
    bounds = {"start_month": months[0], "end_month": months[-1]}
    requests = serving_batch.every_label(rows).select(F.concat_ws("|", "kind", "label").alias("request"), "kind", "label", *[F.lit(v).alias(k) for k, v in bounds.items()])
    answered = serving_batch.monthly(rows, requests)
    # the same sums from the families' own keys, not from the columns that serving reads
    kind, first, second = F.col("dimension"), F.col("key1"), F.col("key2")
    month = F.when(kind == "month", F.concat(first, F.lit("-"), second)).otherwise(first)
    label = F.when(kind == "month_maker", maker_key(second)).when(kind == "month_fuel", second)
    families = rows.where(kind.isin(*serving_batch.KINDS)).groupBy(kind.alias("kind"), F.coalesce(label, F.lit("")).alias("label"), month.alias("year_month")).agg(F.sum("registrations").alias("n"))
    families = families.where(F.col("year_month").isin(*months))
    both = answered.withColumn("label", F.coalesce("label", F.lit(""))).join(families, ["kind", "label", "year_month"], "full_outer")
    wrong = both.where(F.coalesce("n", F.lit(0)) != F.coalesce("registrations", F.lit(-1))).limit(3).collect()
    if wrong:
        raise AssertionError(f"answers differ: {[r.asDict() for r in wrong]}")
    seen = {(r["kind"], r["label"]): r["n"] for r in answered.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    for each in serving_batch.every_label(rows).collect():
        if seen.get((each["kind"], each["label"])) != len(months):
            raise AssertionError(f"{each['kind']} {each['label']}: {seen.get((each['kind'], each['label']))} months of {len(months)}")

    def sums(name: str, label: str | None) -> list[tuple]:
        of = answered.where((F.col("kind") == name) & F.col("label").eqNullSafe(label)).select("year_month", "registrations")
        return sorted(tuple(r) for r in of.collect())

    def same(name: str, given: dict, want: list[tuple]) -> None:
        got = [tuple(r) for r in serving.query(rows, name, bounds | given, known).collect()]
        if got != want:
            raise AssertionError(f"{name} {given}: {got[:3]} and {want[:3]}")

    makers, fuels = known["makers"], known["fuels"]
    totals = {r["label"]: r["n"] for r in answered.where("kind = 'month_maker'").groupBy("label").agg(F.sum("registrations").alias("n")).collect()}  # a row a maker
    ranked = sorted(((k, n) for k, n in totals.items() if n), key=lambda x: (-x[1], x[0]))
    same("monthly_registrations", {}, sums("month", None))
    same("monthly_registrations", {"maker": makers[-1]}, sums("month_maker", makers[-1]))
    same("fuel_monthly", {"fuel": fuels[-1]}, [(m, fuels[-1], n) for m, n in sums("month_fuel", fuels[-1])])
    every_fuel = answered.where("kind = 'month_fuel' and registrations > 0").select("year_month", "label", "registrations")
    same("fuel_monthly", {}, sorted(tuple(r) for r in every_fuel.collect()))  # as many as the snapshot's months and fuels
    same("maker_ranking", {"limit": 30}, ranked[:30])
    asked = 2
    if len(makers) > 1:
        same("brand_compare", {"makers": makers[:2]}, sorted(((k, totals.get(k, 0)) for k in makers[:2]), key=lambda x: (-x[1], x[0])))
        asked += 1
    return len(seen) + asked
