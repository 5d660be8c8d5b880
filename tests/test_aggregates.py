"""The lattice of views, families kept by deltas, and serving requests as one plan."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import deltas, marginals
from tallyforge.plans import driver_aggregates, evaluation, lattice, serving, serving_batch
from tallyforge.plans.star import Star, View
from tallyforge.plans.templates import DETAIL, TEMPLATES, answer
from tallyforge.sources import snapshots
from tallyforge.sources.evidence import recorded


@pytest.fixture(scope="module")
def small_star(spark):
    rng = random.Random(7)
    fact = [(2024 + rng.randrange(2), 1 + rng.randrange(4), 1 + rng.randrange(7), rng.randrange(5), rng.randrange(100), rng.randrange(100)) for _ in range(400)]
    fact = spark.createDataFrame(fact, "year int, month int, model_id int, region_key int, tiv_units long, registration_units long")
    model = spark.createDataFrame([(i, (i + 1) // 2, f"M{i}", "ev" if i % 2 else "ice") for i in range(1, 7)], "model_id int, brand_id int, model_name string, energy string")
    brand = spark.createDataFrame([(1, "B1", "national"), (2, "B2", "non_national")], "brand_id int, brand_name string, origin string")
    region = spark.createDataFrame([(k, k % 2 + 1, f"R{k % 2 + 1}", f"r{k % 2 + 1}") for k in range(4)], "region_key int, region_id int, region_name string, region_name_zh string")
    return Star(fact, model, brand, region)


def test_every_view_answers_what_the_facts_answer(small_star):
    """Facts of unknown models, brands and regions are there; every view is stored, the smallest one answers."""
    top = lattice.finest(small_star).cache()
    measured = {r["view"]: r["n_rows"] for r in lattice.sizes(top).collect()}
    assert measured == {lattice.named(s): lattice.sums(top, s).count() for s in lattice.SETS}
    for s in lattice.SETS:
        small_star.views[lattice.named(s)] = View(s, lambda s=s: lattice.sums(top, s), measured[lattice.named(s)])
    routed = set()
    for task in TEMPLATES:
        for filters in ({}, {"month": 2}, {"origin": "national", "energy": "ev"}, {"brand_id": 2, "region_id": 1}, {"brand_id": 1, "origin": "non_national", "month": 1, "region_id": 2, "energy": "ice"}):
            params = {"year": 2025} | filters
            view = lattice.route(small_star.views, task, params)
            if task == "model_rank":
                assert view is None
                continue
            routed.add(view)
            for metric in ("tiv", "registration"):
                assert answer(small_star, task, metric, params, view).collect() == answer(small_star, task, metric, params, DETAIL).collect(), (task, filters, view)
    assert len(routed) > 8
    with pytest.raises(ValueError, match="has no"):
        answer(small_star, "brand_rank", "tiv", {"year": 2025, "energy": "ev"}, "ads.year_brand")
    small_star.views.clear()


def test_views_are_chosen_by_what_they_spare_for_a_row():
    rng = random.Random(2)
    for _ in range(20):
        base = {d: rng.randrange(2, 30) for d in lattice.DIMENSIONS}
        measured = {}
        for s in lattice.SETS:
            n = 1
            for d in s:
                n *= base[d]
            measured[lattice.named(s)] = min(n, 5000)
        budget = rng.randrange(0, 6000)
        chosen = lattice.choose(measured, 10_000, budget)
        assert sum(measured[v] for v in chosen) <= budget and len(set(chosen)) == len(chosen)
        sets = {lattice.named(s): s for s in lattice.SETS}

        def total(views, sets=sets, measured=measured):
            return sum(min([10_000, *[measured[v] for v in views if s <= sets[v]]]) for s in sets.values())

        kept = []
        for view in chosen:  # each was the best there was
            rate = lambda v: (total(kept) - total([*kept, v])) / max(1, measured[v])
            left = budget - sum(measured[v] for v in kept)
            others = [v for v in sets if v not in kept and measured[v] <= left]
            assert rate(view) == max(map(rate, others)) > 0
            kept.append(view)
        left = budget - sum(measured[v] for v in kept)
        assert all(total(kept) == total([*kept, v]) for v in sets if v not in kept and measured[v] <= left)


def test_the_router_takes_the_smallest_view():
    view = lambda *c, n: View(frozenset(c), lambda: None, n)
    views = {"a": view("month", "brand_id", n=50), "b": view("month", "brand_id", "energy", n=40), "c": view("month", n=5)}
    assert lattice.route(views, "month_trend", {"year": 1}) == "c" and lattice.route(views, "month_trend", {"origin": "national"}) == "b"
    assert lattice.route(views, "brand_rank", {"month": 3}) == "b" and lattice.route(views, "region_rank", {}) is None and lattice.route(views, "model_rank", {}) is None
    assert lattice.route({}, "share", {}) is None


@pytest.mark.parametrize("name", ["lattice_month_trend", "lattice_brand_rank_month", "lattice_share_filtered"])
def test_registered_views_are_read_and_no_facts(spark, name):
    found = driver_aggregates.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert any("lattice_ads.year" in f for f in found.inputFiles()) and not any("lineitem" in f for f in found.inputFiles())
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().executedPlan().toString()


def ads_rows(seed, years=(2024, 2025, 2026)):
    rng = random.Random(seed)
    return {(y, 1 + rng.randrange(3), rng.choice(["A", "B", None]), rng.choice(["x", "y"]), rng.choice(["s", "t"])): rng.randrange(1, 9) for y in years for _ in range(12)}


def frame(spark, rows, path=None):
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()], "registration_year int, registration_month int, maker string, fuel string, state string, registrations long")
    if path is None:
        return df
    df.write.partitionBy("registration_year").parquet(path)
    return spark.read.parquet(path)


def counted(df):
    return sorted(map(str, df.select("dimension", "key1", "key2", "registrations").collect()))


def test_a_republished_year_gives_the_full_count(spark, tmp_path):
    old, corrected = ads_rows(1), ads_rows(2)
    stored = frame(spark, old, str(tmp_path / "ads"))
    store = deltas.FamilyStore(spark, str(tmp_path / "families"))
    store.create(stored)
    of = lambda rows, y: {k: n for k, n in rows.items() if k[0] == y}
    old_2025 = stored.where("registration_year = 2025")
    with recorded(spark, "delta") as found:
        store.republish(2025, old_2025, frame(spark, of(corrected, 2025)))
    now = {**{k: n for k, n in old.items() if k[0] != 2025}, **of(corrected, 2025)}
    assert counted(store.read()) == counted(marginals.marginals(frame(spark, now)))
    assert "PartitionFilters: [isnotnull(registration_year" in old_2025._jdf.queryExecution().executedPlan().toString()
    families, year = store.read().count(), len(of(old, 2025))
    assert found["totals"]["input_records"] < 6 * (families + 2 * year)  # whatever is read, none of it is another year's rows
    # a year that is new, and one that goes
    more = {(2027, 1, "C", "x", "s"): 4}
    store.republish(2027, frame(spark, {}), frame(spark, more))
    store.republish(2026, frame(spark, of(old, 2026)), frame(spark, {}))
    now = {**{k: n for k, n in now.items() if k[0] != 2026}, **more}
    assert counted(store.read()) == counted(marginals.marginals(frame(spark, now))) and set(store.about()["years"]) == {"2024", "2025", "2027"}


def test_a_wrong_base_is_refused(spark, tmp_path):
    old = ads_rows(3)
    store = deltas.FamilyStore(spark, str(tmp_path / "families"))
    with pytest.raises(ValueError, match="NO_FAMILIES"):
        store.read()
    store.create(frame(spark, old))
    before = counted(store.read())
    year = {k: n for k, n in old.items() if k[0] == 2025}
    key = next(iter(year))
    for wrong in ({}, {**year, key: year[key] + 1}, {k: n for k, n in year.items() if k != key}):
        with pytest.raises(ValueError, match="WRONG_BASE:2025"):
            store.republish(2025, frame(spark, wrong), frame(spark, year))
    with pytest.raises(ValueError, match="WRONG_YEAR:2025"):
        store.republish(2025, frame(spark, year), frame(spark, {(2024, *key[1:]): 3}))
    assert counted(store.read()) == before
    at = tmp_path / "families" / f"version={store.about()['version']}"
    store.read().where("dimension <> 'total'").write.parquet(str(tmp_path / "other"))
    for f in list(at.glob("*")):
        f.unlink()
    for f in (tmp_path / "other").glob("*.parquet"):
        f.rename(at / f.name)
    with pytest.raises(ValueError, match="FAMILIES_CORRUPTED"):
        store.republish(2025, frame(spark, year), frame(spark, year))


@pytest.fixture(scope="module")
def served(spark):
    rows = {k: n for k, n in ads_rows(5).items() if k[2]}
    return snapshots.derived(marginals.marginals(frame(spark, rows))).cache()


def test_requests_as_one_plan_equal_each_request(spark, served):
    known = serving.catalog(served)
    months = known["available_months"]
    asked, want = [], {}
    for i, (a, z) in enumerate([(months[0], months[-1]), (months[1], months[2]), (months[2], months[2]), (months[3], months[1])]):
        for kind, labels in (("month", [None]), ("month_maker", [*known["makers"], "NOBODY"]), ("month_fuel", known["fuels"])):
            for label in labels:
                asked.append((f"{i}{kind}{label}", kind, label, a, z))
                inside = [m for m in months if a <= m <= z]
                series = served.where((F.col("dimension") == kind) & F.coalesce("maker_norm", "fuel").eqNullSafe(label)).groupBy("year_month").agg(F.sum("registrations").alias("n"))
                found = {r["year_month"]: r["n"] for r in series.collect()} if i == 0 else want[f"0{kind}{label}"]
                want[f"{i}{kind}{label}"] = {m: found.get(m, 0) for m in inside}
    requests = spark.createDataFrame(asked, "request string, kind string, label string, start_month string, end_month string")
    got = {}
    for r in serving_batch.monthly(served, requests).collect():
        got.setdefault(r["request"], {})[r["year_month"]] = r["registrations"]
    assert got == {k: v for k, v in want.items() if v}
    sums = {r["request"]: (r["months"], r["registrations"]) for r in serving_batch.totals(served, requests).collect()}
    assert sums == {k: (len(v), sum(v.values())) for k, v in want.items() if v}
    plan = serving_batch.monthly(served, requests)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_verification_takes_a_fixed_number_of_jobs(spark, served):
    many = {(y, m, f"maker {i}", f"fuel {i % 9}", "s"): 1 + i % 5 for y in (2025, 2026) for m in range(1, 13) for i in range(40)}
    more = snapshots.derived(marginals.marginals(frame(spark, many))).cache()
    jobs = []
    for rows, labels in ((served, 5), (more, 50)):
        with recorded(spark, "verify") as found:
            assert evaluation.verify_serving(rows) == labels + 3
        jobs.append(found["totals"]["jobs"])
    assert jobs[1] <= jobs[0] + 8
    broken = more.withColumn("registrations", F.when((F.col("dimension") == "month_maker") & (F.col("key2") == "maker 7"), F.lit(0).cast("long")).otherwise(F.col("registrations")))
    assert evaluation.verify_serving(broken) == 53  # both sides are the families
    off = more.withColumn("maker_norm", F.when(F.col("key2") == "maker 7", "MAKER 8").otherwise(F.col("maker_norm")))
    with pytest.raises(AssertionError):
        evaluation.verify_serving(off)


def test_faults_of_many_versions_are_those_of_each(spark):
    good = marginals.marginals(frame(spark, {k: n for k, n in ads_rows(9).items() if k[2]}))
    text = good.select("dimension", "key1", "key2", F.col("registrations").cast("string").alias("registrations"), F.lit(4).alias("n_cells"))
    one = (F.col("dimension") == "maker") & (F.col("key1") == "A")
    changes = {
        "good": text, "cells": text.withColumn("n_cells", F.when(one, 3).otherwise(4)), "null": text.withColumn("key2", F.when(~one, F.col("key2"))), "many": text.unionByName(text.where(one)),
        "zero": text.withColumn("registrations", F.when(one, "0").otherwise(F.col("registrations"))), "none": text.where("dimension <> 'fuel'"), "less": text.where(~one),
        "month": text.withColumn("key2", F.when(F.col("dimension") == "month", "13").otherwise(F.col("key2"))), "word": text.withColumn("registrations", F.when(one, "many").otherwise(F.col("registrations"))),
        "move": text.withColumn("key1", F.when((F.col("dimension") == "month_maker") & (F.col("key1") == "2024-01"), "2024-02").otherwise(F.col("key1"))).groupBy("dimension", "key1", "key2", "n_cells").agg(F.sum(F.col("registrations").cast("long")).cast("string").alias("registrations")),
    }
    every = None
    want = {}
    for name, rows in changes.items():
        try:
            snapshots.validated(rows)
            want[name] = None
        except ValueError as error:
            want[name] = str(error)
        named = rows.withColumn("version", F.lit(name))
        every = named if every is None else every.unionByName(named)
    assert {r["version"]: r["code"] for r in snapshots.first_faults(every, "version").collect()} == want
    assert len({str(c).split(":")[0] for c in want.values()}) == 9
