"""The mart's published figures, the question rules, lineage, retrieval and the ablation."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import constraints, lineage, retrieval
from tallyforge.plans import ablation, evaluation, mart
from tallyforge.plans.ask import ask, draft_note
from tallyforge.plans.intent import parse


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    return mart.star(spark, str(tmp_path_factory.mktemp("mart")))


def test_totals(star):
    sums = {r["year"]: (r["t"], r["n"]) for r in star.fact.groupBy("year").agg(F.sum("tiv_units").alias("t"), F.count("*").alias("n")).collect()}
    assert sums == {2024: (816747, 2100), 2025: (820752, 2100)}
    assert star.brand_year.where("year = 2025 and brand_id = 1").first()["tiv_units"] == 359904 and star.brand_year.count() == 16
    assert mart.brand_month(star.fact, star.model).count() == 192
    assert star.fact.where("tiv_units < 0 or registration_units < 0").isEmpty()


def test_rules_hold_and_are_seen_broken(star):
    assert {r["violations"] for r in constraints.mart_violations(star).collect()} == {0}
    fact = star.fact.union(star.fact.limit(1)).withColumn("month", F.when(F.col("month") == 2, 13).otherwise(F.col("month"))).withColumn("model_id", F.when(F.col("model_id") == 1, 99).otherwise(F.col("model_id")))
    found = {r["rule"]: r["violations"] for r in constraints.violations("f", fact, ["year", "month", "model_id", "region_id"], {"month": F.col("month").between(1, 12)}, {"model_id": (star.model, "model_id")}).collect()}
    assert found["unique year,month,model_id,region_id"] == 1 and found["domain month"] in (350, 351) and found["reference model_id"] in (168, 169)


def test_ablation_figures(star, spark):
    flip = ablation.metric_flip(star)
    assert flip["month_value_gap_pct"]["by_month"] == [17.47, 0.39, -9.44, 8.59, -0.69, -8.19, 7.66, 0.15, -8.79, 7.39, -0.63, -11.69]
    assert (flip["month_rank_diff"], flip["region_rank_diff"], flip["full_order_diff_year"]) == ("0/12", "0/7", False)
    assert flip["year_value_gap_pct"] == {"min": 0.12, "max": 2.12, "mean": 0.78}
    assert flip["tightest"]["gap_pct"] == 2.77 and flip["tightest"]["leader"] == "Honda"
    assert (flip["legacy_flat_bump_model"]["abs_typical"], flip["legacy_flat_bump_model"]["abs_max"]) == (0.32, 4.3)
    sweep = ablation.lambda_sweep(spark, scales=(0.4, 1.0, 1.2)).collect()
    assert [(r["month_flips"], r["region_flips"], r["month_gap_abs_max"]) for r in sweep] == [(0, 0, 29.43), (0, 0, 17.47), (0, 0, 10.38)]


QUESTIONS = [
    ("2025年Toyota批发总量", ("brand_total", "tiv", {"year": 2025, "brand_id": 4})),
    ("2024全年TIV哪家第一", ("brand_rank", "tiv", {"year": 2024, "month": None})),
    ("2025年3月沙巴注册品牌排名", ("brand_rank", "registration", {"month": 3, "region_id": 5})),
    ("2025年混动TIV排名", ("brand_rank", "tiv", {"energy": "hybrid"})),
    ("2025年国产TIV车型排名", ("model_rank", "tiv", {"origin": "national"})),
    ("2025年非国产上牌趋势", ("month_trend", "registration", {"origin": "non_national"})),
    ("2025年国产和非国产TIV", ("origin_split", "tiv", {"origin": None})),
    ("2025年奇瑞TIV同比", ("yoy_brand", "tiv", {"brand_id": 7})),
    ("2025 Honda TIV share", ("share", "tiv", {"brand_id": 3})),
    ("2025年上牌各区域排名", ("region_rank", "registration", {})),
    ("2025 TIV", ("brand_rank", "tiv", {"brand_id": None})),
]
STOPS = {
    "2024谁卖得最好": "AMBIGUOUS_METRIC", "上个月上牌排名": "RELATIVE_TIME", "2025年华东TIV": "OUT_OF_SCOPE_ENTITY", "2025 luxury TIV": "UNDEFINED_TERM", "2023年TIV哪家第一": "YEAR_OUT_OF_RANGE",
    "Proton TIV多少": "MISSING_YEAR", "2025年Proton多少": "MISSING_METRIC",
}


@pytest.mark.parametrize("question,want", QUESTIONS)
def test_questions(question, want):
    intent = parse(question)
    assert not intent.hitl and (intent.task, intent.metric) == want[:2]
    assert {k: getattr(intent, k) for k in want[2]} == want[2]


@pytest.mark.parametrize("question,code", STOPS.items())
def test_stops_and_forced_guesses(question, code):
    intent = parse(question)
    assert intent.hitl and intent.hitl_code == code and intent.hitl_reason
    forced = parse(question, force=True)
    assert not forced.hitl and forced.hitl_code == code and forced.guesses and forced.task and forced.metric and forced.year


def test_ask(spark, star):
    share = ask(spark, star, "2025年Perodua TIV份额")
    assert share["mode"] == "sql" and share["trace"]["scan"] == "ads.brand_year" and share["rows"] == [{"name": "Perodua", "units": 359904, "share_pct": 43.9}]
    assert "ods.brand_year_anchor" in share["lineage"]["path"] and "359904" in draft_note("q", share)["draft"]
    stopped = ask(spark, star, "2025谁卖得最好")
    assert stopped["mode"] == "hitl" and not stopped["rows"] and draft_note("q", stopped)["blocked"]
    found = ask(spark, star, "份额的定义是什么")
    assert found["mode"] == "retrieve" and found["retrieve"][0]["object"] == "metric.share"


def test_retrieval_tokens_and_ranks(spark):
    row = spark.range(1).select(retrieval.tokens(F.lit("The TIV_units of 上牌数 a x2")).alias("t")).first()
    assert set(row["t"]) == {"tiv_units", "x2", "上牌数", "上牌", "牌数"}
    assert retrieval.search(retrieval.chunks(spark), "").count() == 0
    assert [r["object"] for r in retrieval.search(retrieval.chunks(spark), "上牌数从哪张表来").collect()].count("dwd.fact_month") == 1


def test_lineage_walks(spark):
    got = {r["object_name"]: r["depth"] for r in lineage.upstream(lineage.edges(spark), ["metric.national"]).collect()}
    assert got == {"metric.national": 0, "dim.brand": 1}
    walk = lineage.walk(spark, ["metric.yoy", "no.such"])
    assert walk["focus"] == ["metric.yoy"] and walk["path"][0] == "ods.brand_year_anchor" and "metric.share" not in walk["path"]
    assert all(e["dst"] in walk["path"] and e["src"] in walk["path"] for e in walk["edges"])
    assert lineage.walk(spark, ["no.such"])["nodes"] == []


def test_sections_of_documents(spark, star, tmp_path):
    (tmp_path / "metrics.md").write_text("# Metrics\nWho owns them.\n\n## share\nUnits of a brand\nover those of the market.\n\n## 分层\nods, dwd, ads\n\n##  \nno name\n## empty", encoding="utf-8")
    (tmp_path / "none.md").write_text("", encoding="utf-8")
    found = {r["id"]: r.asDict() for r in retrieval.sections(spark, str(tmp_path)).collect()}
    assert set(found) == {"doc:口径", "doc:share", "doc:分层", "doc:empty"}
    assert found["doc:口径"]["text"] == "# Metrics\nWho owns them." and found["doc:share"]["text"] == "Units of a brand\nover those of the market." and found["doc:empty"]["text"] == ""
    assert found["doc:share"]["aliases"] == ["share", "份额", "市占"] and found["doc:分层"]["object"] == "doc.分层" and found["doc:empty"]["aliases"] == ["empty"]
    hits = ask(spark, star, "share 份额的定义是什么", documents=retrieval.sections(spark, str(tmp_path)))["retrieve"]
    assert hits[0]["id"] == "doc:share" and any(h["kind"] == "metric" for h in hits)


def test_guards_on_and_off(spark, star):
    cases = [{"id": str(i), "q": q, "expect_hitl": True} for i, q in enumerate(["2025谁卖得最好", "今年TIV排名"])] + [{"id": "x", "q": "2025全年TIV哪家第一", "expect_hitl": False, "template_id": "brand_rank", "metric": "tiv", "top_name": "Perodua"}]
    arms = ablation.guard_arms(spark, star, cases)
    assert arms["guard_on"] == {"stopped": 2, "answered": 1} and arms["guard_off"] == {"stopped": 0, "guessed": 2, "changed": 1, "regression": 0}


def test_evaluation(spark, star):
    cases = [{"id": "1", "q": "2025全年TIV哪家第一", "expect_hitl": False, "template_id": "brand_rank", "metric": "tiv", "year": 2025, "month": None, "top_name": "Perodua"}, {"id": "2", "q": "今年TIV排名", "expect_hitl": True}, {"id": "3", "q": "2025年BYD上牌总量", "expect_hitl": False, "template_id": "brand_total", "metric": "tiv"}]
    run = evaluation.evaluate(spark, star, cases, [{"id": "r", "q": "国产车怎么定义", "expect_objects": ["metric.national"]}])
    assert run["summary"] == {"n": 3, "success_rate": 0.5, "accuracy": 0.5, "hitl_rate": 0.3333, "hitl_precision_on_expected": 1.0, "retrieve_success_rate": 1.0}
    assert evaluation.differences(run, run) == [] and evaluation.differences({"a": [1, 2]}, {"a": [1, 3], "b": 0}) == ["$.a[1]: 2 and 3", "$.b: only on one side"]
    assert evaluation.headlines(spark, star) == [("2025 TIV 第一名", ("Perodua", 359904)), ("Perodua TIV 份额", 43.9), ("国产 origin=national", 359904 + 151564)]


def test_pages_over_the_mart(spark, star, tmp_path):
    import json
    import urllib.error
    import urllib.request
    from threading import Thread
    from urllib.parse import quote

    from tallyforge.plans import service
    from tallyforge.sources.snapshots import SnapshotStore

    server = service.server(SnapshotStore(spark, str(tmp_path)), desk=service.Desk(spark, star))
    Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}")
    try:
        asked = quote("2025年Perodua TIV份额")
        found = json.load(get(f"/ask?q={asked}&format=json"))
        assert found["rows"][0]["name"] == "Perodua" and "Aggregate" in found["trace"]["plan"] and "\n" not in found["trace"]["plan"]
        assert json.load(get(f"/desk?q={asked}&format=json"))["draft"] and json.load(get("/ask?format=json")) == {}
        page = get(f"/desk?q={asked}").read().decode()
        assert "2025 TIV" in page and "Perodua" in page and page.startswith("<!doctype html>")
        stopped = get("/ask?q=" + quote("<b>今年销量</b>")).read().decode()
        assert "RELATIVE_TIME" in stopped and "<b>" not in stopped
        with pytest.raises(urllib.error.HTTPError):
            get("/other")
    finally:
        server.shutdown()
