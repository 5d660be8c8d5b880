"""Sources to layers: row rules, publication, checks, marginals, snapshots and serving."""

import datetime as dt
import json
import urllib.error
import urllib.request
from threading import Thread

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import marginals
from tallyforge.operators.identities import counted
from tallyforge.plans import evaluation, service, serving
from tallyforge.sources.evidence import recorded, sound
from tallyforge.sources.files import Files
from tallyforge.sources.registrations import COLUMNS, RegistrationStore, judged
from tallyforge.sources.snapshots import SnapshotStore, read_tsv, validated, write_table, write_tsv

GOOD = dict(date_reg=dt.date(2026, 1, 5), type="jip", maker="BYD", model="x", colour=None, fuel="electric", state="Rakan Niaga")


def source(path, rows, kind=None):
    columns = {c: [r[c] for r in rows] for c in COLUMNS}
    table = pa.table({c: pa.array(v, kind or pa.date32()) if c == "date_reg" else pa.array(v, pa.string()) for c, v in columns.items()})
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path)


@pytest.fixture
def store(spark, tmp_path):
    return RegistrationStore(spark, str(tmp_path / "raw"), str(tmp_path / "curated"), str(tmp_path / "artifacts"))


def rows_of_2026():
    return [GOOD, GOOD, GOOD | {"date_reg": dt.date(2026, 2, 1), "maker": "Tesla"}, GOOD | {"maker": "byd", "fuel": "petrol", "model": 'quo"te', "colour": " "}]


RULES = [
    ({"date_reg": None}, "invalid_date"), ({"date_reg": "2025-03-01"}, "wrong_source_year"), ({"date_reg": "2026-09-01"}, "after_data_asof"), ({"date_reg": "2026-1-5"}, "invalid_date"),
    ({"date_reg": " 2026-01-05\t"}, None), ({"type": "lori"}, "unknown_vehicle_type"), ({"type": None}, "unknown_vehicle_type"), ({"maker": " "}, "missing_maker"), ({"maker": "a\tb"}, "unsafe_tsv_maker"),
    ({"model": None, "colour": ""}, None), ({"model": "\\N"}, "unsafe_tsv_model"), ({"fuel": None}, "missing_fuel"), ({"state": "a\nb"}, "unsafe_tsv_state"), ({"type": "lori", "fuel": None}, "unknown_vehicle_type"),
]


def test_row_rules(spark):
    rows = [(i, *[({**GOOD, "date_reg": "2026-01-05"} | change)[c] for c in COLUMNS]) for i, (change, _) in enumerate(RULES)]
    frame = spark.createDataFrame(rows, "source_row long, " + ", ".join(f"{c} string" for c in COLUMNS))
    got = {r["source_row"]: r["reason"] for r in judged(frame, 2026, dt.date(2026, 8, 31)).collect()}
    assert got == {i: code for i, (_, code) in enumerate(RULES)}


def test_timestamps(spark, tmp_path, store):
    midnight, noon = dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 5, 12)
    source(tmp_path / "raw/cars_2026.parquet", [GOOD | {"date_reg": midnight}], pa.timestamp("us"))
    assert store.build([2026])[2026]["status"] == "built"
    source(tmp_path / "raw/cars_2026.parquet", [GOOD | {"date_reg": noon}], pa.timestamp("us"))
    with pytest.raises(ValueError, match="timestamp_has_time"):
        store.build([2026])
    assert store.ods().count() == 1  # what was published stays


def test_build_check_and_layers(spark, tmp_path, store):
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026())
    source(tmp_path / "raw/cars_2025.parquet", [GOOD | {"date_reg": dt.date(2025, 1, 9)}])
    built = store.build([2025, 2026])
    assert built[2026]["rows"] == 4 and sum(f["rows"] for f in built[2026]["files"]) == 4
    assert {f["path"].split("/")[1] for f in built[2026]["files"]} == {"registration_month=01", "registration_month=02"}
    assert store.check([2025, 2026])["status"] == "passed"
    ods = {r["source_row"]: r for r in store.ods().where("registration_year = 2026").collect()}
    assert sorted(ods) == [1, 2, 3, 4] and ods[4]["model"] == 'quo"te' and ods[4]["colour"] is None
    assert store.build([2025, 2026])[2026]["status"] == "skipped"
    result = store.run_warehouse([2025, 2026])
    assert result["passed"] and result["total"] == 5 and result["checks"]["distinct_lineage_count"] == 5
    store.write_layers(str(tmp_path / "layers"))
    assert spark.read.orc(str(tmp_path / "layers/ads")).agg(F.sum("registrations")).first()[0] == 5
    summary = marginals.matched_period(result["marginals"])
    assert summary["common_months"] == [1] and summary["comparable_registrations"] == {2025: 1, 2026: 3} and summary["comparable_yoy_pct"] == 200.0
    assert summary["maker_case_variants"] == {"BYD": ["BYD", "byd"]} and summary["electric_share_pct"] == {2025: 100.0, 2026: 66.6667}
    assert summary["top_makers_current_comparable_period"][0] == {"maker": "BYD", "registrations": 3, "share_pct": 100.0, "previous_registrations": 1}


def test_damage_is_seen_and_rebuilt(tmp_path, store):
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026())
    made = store.build([2026])[2026]
    victim = tmp_path / "curated" / made["files"][0]["path"]
    for damage in (lambda: victim.write_text("x"), lambda: victim.unlink(), lambda: (victim.parent / "rogue.txt").write_text("y")):
        damage()
        with pytest.raises(ValueError, match="fingerprint"):
            store.check([2026])
        made = store.build([2026])[2026]
        assert made["status"] == "built" and store.check([2026])["status"] == "passed"
        victim = tmp_path / "curated" / made["files"][0]["path"]


def test_interruption_and_rejection_keep_the_old_year(tmp_path, store):
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026())
    store.build([2026])
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026()[:2])
    with pytest.raises(RuntimeError):
        store.build([2026], fail_before_publish=True)
    assert store.ods().count() == 4 and store.files.read_json(str(tmp_path / "artifacts/year_2026_attempt.json"))["status"] == "failed"
    source(tmp_path / "raw/cars_2026.parquet", [*rows_of_2026(), GOOD | {"maker": None}])
    with pytest.raises(ValueError, match="missing_maker"):
        store.build([2026])
    report = store.files.read_json(str(tmp_path / "artifacts/year_2026_dq.json"))
    assert report["rejected_samples"] == [{"source_row": 5, "reason": "missing_maker"}] and store.ods().count() == 4
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026()[:2])
    store.build([2026])  # the stale month goes with the old year
    assert store.ods().count() == 2 and not (tmp_path / "curated/registration_year=2026/registration_month=02").exists()


def test_pinned_hash_and_schema(tmp_path, store):
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026())
    (tmp_path / "raw/cars_2026.metadata.json").write_text(json.dumps({"source_sha256": "0" * 64}))
    with pytest.raises(ValueError, match="checksum"):
        store.build([2026])
    (tmp_path / "raw/cars_2026.metadata.json").unlink()
    pq.write_table(pa.table({"date_reg": [dt.date(2026, 1, 1)], "extra": [1]}), tmp_path / "raw/cars_2026.parquet")
    with pytest.raises(ValueError, match="columns"):
        store.build([2026])
    with pytest.raises(ValueError, match="Unsafe"):
        store.files.remove_under(str(tmp_path), str(tmp_path))


FINEST = [(2025, 1, "BYD", "electric", "A", 2), (2026, 1, "BYD", "electric", "A", 5), (2026, 1, "byd", "petrol", "B", 1), (2026, 2, "Tesla", "electric", "A", 4), (2026, 2, None, "petrol", "B", 3)]


@pytest.fixture(scope="module")
def family(spark):
    ads = spark.createDataFrame(FINEST, "registration_year int, registration_month int, maker string, fuel string, state string, registrations long")
    return marginals.marginals(ads).cache()


def test_marginals(spark, family):
    got = {(r["dimension"], r["key1"], r["key2"]): r["registrations"] for r in family.collect()}
    assert got["total", "ALL", "ALL"] == 15 and got["month", "2026", "02"] == 7 and got["maker", "__NULL__", "ALL"] == 3
    assert got["month_maker", "2026-01", "byd"] == 1 and got["month_fuel", "2026-02", "electric"] == 4 and got["state", "A", "ALL"] == 11
    raw = spark.createDataFrame(FINEST, "registration_year int, registration_month int, maker string, fuel string, state string, n int").withColumn("x", F.explode(F.expr("sequence(1, n)")))
    assert marginals.compare(marginals.independent_marginals(raw), family, ["dimension", "key1", "key2"], "registrations").isEmpty()
    changed = family.where("dimension <> 'state'").withColumn("registrations", F.when(F.col("dimension") == "total", 99).otherwise(F.col("registrations")).cast("long"))
    kinds = {(r["dimension"], r["status"]) for r in marginals.compare(family, changed, ["dimension", "key1", "key2"], "registrations").collect()}
    assert kinds == {("state", "missing"), ("total", "mismatch")}


def test_snapshot_rules(spark, family, tmp_path):
    write_tsv(family, str(tmp_path / "t"))
    text = read_tsv(spark, str(tmp_path / "t"))
    assert validated(text).count() == family.count()
    bad = {
        "INVALID_SCHEMA": text.withColumn("n_cells", F.lit(5)), "INVALID_DIMENSION": text.withColumn("key1", F.lit("")), "INVALID_COUNT": text.withColumn("registrations", F.lit("007")),
        "INVALID_MONTH": text.withColumn("key1", F.when(F.col("dimension") == "month_fuel", "2026-13").otherwise(F.col("key1"))), "DUPLICATE_AGGREGATE": text.union(text.limit(1)), "MISSING_AGGREGATE_FAMILY": text.where("dimension <> 'fuel'"),
        "TOTAL_MISMATCH:state": text.withColumn("registrations", F.when(F.col("dimension") == "state", "1").otherwise(F.col("registrations"))),
        "MONTH_MISMATCH:2025-01": text.withColumn("registrations", F.when(F.expr("dimension = 'month' and key1 = '2025'"), "3").when(F.expr("dimension = 'month' and key2 = '02'"), "6").otherwise(F.col("registrations"))),
    }
    for code, rows in bad.items():
        with pytest.raises(ValueError, match=code):
            validated(rows)


@pytest.fixture(scope="module")
def snapshots(spark, family, tmp_path_factory):
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("snapshots")))
    assert store.active() is None
    with pytest.raises(RuntimeError):
        store.publish("v1", family, fail_before_activation=True)
    assert store.active() is None
    store.publish("v1", family)
    return store


def test_publication(snapshots, family):
    with snapshots.files.locked(f"{snapshots.root}/import.lock"), pytest.raises(RuntimeError, match="IMPORT_LOCKED"):
        snapshots.publish("v1", family)
    assert snapshots.publish("v1", family)["status"] == "unchanged"
    half = family.where("key1 <> '2025' and key1 <> '2025-01'").withColumn("registrations", F.when(F.expr("dimension in ('total')"), F.lit(13)).when(F.expr("key1 = 'BYD' and dimension = 'maker'"), F.lit(5)).when(F.expr("dimension = 'fuel' and key1 = 'electric'"), F.lit(9)).when(F.expr("dimension = 'state' and key1 = 'A'"), F.lit(9)).otherwise(F.col("registrations")).cast("long"))
    with pytest.raises(ValueError, match="EXISTING_VERSION_CORRUPTED"):
        snapshots.publish("v1", half)
    assert snapshots.publish("v2", half)["represented_registration_rows"] == 13 and snapshots.active()[0]["version"] == "v2"
    snapshots.publish("v1", family)


def served(rows, name, **given):
    return [tuple(r) for r in serving.query(rows, name, given).collect()]


def test_serving(snapshots):
    rows = snapshots.active()[1]
    both = {"start_month": "2026-01", "end_month": "2026-02"}
    assert served(rows, "monthly_registrations", **both) == [("2026-01", 6), ("2026-02", 7)]
    assert served(rows, "monthly_registrations", **both, maker=" byd ") == [("2026-01", 6), ("2026-02", 0)]
    assert served(rows, "brand_compare", **both, makers=["tesla", "byd"]) == [("BYD", 6), ("TESLA", 4)]
    assert served(rows, "brand_compare", start_month="2026-01", end_month="2026-01", makers=["tesla", "byd"]) == [("BYD", 6), ("TESLA", 0)]
    assert served(rows, "maker_ranking", **both, limit=2) == [("BYD", 6), ("TESLA", 4)]
    assert served(rows, "fuel_monthly", start_month="2025-01", end_month="2025-01") == [("2025-01", "electric", 2)]
    assert served(rows, "fuel_monthly", **both, fuel="petrol") == [("2026-01", "petrol", 1), ("2026-02", "petrol", 3)]


def test_serving_agrees_with_the_families(snapshots):
    assert evaluation.verify_serving(snapshots.active()[1]) == 1 + 3 + 2 + 1 + 1 + 1  # all months, makers, fuels, all fuels, ranking, comparison


CODES = [
    ("nope", {}, "UNKNOWN_QUERY"), ("maker_ranking", [], "INVALID_PARAMETERS"), ("maker_ranking", {"state": "A"}, "UNSUPPORTED_FILTER"), ("maker_ranking", {"start_month": "2026-01"}, "MISSING_PARAMETERS"),
    ("maker_ranking", {"metric": "TIV"}, "METRIC_MISMATCH"), ("maker_ranking", {"start_month": "2026-1"}, "INVALID_MONTH"), ("maker_ranking", {"start_month": "2026-03"}, "INVALID_RANGE"),
    ("maker_ranking", {"start_month": "2025-12"}, "OUT_OF_COVERAGE"), ("monthly_registrations", {"maker": "VW"}, "UNKNOWN_MAKER"), ("brand_compare", {"makers": ["BYD"]}, "INVALID_MAKERS"),
    ("brand_compare", {"makers": ["BYD", "byd"]}, "DUPLICATE_MAKERS"), ("fuel_monthly", {"fuel": "coal"}, "UNKNOWN_FUEL"), ("maker_ranking", {"limit": True}, "INVALID_LIMIT"), ("maker_ranking", {"limit": 31}, "INVALID_LIMIT"),
]


@pytest.mark.parametrize("name,change,code", CODES)
def test_parameter_rules(snapshots, name, change, code):
    known = serving.catalog(snapshots.active()[1])
    base = {"start_month": "2026-01", "end_month": "2026-02"}
    given = change if isinstance(change, list) or code == "MISSING_PARAMETERS" else base | change
    with pytest.raises(serving.QueryError) as error:
        serving.prepare(name, given, known)
    assert error.value.code == code


def test_grammar():
    assert serving.route("2026-01至2026-08 每月登记量") == ("monthly_registrations", {"start_month": "2026-01", "end_month": "2026-08"})
    assert serving.route("2026-01到2026-02 BYD和TESLA登记量对比")[1]["makers"] == ["BYD", "TESLA"]
    assert serving.route("2026-01至2026-08 品牌登记量排名前5")[1]["limit"] == 5
    for question, code in (("2026年销量", "METRIC_MISMATCH"), ("2026-01至2026-08 每月登记量 红色", "CLARIFICATION_REQUIRED"), ("x" * 241, "INVALID_QUESTION"), (None, "INVALID_QUESTION")):
        with pytest.raises(serving.QueryError) as error:
            serving.route(question)
        assert error.value.code == code


def test_tables_with_headers(spark, tmp_path):
    write_table(spark.createDataFrame([(1, "a\tb"), (2, "c")], "n int, t string"), str(tmp_path / "t"))
    read = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t"))
    assert read.columns == ["n", "t"] and sorted(map(tuple, read.collect())) == [("1", "a\tb"), ("2", "c")]


def test_http(snapshots):
    server = service.server(snapshots)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None, **headers):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, {"Content-Type": "application/json", **headers})) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    with urllib.request.urlopen(base + "/") as page:
        assert page.headers.get_content_type() == "text/html" and "/api/ask" in page.read().decode()
    assert call("/api/catalog")[1]["available_months"] == ["2025-01", "2026-01", "2026-02"]
    assert call("/api/query", {"query_id": "maker_ranking", "parameters": {"start_month": "2026-01", "end_month": "2026-02", "limit": 1}})[1]["rows"] == [{"maker": "BYD", "registrations": 6}]
    assert call("/api/ask", {"question": "2026-01至2026-02 每月登记量"})[0] == 200
    assert call("/api/ask", {"question": "销量"})[1]["error"]["code"] == "METRIC_MISMATCH"
    assert call("/api/query", b'{"query_id": 1, "query_id": 2}')[0] == 400 and call("/api/query", b"{}", **{"Content-Type": "text/plain"})[0] == 415
    assert call("/api/query", b" " * 9000)[0] == 413 and call("/api/catalog", Origin="http://elsewhere")[0] == 403
    server.shutdown()


def test_command_line(spark, tmp_path, family, capsys, monkeypatch):
    from tallyforge import __main__ as cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026())
    folders = [x for f in ("raw", "curated", "artifacts") for x in (f"--{f}-dir", str(tmp_path / f))]
    cli.main(["build", "--years", "2026", *folders])
    cli.main(["check", "--years", "2026", *folders])
    cli.main(["warehouse", "--years", "2026", *folders, "--out", str(tmp_path / "tsv")])
    cli.main(["publish", "--aggregates", str(tmp_path / "tsv"), "--version", "one", "--store", str(tmp_path / "store")])
    capsys.readouterr()
    cli.main(["summary", "--aggregates", str(tmp_path / "tsv")])
    assert json.loads(capsys.readouterr().out)["comparison_years"] == [2025, 2026]
    assert SnapshotStore(spark, str(tmp_path / "store")).active()[0]["represented_registration_rows"] == 4


def test_runs_are_kept_and_only_good_ones_published(spark, tmp_path, store, monkeypatch):
    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026())
    made = store.build([2026])[2026]
    one, two = (store.run_warehouse([2026], str(tmp_path / "runs")) for _ in range(2))
    assert one["passed"] and one["run_id"] != two["run_id"] and one["path"].endswith(one["run_id"])
    kept = store.files.read_json(f"{one['path']}/run.json")
    assert kept["status"] == "passed" and kept["sources"]["2026"]["rows"] == 4 and kept["checks"]["ods_count"] == 4
    snapshots = SnapshotStore(spark, str(tmp_path / "store"))
    published = snapshots.publish_run(one["path"])
    assert published["version"] == one["run_id"] and published["source"]["sources"]["2026"]["source_sha256"] == made["source_sha256"]
    part = next((tmp_path / "runs" / two["run_id"] / "aggregates").glob("part-*"))
    part.with_name(f".{part.name}.crc").unlink()  # the local file system's own check would refuse to read it
    part.write_text(part.read_text().replace("BYD", "BYE"))
    with pytest.raises(ValueError, match="SOURCE_HASH_MISMATCH"):
        snapshots.publish_run(two["path"])
    store.files.write_json(f"{two['path']}/run.json", kept | {"status": "failed"})
    with pytest.raises(ValueError, match="UPSTREAM_NOT_PASSED"):
        snapshots.publish_run(two["path"])
    assert snapshots.active()[0]["version"] == one["run_id"]
    victim = tmp_path / "curated" / made["files"][0]["path"]
    victim.with_name(f".{victim.name}.crc").unlink()
    good = victim.read_text()
    victim.write_text(good.replace("BYD", "BYE"))  # the counts still agree with one another
    with pytest.raises(ValueError, match="fingerprint"):
        store.run_warehouse([2026])
    victim.write_text(good)
    assert store.run_warehouse([2026])["passed"]
    (tmp_path / "artifacts/year_2026_manifest.json").unlink()
    with pytest.raises(ValueError, match="fingerprint"):
        store.run_warehouse([2026])


def test_hashes_come_from_executors(tmp_path, store, monkeypatch):
    import hashlib

    from tallyforge.sources import files

    paths = []
    for i in range(5):
        (tmp_path / f"f {i}.txt").write_bytes(b"x" * i * 1000)
        paths.append(str(tmp_path / f"f {i}.txt"))
    want = {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths}
    assert store.files.hashes(paths) == want and store.files.hashes([]) == {}
    with recorded(store.spark, "hashes") as found:
        assert store.files.sha256(paths[3]) == want[paths[3]]
    assert found["totals"]["tasks"] == 1 and sound(found)
    monkeypatch.setattr(files, "LONGEST", 2000)
    with pytest.raises(ValueError, match="split it"):
        store.files.hashes(paths)


def test_months_in_several_files(spark, tmp_path, store, monkeypatch):
    from tallyforge.sources import registrations

    monkeypatch.setattr(registrations, "FILE_ROWS", 2)
    source(tmp_path / "raw/cars_2026.parquet", [GOOD | {"model": f"m{i}"} for i in range(60)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else partitions as small as these are taken together
    try:
        made = store.build([2026])[2026]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made["files"]) > 1 and sum(f["rows"] for f in made["files"]) == 60
    assert store.check([2026])["status"] == "passed" and store.run_warehouse([2026])["passed"]
    store.write_layers(str(tmp_path / "layers"))
    assert spark.read.orc(str(tmp_path / "layers/dwd")).count() == 60


def test_eval_and_verify_commands(spark, tmp_path, family, capsys, monkeypatch):
    from tallyforge import __main__ as cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    SnapshotStore(spark, str(tmp_path / "store")).publish("v1", family)
    cli.main(["verify", "--store", str(tmp_path / "store")])
    assert json.loads(capsys.readouterr().out) == {"version": "v1", "compared": 9}
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "a", "q": "2025年TIV总量", "expect_hitl": False, "template_id": "brand_rank", "metric": "tiv"}, {"id": "b", "q": "2030年TIV", "expect_hitl": True}]}))
    command = ["eval", "--mart", str(tmp_path / "mart"), "--questions", str(tmp_path / "cases.json")]
    cli.main(command)
    saved = capsys.readouterr().out
    assert json.loads(saved)["summary"]["hitl_rate"] == 0.5
    (tmp_path / "saved.json").write_text(saved)
    cli.main([*command, "--check", str(tmp_path / "saved.json")])
    (tmp_path / "saved.json").write_text(saved.replace("0.5", "0.25"))
    with pytest.raises(SystemExit):
        cli.main([*command, "--check", str(tmp_path / "saved.json")])


def test_a_build_reads_its_source_once(spark, tmp_path, store):
    n = 3000
    source(tmp_path / "raw/cars_2026.parquet", [GOOD | {"maker": f"m{i % 7}", "date_reg": dt.date(2026, 1 + i % 8, 1 + i % 28)} for i in range(n)])
    with recorded(spark, "build") as found:
        made = store.build([2026])[2026]
    assert (made["rows"], made["min_date"], made["max_date"]) == (n, "2026-01-01", "2026-08-28") and made["columns"][0] == "source_sha256"
    # the source's rows once, and the written lines once for the manifest; files that are hashed are rows of their own
    assert found["totals"]["input_records"] <= 2 * n + 2 + len(made["files"])
    report = json.loads((tmp_path / "artifacts/year_2026_dq.json").read_text())
    assert (report["input_rows"], report["accepted_rows"], report["reasons"], report["rejected_samples"]) == (n, n, {}, [])


def test_a_refused_year_leaves_its_report_and_no_files(spark, tmp_path, store):
    rows = [GOOD | ({"type": "lori"} if i % 3 == 0 else {"state": None} if i % 3 == 1 else {}) for i in range(300)]
    source(tmp_path / "raw/cars_2026.parquet", rows)
    with recorded(spark, "build") as found, pytest.raises(ValueError, match="failed DQ"):
        store.build([2026])
    report = json.loads((tmp_path / "artifacts/year_2026_dq.json").read_text())
    assert (report["input_rows"], report["accepted_rows"], report["rejected_rows"]) == (300, 100, 200) and report["reasons"] == {"unknown_vehicle_type": 100, "missing_state": 100}
    assert report["rejected_samples"] == [{"source_row": i + 1, "reason": "unknown_vehicle_type" if i % 3 == 0 else "missing_state"} for i in range(300) if i % 3 < 2][:50]
    assert found["totals"]["input_records"] <= 300 + 200 + 1
    assert not [p for p in (tmp_path / "curated").rglob("*") if p.is_file()]
    source(tmp_path / "raw/cars_2026.parquet", [])
    with pytest.raises(ValueError, match="input_rows=0"):
        store.build([2026])


def test_a_run_names_its_jobs_and_a_failed_job_bars_it(spark, tmp_path, store, monkeypatch):
    from tallyforge.sources import registrations

    source(tmp_path / "raw/cars_2026.parquet", rows_of_2026())
    store.build([2026])
    good = store.run_warehouse([2026], str(tmp_path / "runs"))
    about, proof = (json.loads(open(f"{good['path']}/{name}.json").read()) for name in ("run", "evidence"))
    assert about["evidence"]["totals"] == proof["totals"] and proof["totals"]["jobs"] == len(proof["jobs"]) > 3
    assert {s["status"] for s in proof["stages"]} == {"COMPLETE"} and {j["status"] for j in proof["jobs"]} == {"SUCCEEDED"} and proof["application"] == spark.sparkContext.applicationId

    real = registrations.quality_checks

    def with_a_failing_job(*frames):
        with pytest.raises(Exception, match="injected"):
            spark.range(10).select(F.raise_error(F.lit("injected"))).collect()
        return real(*frames)

    monkeypatch.setattr(registrations, "quality_checks", with_a_failing_job)
    bad = store.run_warehouse([2026], str(tmp_path / "runs"))
    assert not bad["passed"] and bad["n_differences"] == 0
    proof = json.loads(open(f"{bad['path']}/evidence.json").read())
    assert proof["failed_jobs"] and proof["totals"]["failed_tasks"] >= 1
    snapshots = SnapshotStore(spark, str(tmp_path / "snapshots"))
    with pytest.raises(ValueError, match="UPSTREAM_NOT_PASSED"):
        snapshots.publish_run(bad["path"])
    # someone edits the verdict by hand: the evidence still says what happened
    run = tmp_path / "runs" / bad["run_id"] / "run.json"
    (run.parent / ".run.json.crc").unlink()
    run.write_text(json.dumps(json.loads(run.read_text()) | {"status": "passed", "passed": True}))
    with pytest.raises(ValueError, match="NO_EVIDENCE_OF_SUCCESS"):
        snapshots.publish_run(bad["path"])
    assert snapshots.publish_run(good["path"])["source"]["evidence"]["failed_jobs"] == []


def test_a_dead_owners_lock_is_taken_over(spark, tmp_path):
    files, at = Files(spark), str(tmp_path / "locks/import.lock")
    with files.locked(at):
        assert files.read_json(at)["application"] == spark.sparkContext.applicationId
        with pytest.raises(RuntimeError, match="IMPORT_LOCKED"), files.locked(at):
            pass
    assert not files.exists(at)
    files._create(at, {"owner": "gone"})
    with pytest.raises(RuntimeError, match="IMPORT_LOCKED"), files.locked(at):
        pass
    with files.locked(at, stale_after=-1):
        assert files.read_json(at)["owner"] != "gone"
    assert not files.exists(at) and not list((tmp_path / "locks").glob("*.stale*"))


def test_identities_are_counted_without_shuffling_rows(spark):
    n = 200_000
    rows = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("f"), (F.col("id") + 1).alias("r"))
    with recorded(spark, "identities") as found:
        assert tuple(counted(rows, [F.col("f")], F.col("r")).first()) == (n, n, 1, n)
    assert found["totals"]["shuffle_write_records"] < 100
    for extra in ([("a", 1)], [("a", 5), ("b", 70_000), ("b", 70_000), ("c", 3_000_000_000)], [(None, 3), ("a", None), ("a", 0), ("a", -1), ("a", -32768), ("b", 2**63 - 1)]):
        more = rows.where("r not in (7, 70000, 200000)").unionByName(spark.createDataFrame(extra, "f string, r long"))
        want = more.agg(F.count(F.lit(1)), F.countDistinct("f", "r"), F.min("r"), F.max("r")).first()
        assert tuple(counted(more, [F.col("f")], F.col("r"), {"odd": F.count_if(F.col("r") % 2 == 1)}).drop("odd").first()) == tuple(want)
    assert tuple(counted(rows.limit(0), [F.col("f")], F.col("r")).first()) == (0, 0, None, None)


def test_only_reviewed_years_refresh_and_failing_rows(spark, tmp_path, store):
    source(tmp_path / "raw/reviewed.parquet", rows_of_2026())
    source(tmp_path / "raw/cars_2025.parquet", [GOOD | {"date_reg": dt.date(2025, 3, 1)}])
    reviewed = RegistrationStore(spark, store.raw, store.curated, store.artifacts, reviewed={"files": {"2026": "https://host.example/data/reviewed.parquet"}})
    with pytest.raises(ValueError, match="UNREVIEWED_YEAR: 2025"):
        reviewed.build([2025])
    with pytest.raises(Exception, match="Injected interruption after 2 rows"):
        reviewed.build([2026], failure_after_rows=2)
    assert json.loads((tmp_path / "artifacts/year_2026_attempt.json").read_text())["status"] == "failed" and not (tmp_path / "curated/registration_year=2026").exists()
    assert [reviewed.build([2026], **x)[2026]["status"] for x in ({}, {}, {"refresh": True}, {"failure_after_rows": 4})] == ["built", "skipped", "built", "built"]
    assert reviewed.check([2026])["status"] == "passed"
