"""Rule tables over columns against the driver's reading of one row; strict JSON against Python's parser."""

import json
import random

import pytest

from tallyforge.operators import json_tables
from tallyforge.plans import driver_rules, intent, intent_columns, request_columns, serving

WORDS = [
    "2024年", "2025", "2023年", "今年", "上个月", "Proton", "奇瑞", "BYD", "geely", "吉利", "TIV", "上牌", "销量", "卖得好", "排名", "份额", "同比", "趋势", "各区域", "车型", "国产", "非国产", "口径", "定义", "ods",
    "多少", "第一", "3月", "12月", "jan", "全年", "豪华", "华南", "EV", "混动", "KL", "沙巴", "which layer", "owner", " ", "\n", "-07", "sales", "JPJ", "national car", "top", *intent.BRAND_WORDS, *intent.REGION_WORDS, *intent.MONTH_WORDS,
]


@pytest.mark.parametrize("force", [False, True])
def test_questions_are_read_alike_by_columns(spark, force):
    rng = random.Random(int(force))
    asked = ["", None, "2025 国产和非国产 TIV", "2025 TIV 各区域", *("".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randrange(8))) for _ in range(1500))]
    rows = intent_columns.read(spark.createDataFrame(list(enumerate(asked)), "i int, q string"), "q", force)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r for r in rows.collect()}
    codes, tasks = set(), set()
    for i, q in enumerate(asked):
        if q is None:
            assert all(got[i][f] is None for f in intent_columns.FIELDS)
            continue
        one = intent.parse(q, force)
        want = {"task": one.task, "metric": one.metric, **one.params(), "hitl_code": one.hitl_code or None, "n_guesses": len(one.guesses)}
        assert {k: got[i][k] for k in want} == want, q
        codes.add(one.hitl_code)
        tasks.add(one.task)
    assert codes >= set(intent.STOPS) and tasks >= {name for name, _ in intent.TASK_RULES} | {"retrieve"}


def test_requests_are_judged_alike_by_columns(spark):
    known = {"available_months": ["2024-01", "2024-02", "2024-03", "2024-05"], "makers": ["BYD", "TESLA", "A B"], "fuels": ["electric", "petrol"]}
    values = {
        "start_month": ["2024-01", "2024-02", "2024-3", 202401, None, "2023-01", "2024-05", "2024-13", "2024-01\n"], "end_month": ["2024-03", "2024-02", "2024-05", "2030-01", [], "2024-01"],
        "maker": ["byd", " Tesla ", "x", 5, None, ["BYD"]], "makers": [["byd", "tesla"], ["byd"], ["byd", "BYD "], ["byd", "x"], "byd", [1, "byd"], ["byd"] * 9, [], None, ["a b", "tesla", "byd"]],
        "metric": ["registrations", "tiv", None], "limit": [1, 30, 0, 31, 5.0, "5", True, None, 10**20], "fuel": ["electric", "x", 1], "colour": ["red"],
    }
    rng = random.Random(2)
    rows = []
    for i in range(2500):
        query = rng.choice([*serving.SPECS, *serving.SPECS, "nope", None])
        fit = [k for part in serving.SPECS.get(query, ()) for k in part]
        given = {k: rng.choice(v) for k, v in values.items() if rng.random() < (0.9 if k.endswith("month") else 0.4 if k in fit else 0.02)}
        if rng.random() < 0.6:
            given |= {k: v for k, v in (("start_month", "2024-01"), ("end_month", "2024-03")) if k in given}
        rows.append((i, query, json.dumps(given if rng.random() < 0.97 else rng.choice([[], None, "x", 3]))))

    def alone(query, text):
        try:
            checked = serving.prepare(query, json.loads(text), known)
            return "OK", checked.get("maker"), checked.get("makers")
        except serving.QueryError as error:
            return error.code, None, None

    frame = spark.createDataFrame([*rows, (-1, "fuel_monthly", "{"), (-2, "fuel_monthly", None)], "i int, query string, params string")
    judged = request_columns.judged(frame, known)
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: (r["code"], r["maker_key"], r["maker_keys"]) for r in judged.collect()}
    assert got.pop(-1)[0] == got.pop(-2)[0] == "INVALID_PARAMETERS"
    want = {i: alone(q, t) for i, q, t in rows}
    assert got == want and {w[0] for w in want.values()} == {"OK", *serving.MESSAGES}


@pytest.mark.parametrize("name", ["parsed_questions", "checked_requests", "question_vocabulary", "request_codes"])
def test_registered_rules_have_no_python_worker(spark, name):
    plan = driver_rules.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_each_signal_is_looked_for_once_in_all_readings(spark):
    asked = spark.createDataFrame([("2025 TIV 排名",)], "q string")
    plan = intent_columns.readings(asked, "q", {"": False, "forced_": True})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= len(intent.SIGNALS) + len(intent.AS_WRITTEN)
    assert plan.count("lower(") == 1
    vocabulary = driver_rules.question_vocabulary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert vocabulary.count("RLIKE") == plan.count("RLIKE")


def test_words_and_expressions_of_a_pattern_are_found_as_by_python(spark):
    import re

    texts = ["", None, "a.b", "axb", "xods", "an ods.", "谁最猛", "谁最", "从哪张", "non-national", "3 月", "q-07", "mar", "a|b", "卖的好"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in (*intent.SIGNALS.values(), *intent.AS_WRITTEN.values(), r"a\.b|x", "b|c"):
        got = {r["i"]: r["f"] for r in rows.select("i", intent_columns.occurs(rows["t"], pattern).alias("f")).collect()}
        assert got == {i: None if t is None else re.search(pattern, t) is not None for i, t in enumerate(texts)}, pattern


def strict(text):
    """OK or a fault by Python's parser."""

    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise KeyError
        return dict(found)

    def constant(_):
        raise ValueError

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except KeyError:
        return "REPEATED_KEY"
    except ValueError as error:
        return "TRAILING_TEXT" if "Extra data" in str(error) else "NOT_JSON"
    far = lambda v: any(map(far, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else isinstance(v, float) and abs(v) == float("inf")
    return "NOT_FINITE" if far(value) else "OK"


JSON = [
    '{"a": 1}', '{"a": 1, "a": 2}', '{"a": 1} x', '{"a": 1}}', '{"a": 1} {"b": 2}', "[1, [2, {}], []]", "[1,]", "[1 2]", '{"a": NaN}', "NaN", "Infinity", "1e400", "[1, -1e999]", '{"n": 1e308}', "", " ", "null", "true x", "-0", "1.5e-3",
    '"a \\" ] } b"', '"open', '{"k": "}{][", "t": "\\\\"}', '{"k": "}"} ]', "[[[[[[1]]]]]]", "[]]", "[", "{'a': 1}", '{"a": {"b": 1, "c": [1, 2, {"d": null}]}}', '{"é": "\\u00e9"}', '\t{"a":\n1 }\r\n', "[1] ,", "5 5", '"a" "b"', "{}", "{} {}", "[{}, {}]",
]


def test_faults_are_those_of_a_strict_parser(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*JSON, None])], "i int, t string")
    got = {r["i"]: r["f"] for r in rows.select("i", json_tables.fault(rows["t"]).alias("f")).collect()}
    assert got.pop(len(JSON)) == "NO_TEXT"
    assert {JSON[i]: f or "OK" for i, f in got.items()} == {t: strict(t) for t in JSON}


def flat(value, at="$"):
    if isinstance(value, dict) and value:
        step = lambda k: f".{k}" if k.isidentifier() and k.isascii() else "[" + json.dumps(k, ensure_ascii=False) + "]"
        return [x for k, v in value.items() for x in flat(v, at + step(k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flat(v, f"{at}[{i}]")]
    return [(at, json.dumps(value, separators=(",", ":"), ensure_ascii=False))]


def test_paths_and_differences(spark):
    one = {1: {"a": [1, {"b": None}], "c": "x", "d": {"e": {"f": [True, []]}}}, 2: [], 3: 5, 4: {"same": [1, 2, {"x": "y"}]}, 5: {"gone": 1, "a.b": 1, "a": {"b": 2}, "é\\": 3, 'q"]': [4], "": 5}, 6: {"deep": [[[[[[7]]]]]]}}
    two = {1: {"a": [1, {"b": 0}, 9], "c": "x", "d": {"e": 2}}, 2: {}, 3: "5", 4: {"same": [1, 2, {"x": "y"}]}, 6: {"deep": [[[[[[8]]]]]]}, 7: {"new": {}}}
    table = lambda rows: spark.createDataFrame([*[(k, json.dumps(v)) for k, v in rows.items()], (99, "{"), (98, None)], "id int, j string")
    left, right = (json_tables.paths(table(x), "id", "j") for x in (one, two))
    for frame, rows in ((left, one), (right, two)):
        assert {(r["key"], r["path"], r["value"]) for r in frame.collect()} == {(k, p, v) for k, x in rows.items() for p, v in flat(x)}
    a, b = ({(k, p): v for k, x in rows.items() for p, v in flat(x)} for rows in (one, two))
    kind = lambda v: type(json.loads(v))
    want = {(k, p, "missing", a[k, p], None) for k, p in a.keys() - b.keys()} | {(k, p, "extra", None, b[k, p]) for k, p in b.keys() - a.keys()}
    want |= {(k, p, "type" if kind(a[k, p]) is not kind(b[k, p]) else "value", a[k, p], b[k, p]) for k, p in a.keys() & b.keys() if a[k, p] != b[k, p]}
    assert {tuple(r) for r in json_tables.differences(left, right).collect()} == want
    assert json_tables.paths(table({}), "id", "j").collect() == []
