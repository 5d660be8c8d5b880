"""Walks over graphs and batch retrieval against plain Python and against the one-question operators."""

import random

from tallyforge.operators import lineage, postings, reach, retrieval
from tallyforge.plans import driver_search


def plain_walk(edges, seeds):
    into = {}
    for s, d in edges:
        into.setdefault(d, set()).add(s)
    out = {}
    for focus, node in seeds:
        level, depth = {node}, 0
        while level:
            for n in level:
                out[focus, n] = min(depth, out.get((focus, n), depth))
            level, depth = {s for n in level for s in into.get(n, ()) if (focus, s) not in out or out[focus, s] > depth + 1}, depth + 1
    return {(f, n, d) for (f, n), d in out.items()}


def test_walks_of_a_random_graph_with_cycles(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)] + [("n1", "n1"), ("n2", "n3"), ("n3", "n2")] * 2
    seeds = [("a", "n1"), ("a", "n2"), ("b", "n3"), ("b", "n3"), (None, "n4"), ("c", "unknown")]
    e = spark.createDataFrame([*edges, (None, "n1"), ("n1", None)], "src string, dst string")
    walks = reach.upstream(e, spark.createDataFrame([*seeds, ("d", None)], "focus string, node string"))
    found = [tuple(r) for r in walks.select("focus", "node", "depth").collect()]
    assert len(found) == len(set(found)) and set(found) == plain_walk(edges, seeds)
    least = {}
    for _, n, d in found:
        least[n] = min(d, least.get(n, d))
    assert {tuple(r) for r in reach.merged(walks).collect()} == set(least.items())
    within = {tuple(r) for r in reach.edges_within(e, walks).collect()}
    assert within == {(f, s, n) for f, n, _ in found for s, d in {(a, b) for a, b in edges} if d == n}
    assert reach.upstream(e, spark.createDataFrame([], "focus string, node string")).collect() == []


def test_a_ladder_of_sixty_diamonds_is_walked_node_by_node(spark):
    edges = [(f"{i + 1}", f"{i}{side}") for i in range(60) for side in "lr"] + [(f"{i}{side}", f"{i}") for i in range(60) for side in "lr"]
    seeds = [("x", "60"), ("x", "0")]
    walk = reach.upstream(spark.createDataFrame([(a, b) for a, b in edges if int(b.strip("lr")) < 4], "src string, dst string"), spark.createDataFrame(seeds[1:], "focus string, node string"))
    assert {(r["node"], r["depth"]) for r in walk.collect()} == {(n, d) for _, n, d in plain_walk([(a, b) for a, b in edges if int(b.strip("lr")) < 4], seeds[1:])}
    # 2^60 paths: only a search that expands a node once comes to an end
    wide = [(f"{i + 1}{t}", f"{i}{s}") for i in range(60) for s in "lr" for t in "lr"]
    short = spark.createDataFrame(wide, "src string, dst string").coalesce(1)
    ends = {r["node"]: r["depth"] for r in reach.upstream(short, spark.createDataFrame([("x", "50l")], "focus string, node string")).collect()}
    assert ends == {"50l": 0} | {f"{50 + i}{s}": i for i in range(1, 11) for s in "lr"}


def test_more_walks_than_a_row_has_bits_and_nodes_of_other_kinds(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] * 2
    seeds = [(f"f{i}", i % 60) for i in range(150)] + [("f0", 7), (None, 9)]
    e = reach.stored(spark.createDataFrame(edges, "src long, dst long").repartition(3))
    found = [tuple(r) for r in reach.walk(e, spark.createDataFrame(seeds, "focus string, node long").repartition(5)).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_walk(edges, seeds)
    assert {tuple(r) for r in reach.fan_in(e).collect()} == {(d, len({s for s, x in edges if x == d})) for _, d in edges}


def test_walks_at_one_node_follow_an_edge_once(spark, monkeypatch):
    """Forty walks along one chain: a round writes a row for each node, not one for each walk."""
    rows = []
    scratch = reach.shared.scratch
    monkeypatch.setattr(reach.shared, "scratch", lambda s, what: rows.append(scratch(s, what)) or rows[-1])
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(3)], "src string, dst string")
    walks = reach.upstream(chain, spark.createDataFrame([(i, "n0") for i in range(40)], "focus int, node string"))
    assert walks.count() == 160
    at = next(p for p in rows if "/reach-" in p and not p.split("/reach-")[1].startswith(("edges", "walks", "step")))
    assert spark.read.parquet(at).count() == 4


def test_the_engines_own_walk_uses_no_view(spark):
    found = {r["object_name"]: r["depth"] for r in lineage.upstream(lineage.edges(spark), ["metric.share"]).collect()}
    seeds = spark.createDataFrame([("m", "metric.share")], "focus string, node string")
    assert found == {r["node"]: r["depth"] for r in reach.upstream(lineage.edges(spark), seeds).collect()}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tallyforge")]


WORDS = ["market", "share", "year", "the", "of", "red", "blue", "green", "份额", "排名", "x1", "tiv", "ev"]


def corpus(spark, n, seed):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    rows = [(f"c{i % (n - 3):03d}", "o", "k", rng.choice([None, "", "Market Share", "份额"]), rng.choice([None, text(12), text(12), "market " * 5]), rng.choice([None, [], ["EV", "red"], ["排名", ""]])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, object string, kind string, title string, text string, aliases array<string>").repartition(3)


def test_batch_hits_equal_those_of_each_question(spark, monkeypatch):
    rng = random.Random(3)
    docs = corpus(spark, 60, 1)
    asked = {i: q for i, q in enumerate([None, "", "  ", "unknown words", "the of", "market", "MARKET share ev", "份额排名", *(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))) for _ in range(12))])}
    for part, look, k in ((20_000, 16, 5), (7, 1, 3)):
        monkeypatch.setattr(postings, "PART", part)
        monkeypatch.setattr(postings, "FIRST_LOOK", look)
        found = {}
        for r in postings.search_all(docs, spark.createDataFrame(list(asked.items()), "q int, question string"), k).collect():
            found.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
        for q, text in asked.items():
            want = [(r["id"], r["score"]) for r in retrieval.search(docs, text, k).collect()]
            assert [x[1:] for x in sorted(found.get(q, []))] == want, text
    assert postings.search_all(docs.limit(0), spark.createDataFrame([(1, "market")], "q int, question string")).collect() == []


def test_common_tokens_are_not_joined(spark):
    """A question with one telling token and one that all chunks hold: the long list stays unread."""
    rows = [(i, "", "common " + ("rare a1 a2 a3 a4 a5" if i < 9 else f"w{i}"), []) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id int, title string, text string, aliases array<string>")
    seen = []
    whole = postings._chunks_of
    postings._chunks_of = lambda lists, wanted: seen.append(wanted) or whole(lists, wanted)
    try:
        found = postings.search_all(docs, spark.createDataFrame([(1, "rare a1 a2 a3 a4 a5 common")], "q int, question string"))
        assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
        assert all("common" not in {r["token"] for r in wanted.collect()} for wanted in seen)
    finally:
        postings._chunks_of = whole


def test_the_registered_batch_has_no_cross_join(spark):
    plan = driver_search.retrieval_batch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
