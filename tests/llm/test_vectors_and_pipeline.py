"""Vector search against brute force, and the pipeline stage by stage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import exact_dedup, near_dedup, queries, vector_search

from .test_texts import expected_near, expected_repeats, words


def brute(rows, k):
    good = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = set()
    for i, v in good:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in good if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("kind", ["plain", "ties", "odd", "few"])
def test_top_k(kind, workers):
    rng = np.random.default_rng(3)
    if kind == "plain":
        rows = [(i, (rng.normal(size=16) / 4).tolist()) for i in range(700)]
    elif kind == "ties":  # one vector is a third of all, the others take few values
        rows = [(i, [0.5] * 8 if i % 3 == 0 else rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(600)]
    elif kind == "odd":
        rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (40, [0.3]), (41, [-0.01, 5.0]), (None, [1.0, 1.0]), (60, [])]
    else:
        rows = [(20, [0.5, -0.5])]
    table = workers.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    vectors = vector_search.quantised(table)
    got = {tuple(r) for r in vector_search.top_k(vectors, F.col("vec_id") % 20 == 0, 5).collect()}
    assert got == brute([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5)


def test_top_k_in_many_blocks(workers, monkeypatch):
    for name, value in (("QUERY_BLOCK", 4), ("VECTOR_BLOCK", 16), ("STRIPE", 2)):
        monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    vectors = vector_search.quantised(workers.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {tuple(r) for r in vector_search.top_k(vectors, F.col("vec_id") % 20 == 0, 20).collect()} == brute(rows, 20)


def test_top_k_of_long_vectors(workers):
    """Scores beyond 2^53 are exact; long vectors take part, and a score that no long holds is an error where it is returned."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) * 2.0 ** float(rng.integers(0, 22))).tolist()) for i in range(200)]
    rows += [(300 + i, [4e6 + i / 64] * 8) for i in range(9)]
    rows += [(340, [1e8, 1.0]), (341, [2e7, 0.0]), (342, [-1e20, 3.0]), (343, [1e13] + [0.0] * 20 + [2e7])]
    rows += [(360 + i, [0.0] * (22 + i) + [(-1.0) ** i * 10.0 ** (8 + i)] + [0.0] * 2 + [float(i)] * 3) for i in range(12)]
    vectors = vector_search.quantised(workers.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = lambda df: {tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()}
    some = [r for r in rows if r[0] not in (342, 343)]
    assert got(vectors.where("vec_id not in (342, 343)")) == big_brute(some, 20)
    assert max(s for *_, s in big_brute(some, 20)) > 2**60
    with pytest.raises(Exception, match="scale the vectors down"):
        got(vectors)
    far = [r for r in rows if r[0] < 200] + [(380, [0.0] * 20 + [1e5]), (381, [0.0] * 20 + [-1e20])]  # their product is no long, and no best either
    assert got(vector_search.quantised(workers.createDataFrame(far, "vec_id long, embedding array<double>"))) == big_brute(far, 20)
    with pytest.raises(Exception, match="scale the vectors down"):
        vector_search.quantised(workers.createDataFrame([(1, [1e307])], "vec_id long, embedding array<double>")).collect()
    wide = vector_search.quantised(workers.createDataFrame([(20, [1e300, 1.0]), (21, [0.0, 2.0]), (22, [0.0, 5.0])], "vec_id long, embedding array<double>"))
    assert got(wide) == {(20, 1, 22, 64 * 320), (20, 2, 21, 64 * 128)}


def big_brute(rows, k):
    """By Python's integers, with vectors padded by zeros."""
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = set()
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != q)[:k]
            out |= {(q, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def test_search_on_an_empty_table(workers, tmp_path):
    workers.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES["op6_exact_topk_search"](workers, str(tmp_path)).collect() == []


def test_stages(docs, edge_rows, workers):
    frame = docs(edge_rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = frame.collect()
        after = corpus_pipeline.stored(stage(workers, frame, ""), name)
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name != "best_fit_packing":
            assert after.columns == frame.columns
            kept[name] = [(r["doc_id"], r["text"]) for r in after.collect()]
        if name == "exact_dedup":
            want = exact_dedup.exact_groups(frame).where("kept").select("doc_id").distinct().count()
            assert len(kept[name]) == want
        if name == "near_dedup":
            assert {i for i, _ in kept[name]} == {i for i, (_, _, stays) in expected_near(rows).items() if stays}
        if name == "substring_dedup":
            assert [(i, t) for i, t in rows if (i, t) in kept[name]]
            assert sum(len(words(t)) for _, t in kept[name]) == sum((n - gone) * m for (_, n, gone, _), m in expected_repeats(rows).items())
        frame = after
    assert set(frame.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_language_stage_learns_and_rejects(workers):
    rows = [(i, "kalo mika loka" if i % 2 else "zery tuze ryze", "aa" if i % 2 else "bb", "s", 14) for i in range(80)] + [(90, "123", "aa", "s", 3), (91, None, None, None, None), (92, "kalo loka", None, "s", 9)]
    frame = workers.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(workers, frame, "").collect()}
    assert set(got) == {*range(80), 92} and got[92] == "aa"


def test_run_on_empty_documents(docs, workers, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(workers, str(tmp_path)).collect() == []


def test_near_dedup_holds_one_document_per_group(docs):
    rows = [(i, " ".join(f"w{k}" for k in range(50) if k != i)) for i in range(3)]
    assert [r["doc_id"] for r in near_dedup.near_groups(docs(rows)).where("kept").collect()] == [0]
