"""Hashes on regular words, workers that start anew, hot keys: what small random tables don't show."""

import os
import random
import subprocess
import sys
import time
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tallyforge.llm import near_dedup, piece_coding, substring_dedup
from tallyforge.llm.common import strings
from tallyforge.llm.words import runs, whole

from .test_texts import expected_near, expected_repeats

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(n, a="a", b="b"):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def pairs_of_regular_texts():
    """Texts that differ in one long word, or in the order of two words, along the Thue-Morse sequence."""
    rows, i = [], 0
    for n in (1024, 2048, 4096):
        one, two = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
        head = " ".join(f"h{n}x{k}" for k in range(19))
        rows += [(i, f"{head} {one}"), (i + 1, f"{head} {two}"), (i + 2, one), (i + 3, two)]
        rows += [(i + 4, " ".join(thue_morse(n, f"u{n}", f"v{n}"))), (i + 5, " ".join(thue_morse(n, f"v{n}", f"u{n}")))]
        i += 10
    return rows


def test_regular_words_are_told_apart(docs):
    rows = pairs_of_regular_texts()
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs(rows)).drop("text")).collect()
    assert Counter(map(tuple, got)) == expected_repeats(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_groups(docs(rows)).collect()} == expected_near(rows)


def test_runs_and_wholes_depend_on_order():
    import numpy as np

    from tallyforge.llm.words import mix

    a, b = mix(np.arange(1, 3, dtype=np.uint64))
    for k in (2, 5, 20, 2048):
        one, two = np.array(thue_morse(k, a, b), np.uint64), np.array(thue_morse(k, b, a), np.uint64)
        assert runs(one, k)[0] != runs(two, k)[0]
        assert whole(one, np.array([0, k]))[0] != whole(two, np.array([0, k]))[0]


@pytest.mark.parametrize("least", [1, 4])
def test_hot_keys_change_no_result(docs, monkeypatch, least):
    """A phrase in ever new surroundings, which makes its anchor hot, with and without true repeats around it."""
    monkeypatch.setattr(substring_dedup, "_SAMPLED", 1)
    monkeypatch.setattr(substring_dedup, "_HOT_LEAST", least)
    rng = random.Random(21)
    phrase = " ".join(f"p{k}" for k in range(16))
    rows = [(i, " ".join(f"x{rng.randrange(4)}" for _ in range(rng.randrange(9))) + " " + phrase + " " + " ".join(f"y{rng.randrange(4)}" for _ in range(rng.randrange(9)))) for i in range(80)]
    hot = substring_dedup.hot_keys(docs(rows))
    assert len(hot) and (hot[1:] > hot[:-1]).all()
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs(rows)).drop("text")).collect()
    want = expected_repeats(rows)
    assert Counter(map(tuple, got)) == want and sum(gone for _, _, gone, _ in want) > 0


@pytest.mark.parametrize("kind", ["pair", "letters", "one", "odd"])
def test_long_chunks_without_spaces(kind):
    """A megabyte without a space takes seconds and gets the library's ids."""
    rng = random.Random(31)
    text = {"pair": lambda: "ab" * 500_000, "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "one": lambda: "a" * 1_000_000, "odd": lambda: "".join(rng.choices("the日本é☃in", k=300_000))}[kind]()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocab = piece_coding.vocabulary(MODEL)
    offsets, data = strings(pa.array([text, "a short one", text[:700] + " end"]))
    start = time.monotonic()
    ids, first, odd = piece_coding.encode(vocab, offsets, data, 2)
    assert time.monotonic() - start < 60 and not odd.any()
    for t, a, b in zip((text, "a short one", text[:700] + " end"), first, first[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_eos=True)


def test_long_and_short_agendas_agree(monkeypatch):
    rng = random.Random(32)
    texts = ["".join(rng.choice(["ab", "a", "the", " ", "ing", "é", "漢", "☃", "zz"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    vocab = piece_coding.vocabulary(MODEL)
    whole = piece_coding.encode(vocab, *strings(pa.array(texts)), 2)
    monkeypatch.setattr(piece_coding, "_SHORT", 3)
    parts = piece_coding.encode(vocab, *strings(pa.array(texts)), 2)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_cells_of_a_mixed_bucket_stay_small(docs, workers, monkeypatch):
    """Two groups whose members are alike within a group and just below the bound across: nothing of one group meets itself."""
    monkeypatch.setattr(near_dedup, "_BLOCK", 8)
    n = 64
    members = workers.createDataFrame([(7, 0, i) for i in range(1, 2 * n + 3)], "bucket long, lead long, id long")
    comps = workers.createDataFrame([(i, 1 if i <= n else 2 if i <= 2 * n else i) for i in range(1, 2 * n + 3)], "id long, component long")
    known = workers.createDataFrame([(i, 50, bytearray(128)) for i in range(1, 2 * n + 3)], "id long, n long, sketch binary")
    dealt, ends = near_dedup.cells(members, comps, known, own_blocks=False)
    blocks = {}
    for r in dealt.collect():
        blocks.setdefault(r["own"], []).append(r)
    pairs = {(r["i"], r["j"]) for r in ends.collect()}
    met = {frozenset((a["id"], b["id"])) for i, j in pairs for a in blocks[i] for b in blocks[j] if a["id"] != b["id"]}
    group = lambda i: 1 if i <= n else 2 if i <= 2 * n else i
    assert {frozenset((a, b)) for a in range(1, 2 * n + 3) for b in range(1, a) if group(a) != group(b)} <= met
    assert all(len({r["component"] for r in blocks[i] + blocks[j]}) > 1 for i, j in pairs)
    # blocks of one group meet those of the other and the one that the two others share, each cell is two rows
    assert max(map(len, blocks.values())) < 20 and ends.count() < 2 * (n / 8 + 1) ** 2 + 4 * n / 8
    # members so long that a block holds few
    monkeypatch.setattr(near_dedup, "_BLOCK_SHINGLES", 100)
    sizes = Counter(r["own"] for r in near_dedup.cells(members, comps, known, own_blocks=False)[0].collect())
    assert max(sizes.values()) < 12 and sum(sizes.values()) == 2 * n + 2


def test_two_large_groups_just_below_the_bound(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "_BLOCK", 8)
    rng = random.Random(33)
    base = [f"t{i}" for i in range(200)]
    other = base[:176] + [f"o{i}" for i in range(24)]
    rows = []
    for i in range(60):
        w = list(base if i % 2 else other)
        for _ in range(2):
            w[rng.randrange(150)] = f"e{rng.randrange(100000)}"
        rows.append((i, " ".join(w)))
    want = expected_near(rows)
    assert len({c for _, c, _ in want.values()}) > 1
    assert {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_groups(docs(rows)).collect()} == want


def test_scratch_is_shared_and_freed(docs, edge_rows, workers):
    import types

    from tallyforge.llm import common

    def session(master, **conf):
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: conf.get("path", d)), sparkContext=types.SimpleNamespace(master=master))

    assert common.scratch_root(session("local[4]")) == "/tmp/checkpoints" and common.scratch_root(session("spark://a:1", path="s3a://x/y/")) == "s3a://x/y"
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1000]"):
        with pytest.raises(ValueError):
            common.scratch_root(session(master))
    before = set(common._made)
    found = near_dedup.near_groups(docs(edge_rows))
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in set(common._made) - before]
    assert sorted(left) == ["named", "signatures"]
    assert found.count() == len(edge_rows)


FRESH = """
import sys
from tallyforge.session import build_session
import corpus_pipeline
from tallyforge.llm import queries
spark = build_session("local[2]", 2, "fresh", "2g", {"spark.python.worker.reuse": "false"})
for name, query in [*queries.QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
    if name in sys.argv[2:]:
        print(name, query(spark, sys.argv[1]).count())
"""


def test_every_python_query_runs_on_fresh_workers(docs, edge_rows, tmp_path):
    """Each task gets a worker that has run nothing before, as on an executor that replaces a lost one."""
    docs(edge_rows).write.parquet(str(tmp_path / "documents.parquet"))
    names = ["op1_best_fit_packing", "op2_substring_dedup", "op5_token_counts", "op7_piece_coding", "op8_language_id", "op10_minhash_near_dedup", "pipeline"]
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (home, os.environ.get("PYTHONPATH")) if x)}
    done = subprocess.run([sys.executable, "-c", FRESH, str(tmp_path), *names], capture_output=True, text=True, env=env, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    found = dict(x.split() for x in done.stdout.splitlines() if x.split()[0] in names)
    assert set(found) == set(names) and int(found["op2_substring_dedup"]) == len(edge_rows)
