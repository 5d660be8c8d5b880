"""Clustering, manifest and page text against brute force, with edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import centroids, html_text, merkle
from tallyforge.llm.queries import op11_centroid_clustering, op12_merkle_manifest, op13_html_extraction

DATA = "/root/testdata/sf0.001"


def lloyd(rows, k, rounds, salt):
    """Plain clustering with Python's integers: {position: (cluster, distance)}."""
    first = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{salt}{rows[i][0]}".encode()).hexdigest(), rows[i][1]))[:k]
    cents = [list(rows[i][1]) for i in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for last in [False] * rounds + [True]:
        of = [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in rows]
        if last:
            return {i: (j, d) for i, (d, j) in enumerate(of)}, cents
        for j in range(len(cents)):
            mine = [rows[i][1] for i in range(len(rows)) if of[i][1] == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]


@pytest.mark.parametrize("spread", [3, 2**14, 2**25])
def test_clusters_equal_plain_integers(workers, spread):
    rng = np.random.default_rng(spread)
    rows = [(i % 150, [int(x) for x in rng.integers(-spread, spread, 8)]) for i in range(200)] + [(500 + i, [spread] * 8) for i in range(60)]
    df = workers.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, v array<long>, cluster string").drop("cluster").repartition(5)
    want, cents = lloyd(rows, 12, 3, "s:")
    found, got = centroids.cluster(df, 12, 3, "s:")
    assert got.tolist() == cents
    assert sorted(map(tuple, found.collect())) == sorted((rows[i][0], j, d) for i, (j, d) in want.items())
    out = centroids.with_inertia(found, got).collect()
    assert {r["inertia"] for r in out} == {sum(d for _, d in want.values())}
    assert {r["cluster"]: r["cluster_inertia"] for r in out} == {j: sum(d for c, d in want.values() if c == j) for j in {j for j, _ in want.values()}}


def test_screening_spares_distances_and_never_the_nearest():
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (40, 64))
    x = np.concatenate([c[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64)), c])
    number, distance, taken = centroids.nearest(x, c)
    plain = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert (distance == plain.min(1)).all() and (number == plain.argmin(1)).all()
    assert taken < 0.2 * plain.size


def test_unfit_vectors_take_no_part(workers):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [None, 0.0]), (6, []), (7, [0.51, -0.26]), (7, [0.51, -0.26]), (None, [1.0, 1.0])]
    df = workers.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = centroids.quantised(df, 256, 2)
    assert sorted(map(str, kept.collect())) == sorted(["Row(vec_id=None, v=[256, 256])", *["Row(vec_id=7, v=[130, -67])"] * 2])
    found, cents = centroids.cluster(kept, 40, 2, "2:")
    assert len(cents) == 3 and found.count() == 3 and {r["distance"] for r in found.collect()} == {0}
    nothing, cents = centroids.cluster(centroids.quantised(df.where("vec_id < 5"), 256, 2), 40, 2)
    assert centroids.with_inertia(nothing, cents).collect() == []
    long = workers.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="scale the vectors down"):
        centroids.quantised(long, 256, 2).collect()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). The contract word for word, a list level by level."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, l, n, t: h(*map(part, (i, s, l, n, t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def proof(tree, at):
        path = []
        for level in tree[:-1]:
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            path.append((run[: at % 3], run[at % 3 + 1 :]))
            at //= 3
        return path

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: levels([leaf(*r) for r in groups[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(groups[s]):
            path = proof(trees[s], at) + proof(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], h(*(x for l, r_ in path for x in l + r_)), now, now == top[-1][0]))
    return out


def manifest(df):
    even = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").isNotNull()
    changed = {"text": F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    found = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], changed)
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("block", [1, 2, 6])
def test_manifest_equals_plain_lists(workers, monkeypatch, block):
    monkeypatch.setattr(merkle, "LEVELS", block)
    monkeypatch.setattr(merkle, "BLOCK", 3**block)
    rows = [(i, "hot", "en", i, f"line\n{i}") for i in range(100)] + [(i, f"s{i % 11}é", None, None, "a\nb" * i) for i in range(40)]
    rows += [(None, None, None, None, None), (7, None, "de", 1, ""), (7, "hot", "en", 7, "other"), (7, "hot", "en", 7, "other"), (8, "", "x", 2, "\n"), (9, "￿", "x", 2, "y"), (10, "𐍈", "x", 2, "y")]
    df = workers.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, pos int").repartition(7)
    assert sorted(map(str, manifest(df))) == sorted(map(str, plain_manifest(rows)))


def test_manifest_of_few_rows(workers):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest(workers.createDataFrame([], schema)) == []
    one = [(5, "a", "en", 1, "x\ny")]
    assert manifest(workers.createDataFrame(one, schema)) == plain_manifest(one)


def test_blocks_tell_article_from_the_rest():
    text = lambda page: " ".join(t for k, _, t in html_text.blocks(page) if k != html_text.OUT)
    assert text("<body><nav>n</nav><header>h</header><article><header><h1>A</h1></header><p>one <b>t</b>wo<br>three &lt;&amp;</p><aside>s</aside></article><footer>f</footer>") == "A one two three <&"
    assert text("<div class='has-sidebar'><div class=post-content><h2>q</h2>w<div class='share'>s</div></div><div class=footer>z</div></div>") == "q w"
    assert text("<article>x<section class='reader-comments'><article>c</article></section><article>r</article>y</article>") == "x y"
    assert text("<div class=sidebar><article>teaser</article></div><article>real</article>") == "real"
    assert text("<form id=aspnetForm><h1>T</h1><p>y</p></form><form><p>mail</p></form>") == "T y"
    assert text("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>c") == "a b 1 2 c"
    assert text("<p>a\xa0 &nbsp;\n b</p><!-- <p>no</p> --><script>if (a<b) '</p>'</script><noscript>no</noscript>") == "a b"
    assert text("<p>shown<span hidden>no<span>no</span>no</span> too</p><div style='display: none'>no</div><div aria-hidden=true>no</div><div role=banner>no</div>") == "shown too"
    assert text("a < b &am &amp c <a title='>'>d</a> <i title=\"x>e</i><p>cut <b") == "a < b &am & c d e cut"
    assert text("") == "" and text("plain &copy; text") == "plain © text"
    assert text("<DIV CLASS='Cookie-Notice'>x</DIV><MAIN><P>m</P></MAIN><div>left</div>") == "m"
    deep = "<div>" * 30000 + "x" + "</p></i>" * 30000
    assert text(deep) == "x"


def page(*parts):
    return "<html><body>" + "".join(f"<div>{p}</div>" for p in parts) + "</body></html>"


def brute_text(rows):
    """Unmarked pages by comparing all substrings of five tokens of all pages of a host, in sets."""
    pages = [(html_text.host(u), html_text.blocks(h or "")) for _, u, h in rows]

    def stream(blocks):
        out = []
        for b, (kind, tag, text) in enumerate(blocks):
            if kind != html_text.IN:
                out += [(f"<{tag}", b), *((w, b) for w in text.split(" "))]
        return out

    streams = [stream(b) for _, b in pages]
    grams = [{(h, *(t for t, _ in s[i : i + 5])) for i in range(len(s) - 4)} for (h, _), s in zip(pages, streams, strict=True)]

    def covered(p, repeats):
        s, out = streams[p], set()
        for i in range(len(s) - 4):
            if (pages[p][0], *(t for t, _ in s[i : i + 5])) in repeats:
                out |= set(range(i, i + 5))
        return out

    def repeated(of):
        count = {}
        for p in of:
            for g in grams[p]:
                count[g] = count.get(g, 0) + 1
        return {g for g, n in count.items() if n >= 3}

    every = repeated(range(len(pages)))
    witness = []
    for p, (_, blocks) in enumerate(pages):
        own = [i for i, (_, b) in enumerate(streams[p]) if blocks[b][0] == html_text.OPEN]
        if any(k == html_text.IN for k, _, _ in blocks) or 2 * len(set(own) - covered(p, every)) >= len(own):
            witness.append(p)
    final = repeated(witness)
    out = []
    for p, (_, blocks) in enumerate(pages):
        hit, kept = covered(p, final), []
        for b, (kind, _, text) in enumerate(blocks):
            at = [i for i, (_, x) in enumerate(streams[p]) if x == b]
            if kind == html_text.IN or (kind == html_text.OPEN and len(set(at) & hit) < 0.8 * len(at)):
                kept.append(text)
        out.append((rows[p][0], rows[p][1], " ".join(kept), len(" ".join(kept))))
    return out


def pages_of_hosts():
    menu, legal = "Home News Sport Weather Mail", "All rights reserved by the owner of this host"
    rows = [(i, f"http://a.example/{i}", page(menu, *(f"own text {i} number {j} of page {i} with words {i * j}" for j in range(6)), legal)) for i in range(9)]
    same = [f"copied story part {j} told the same way on every copy" for j in range(8)]
    rows += [(20 + i, f"https://u@a.example:80/{i}?q", page(menu, *same, legal)) for i in range(5)]
    rows += [(30 + i, "http://b.example/", page(*same)) for i in range(4)]
    rows += [(40, "http://b.example/", page(menu, "a single page of this kind")), (41, None, None), (42, "nonsense", ""), (None, None, "bare text"), (9, None, page(menu)), (9, None, page(menu)), (9, None, page(menu))]
    rows += [(50, "http://a.example/m", f"<main><h1>Title here</h1><div>{legal}</div><article><p>{legal}</p></article></main>")]
    return rows


@pytest.mark.parametrize("parts,most", [(1, 2000), (5, 2000), (3, 2)])
def test_open_blocks_that_a_host_repeats_go(workers, parts, most):
    rows = pages_of_hosts()
    df = workers.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(parts)
    got = sorted(map(tuple, html_text.main_text(df).collect()), key=str)
    assert got == sorted(brute_text(rows), key=str)
    texts = {r[0]: r[2] for r in got}
    assert "Home" not in texts[0] and "rights" not in texts[0] and texts[0].startswith("own text 0 number 0")
    assert texts[20].startswith("copied story part 0") and "rights" not in texts[20] and "Home" not in texts[20]
    assert texts[30].count("copied story") == 8 and texts[40].startswith("Home News")
    assert texts[50] == "Title here All rights reserved by the owner of this host" and texts[41] == ""
    assert html_text.main_text(df.limit(0)).collect() == []


def test_registered_queries_take_whole_tables(workers):
    assert op11_centroid_clustering(workers, DATA).count() == workers.read.parquet(f"{DATA}/embeddings.parquet").count()
    found = op12_merkle_manifest(workers, DATA)
    docs = [tuple(r) for r in workers.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(tuple(r[c] for c in cols) for r in found.collect()) == sorted(plain_manifest(docs))
    texts = op13_html_extraction(workers, DATA).collect()
    assert len(texts) == workers.read.parquet(f"{DATA}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in texts)
