"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_dedup, html_text, language_id, license_scan, merkle, near_dedup, packing, piece_coding, sharding, substring_dedup, token_counts, vector_search
from .common import NULL_ID, doc_key, spread, stored, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return substring_dedup.digest(substring_dedup.remove_repeats(docs).drop("text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    size, digest = (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary"))
    return placed.select("doc_id", size.alias("size"), digest.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.per_document(license_scan.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.quantised(table(spark, sf_dir, "embeddings"))
    return vector_search.top_k(vectors, F.col("vec_id") % 20 == 0)


def op7_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.digest(piece_coding.code_texts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.train(docs), ["doc_id"])
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def dedup_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact dedup, near-dedup and substring dedup in a row leave of all documents: a row for each that stays."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = stored(exact_dedup.drop_copies(docs), "dedup-exact")
    kept = near_dedup.near_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__kept")).distinct()
    docs = stored(docs.join(kept, doc_key() == F.col("__kept"), "left_semi"), "dedup-near")
    return substring_dedup.digest(substring_dedup.remove_repeats(docs).drop("text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.quantised(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), 256, 64)
    return centroids.with_inertia(*centroids.cluster(vectors, 40, 5, "2:"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").isNotNull()
    changed = {"text": F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], changed)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_exact_topk_search": op6_exact_topk_search,
    "op7_piece_coding": op7_piece_coding,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_html_extraction": op13_html_extraction,
    "dedup_stages": dedup_stages,
}


def _clustering_sql(k: int, rounds: int) -> str:
    """Every round spelled out: a table of centroids, then a table of assignments."""
    steps = [
        "x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT n.vec_id, n.v, b.j, b.d FROM (SELECT row_number() OVER () AS i, * FROM x) n,"
            f" LATERAL (SELECT j, list_sum(list_transform(list_zip(n.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM c{r} c ORDER BY d, j LIMIT 1) b)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT j, p, floor(sum(y) / count(*)) AS y FROM (SELECT j, unnest(v) AS y, unnest(range(1, 65)) AS p FROM a{r}) GROUP BY j, p)"
            )
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT j, list(y ORDER BY p) AS v FROM m{r} GROUP BY j) m USING (j))"
            )
    last = rounds
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256"
        f" FROM a{last} JOIN c{last} c USING (j)"
    )

ORACLE_SQL: dict[str, str] = {
    "op13_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(h1|p)>|<br>', ' ', 'g'), '</?b>', '', 'g') AS t FROM a),
e AS (SELECT page_id, url, list_reduce([['&lt;', '<'], ['&gt;', '>'], ['&quot;', '"'], ['&#x27;', chr(39)], ['&#39;', chr(39)], ['&amp;', '&']], lambda x, y: [replace(x[1], y[1], y[2])], [t])[1] AS t FROM b)
SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp( |$)', '&\1', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text,
  CAST(length(text) AS BIGINT) AS n_chars FROM e
""",
    "op11_centroid_clustering": _clustering_sql(40, 5),
    "op12_merkle_manifest": r"""
WITH RECURSIVE c AS (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents),
e AS (SELECT *, list_reduce(list_transform(range(0, 8 * len(k)), lambda j: (ascii(substr(k, j // 8 + 1, 1)) >> (j % 8)) & 1),
  lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384 ELSE 0 END), 4294967295) % 2 = 1 AS tampered FROM c),
f AS (SELECT *, coalesce(strlen(k) || ':' || k, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS other FROM e),
t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS g,
  sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS o FROM f),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM t),
lv(g, level, i, n, h) AS (SELECT g, 0, i, n, leaf FROM p
  UNION ALL SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY g, level, i // 3, n),
s AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
tv(g, level, i, n, h) AS (SELECT '', 0, i, n, h FROM s UNION ALL SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tv WHERE n > 1 GROUP BY g, level, i // 3, n),
x AS MATERIALIZED (SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM lv a JOIN lv b ON a.g = b.g AND a.level = b.level AND a.i // 3 = b.i // 3 GROUP BY ALL),
y AS MATERIALIZED (SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM tv a JOIN tv b ON a.level = b.level AND a.i // 3 = b.i // 3 GROUP BY ALL),
u(rid, g, level, i, n, h, proof) AS (SELECT rid, g, 0, i, n, o, '' FROM p
  UNION ALL SELECT rid, u.g, u.level + 1, u.i // 3, (n + 2) // 3, sha256(l || h || r), proof || l || r FROM u JOIN x ON u.g = x.g AND u.level = x.level AND u.i = x.i WHERE n > 1),
v(rid, level, i, n, h, proof) AS (SELECT rid, 0, s.i, s.n, u.h, proof FROM u JOIN s USING (g) WHERE u.n = 1
  UNION ALL SELECT rid, v.level + 1, v.i // 3, (n + 2) // 3, sha256(l || h || r), proof || l || r FROM v JOIN y ON v.level = y.level AND v.i = y.i WHERE n > 1)
SELECT doc_id, leaf, s.h AS subroot, tv.h AS root, sha256(proof) AS proof_sha256, v.h AS folded_root, v.h = tv.h AS verified
FROM v JOIN t USING (rid) JOIN s USING (g) CROSS JOIN tv WHERE v.n = 1 AND tv.n = 1
""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM g WHERE r > 1),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM t ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op6_exact_topk_search": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.z FROM r JOIN (SELECT a AS y, b AS z FROM l UNION ALL SELECT b, a FROM l) l ON l.y = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY k) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(k) AS text_sha256
FROM d WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)
""",
}


def _stages_sql() -> str:
    """The three stages' SQL, each over the documents that the last one kept."""
    of = lambda op, docs: ORACLE_SQL[op].replace("FROM documents", f"FROM {docs}")
    return f"""WITH one AS ({of("op9_exact_dedup", "documents")}), d1 AS (SELECT doc_id, text FROM documents JOIN one USING (doc_id) WHERE one.kept),
two AS ({of("op10_minhash_near_dedup", "d1")}), d2 AS (SELECT doc_id, text FROM d1 JOIN two USING (doc_id) WHERE two.kept)
SELECT * FROM ({of("op2_substring_dedup", "d2")})"""


ORACLE_SQL["dedup_stages"] = _stages_sql()
