"""The registered queries of the operators in this subpackage; each derives its contract's columns from an operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import base, centroids, jaccard, licenses, linededup, mixing, neardup, packing, quality, resample, secrets, tokencount, topk, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, base.read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(base.read_table(spark, sf_dir, "documents"), seed=42, temperature=0.5, total=1.0)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(base.read_table(spark, sf_dir, "documents"))
    return found.drop("spans")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = base.read_table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(base.read_table(spark, sf_dir, "documents"), percent=80, n=5)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), length=4096, end_id=2).drop("ids")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(base.read_table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(base.read_table(spark, sf_dir, "documents"), ratio=0.02, least_pages=3)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_table(spark, sf_dir, "documents")
    return tokencount.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), limit=512)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.rule_ledger(base.read_table(spark, sf_dir, "documents"))
    judged = quality.apply_policies(ledger)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"), (F.col("kept_base") & F.col("kept_v1")).alias("kept"), "failed",
    )


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_table(spark, sf_dir, "documents")
    return resample.importance_resample(docs, base.read_table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(base.read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, seed=1)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_vectors(base.read_table(spark, sf_dir, "embeddings"), least=0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_license_scan": op3_license_scan,
    "op4_exact_topk": op4_exact_topk,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_pack": op6_pack,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resample": op11_importance_resample,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}


def _cluster_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """The rounds written out, one after another."""
    parts = [f"""
        v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS (
            SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS cluster, e
            FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, e FROM v ORDER BY h, e LIMIT {k})
        )"""]  # fmt: skip
    for r in range(rounds + 1):
        parts.append(f"""
        a{r} AS (
            SELECT v.row, v.vec_id, v.e, c.cluster, CAST(list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) AS BIGINT) AS distance
            FROM v CROSS JOIN c{r} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.cluster) = 1
        )""")  # fmt: skip
        if r < rounds:
            parts.append(f"""
        s{r} AS (
            SELECT cluster, list(m ORDER BY d) AS e FROM (
                SELECT cluster, d, CAST(floor(sum(x) / count(*)) AS DOUBLE) AS m
                FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM a{r}) GROUP BY cluster, d
            ) GROUP BY cluster
        ), c{r + 1} AS (
            SELECT c.cluster, coalesce(s.e, c.e) AS e FROM c{r} c LEFT JOIN s{r} s USING (cluster)
        )""")  # fmt: skip
    return f"""
        WITH {",".join(parts)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": """
        WITH RECURSIVE counts AS (
            SELECT source, count(*) AS n FROM documents GROUP BY source
        ), rates AS (
            SELECT source, n, round(sqrt(CAST(n AS DOUBLE)) / sum(sqrt(CAST(n AS DOUBLE))) OVER () * sum(n) OVER () / n, 9) AS rate FROM counts
        ), means AS (
            SELECT source, rate, greatest(1, CAST(ceil(rate / 64.0) AS INTEGER)) AS draws FROM rates
        ), steps AS (
            SELECT source, 0 AS k, rate / draws AS mean, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c FROM means
            UNION ALL
            SELECT source, k + 1, mean, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < ceil(mean + 12 * sqrt(mean) + 24)
        ), draws AS (
            SELECT d.rowid AS row, d.source, d.doc_id, m.rate, j,
                   (CAST(('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || j), 1, 13)) AS UBIGINT) + 0.5) / 4503599627370496.0 AS u
            FROM (SELECT *, row_number() OVER () AS rowid FROM documents) d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(generate_series(1, m.draws)) AS s(j)
        ), drawn AS (
            SELECT w.row, w.doc_id, w.rate, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM w.source AND s.c < w.u) AS n FROM draws w
        ), copies AS (
            SELECT row, any_value(doc_id) AS doc_id, any_value(rate) AS rate, CAST(sum(n) AS BIGINT) AS n FROM drawn GROUP BY row
        )
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(i AS INTEGER) AS copy_no, c.rate AS source_rate
        FROM copies c JOIN (SELECT *, row_number() OVER () AS rowid FROM documents) d ON c.row = d.rowid, unnest(generate_series(0, c.n - 1)) AS s(i)""",
    "op8_line_dedup": """
        WITH pages AS (
            SELECT *, row_number() OVER () AS page, string_split(text, chr(10)) AS lines FROM documents
        ), each AS (
            SELECT page, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS at FROM pages
        ), bare AS (
            SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM each
        ), gone AS (
            SELECT source, s FROM bare WHERE s <> '' GROUP BY source, s
            HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) > 0.02 * (SELECT count(*) FROM pages p WHERE p.source IS NOT DISTINCT FROM bare.source)
        ), kept AS (
            SELECT b.page, coalesce(string_agg(b.line, chr(10) ORDER BY b.at) FILTER (g.s IS NULL), '') AS text, count(g.s) AS dropped
            FROM bare b LEFT JOIN gone g ON b.source IS NOT DISTINCT FROM g.source AND b.s = g.s GROUP BY b.page
        )
        SELECT p.doc_id, CASE WHEN k.dropped > 0 THEN k.text ELSE p.text END AS text, p.lang, p.source,
               CASE WHEN k.dropped > 0 THEN length(k.text) ELSE p.n_chars END AS n_chars
        FROM pages p LEFT JOIN kept k USING (page)""",
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), terms AS (
            SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS d FROM v
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
            FROM terms q JOIN terms c ON q.d = c.d AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0 GROUP BY ALL
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scores QUALIFY rank <= 10""",
    "op12_centroid_clustering": _cluster_sql(k=16, rounds=3, dims=64, scale=64, seed=1),
    "op13_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), w AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.row AS a, b.row AS b FROM w a JOIN w b ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT row AS a, row AS b FROM v
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), ends AS (
            SELECT r.a AS row, min(v.vec_id) AS component_id FROM reach r JOIN v ON r.b = v.row GROUP BY r.a
        )
        SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.row) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN ends USING (row)""",
}
