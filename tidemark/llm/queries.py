"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_rates

    return mixing_rates(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), n=4)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(_docs(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_docs(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_docs(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = _docs(spark, sf_dir)
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_docs(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align_tokens

    return align_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_substring_dedup, op3_mixing, op4_near_dedup, op5_lm_scoring, op6_pii, op7_sharding, op8_license_scan, op9_quality, op10_packing,
        op11_source_divergence, op12_token_alignment, op13_top_k_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op2_substring_dedup": r"""
        WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        g AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS g FROM (SELECT doc_id, h, unnest(generate_series(1, n - 199)) AS i FROM h WHERE n >= 200)),
        r AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM g) WHERE k > 1),
        e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
        t AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM e),
        spans AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM t GROUP BY doc_id, span),
        kept AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
        gaps AS (SELECT s.doc_id, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM spans s UNION ALL SELECT s.doc_id, max(b) + 1, any_value(h.n) FROM spans s JOIN h USING (doc_id) GROUP BY s.doc_id),
        rest AS (SELECT gaps.doc_id, string_agg(substr(h, CAST(2 * x - 1 AS BIGINT), CAST(2 * (y - x + 1) AS BIGINT)), '' ORDER BY x) AS hx FROM gaps JOIN h USING (doc_id) WHERE y >= x GROUP BY gaps.doc_id)
        SELECT h.doc_id, h.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h.h ELSE coalesce(hx, '') END)) AS kept_sha256
        FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN rest USING (doc_id)""",
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS sh FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        steps AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT steps.b, reach.root FROM reach JOIN steps ON steps.a = reach.node),
        least_root AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least_root r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS MATERIALIZED (SELECT k, lang, source, unnest(ts) AS term FROM d),
        kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
        n AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
        groups AS (SELECT DISTINCT lang, source FROM d),
        grid AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS n, sum(coalesce(c, 0)) OVER (PARTITION BY lang) AS nl,
            sum(coalesce(c, 0)) OVER (PARTITION BY lang, term) AS cl, count(*) OVER (PARTITION BY lang, source) AS v FROM groups JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
        shares AS MATERIALIZED (SELECT lang, source, term, c, CAST(1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (n + 2 * v) AS HUGEINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (cl + 2) // (nl + 2 * v) AS HUGEINT) AS q FROM grid),
        cells AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT g.lang, g.source, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.item = h.source),
        terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares WHERE c > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
        UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 10""",
    "op13_top_k_search": """
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.k, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score FROM v q JOIN v d ON q.k <> d.k AND q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
}
