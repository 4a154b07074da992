"""One query an operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.decontaminate import contaminated
from tapeworks.llm.exact_dedup import exact_duplicates
from tapeworks.llm.filter_audit import audit_filters
from tapeworks.llm.html_extract import extract_pages
from tapeworks.llm.langid import identify
from tapeworks.llm.packing import pack_documents
from tapeworks.llm.pii import pii_spans
from tapeworks.llm.simhash import near_duplicate_classes
from tapeworks.llm.substring_dedup import remove_repeated_passages
from tapeworks.llm.token_counts import piece_vocabulary, token_counts
from tapeworks.llm.topk_search import top_k
from tapeworks.llm.warc import archive_pages


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), piece_vocabulary(tokenizer_path("piece_bpe_32k.model")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_html_extraction, op2_simhash_near_dedup, op3_pii, op4_best_fit_packing, op5_language_id, op6_substring_dedup, op7_token_counts, op8_benchmark_decontamination, op9_exact_dedup, op10_warc, op11_topk_search, op12_filter_audit]
    return {f.__name__: f for f in every}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring_dedup": r"""
            WITH d AS (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), win AS (
                SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13
            ), keyed AS (
                SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM win
            ), least_doc AS (
                SELECT s, min(doc_id) AS m FROM keyed GROUP BY s
            ), hit AS (
                SELECT k.doc_id, k.p FROM keyed k JOIN least_doc l USING (s) WHERE l.m < k.doc_id
            ), gone AS (
                SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM hit
            ), words AS (
                SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
            ), kept AS (
                SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS t FROM words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id
            ), lost AS (
                SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
            )
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
            FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN lost l USING (doc_id)
        """,
        "op9_exact_dedup": f"""
            WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
            SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
            FROM n JOIN g USING (t)
        """,
        "op10_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            g AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h),
            x AS (SELECT p.page_id, p.h, g.keep, sha1(p.h) AS d FROM p JOIN g USING (h))
            SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    CAST(((CAST('0x' || substr(d, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
                CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
            FROM x
        """,
        "op11_topk_search": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS k
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scored AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.k AS DOUBLE[]), CAST(c.k AS DOUBLE[])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
            )
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
        """,
        "op12_filter_audit": r"""
            WITH d AS (
                SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), firsts AS (
                SELECT t, min(doc_id) AS m FROM d GROUP BY t
            ), l AS (
                SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
            ), fails AS (
                SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                    CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
                    + 4 * CAST(100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) AS INTEGER)
                    + 8 * CAST(regexp_matches(d.t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(firsts.m < d.doc_id, false) AS INTEGER) AS mask
                FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)
            ), cells AS (
                SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
            ), f AS (
                SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(name, bit)
            ), orders AS (
                SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
                FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
            ), steps AS (
                SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before
                FROM orders, range(1, 6) AS r(i)
            ), counted AS (
                SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
                    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
                    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
                FROM cells, steps GROUP BY part, filter_order, step, bit
            )
            SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
                CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
                CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
            FROM counted
        """,
    }
