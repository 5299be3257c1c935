"""The operators as registered queries, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, jaccard, langid, line_dedup, mixing, packing, pii, prefix_trie, quality_model, quality_rules, secret_scan, variants
from .shared import materialize, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_pages(pages, html_text.fit_weights(pages))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(table(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_languages(docs))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_documents(docs, quality_model.fit_quality(docs, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")), "turns")
    conv = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.regrafted(rows, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_personal_data, op3_html_text, op4_quality_rules, op5_benchmark_leaks, op6_packing, op7_line_dedup, op8_jaccard_join,
        op9_language_id, op10_quality_classifier, op11_spelling_variants, op12_source_mixing, op13_conversation_trie,
    )
}

#: Of the operators only the mixing is SQL as a whole; tests hold the others against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op12_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                CAST('0x' || left(md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 12) AS BIGINT) AS key
            FROM documents
        ),
        sources AS (
            SELECT src, CAST(sum(size) AS BIGINT) AS size, (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1 AS weight
            FROM sized GROUP BY src
        ),
        -- sources in the order in which they reach their caps, and the level if all before are clamped; it rises up to the right one and falls then
        levels AS (
            SELECT *, 3 * size AS cap,
                ((SELECT sum(size) FROM sources) - coalesce(sum(3 * size) OVER before, 0)) / (sum(weight) OVER after) AS level
            FROM sources
            WINDOW before AS (ORDER BY size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS (ORDER BY size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ),
        target AS (
            SELECT src, size AS source_size, CASE WHEN cap < weight * l.level THEN CAST(cap AS DOUBLE) ELSE weight * l.level END AS target
            FROM levels, (SELECT max(level) AS level FROM levels) l
        ),
        need AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS need FROM target),
        plan AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE need // source_size END AS whole, CASE WHEN source_size = 0 THEN 0 ELSE need % source_size END AS rest
            FROM need
        ),
        ordered AS (
            SELECT doc_id, size, source_size, target, whole, rest,
                sum(size) OVER (PARTITION BY s.src ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                sum(size) OVER (PARTITION BY s.src, key) AS tied
            FROM sized s JOIN plan p ON s.src IS NOT DISTINCT FROM p.src
        ),
        parts AS (
            SELECT *, CASE WHEN size = 0 OR upto - tied >= rest THEN 0 WHEN upto <= rest THEN size ELSE size * (rest - upto + tied) // tied END AS part
            FROM ordered
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
            CAST(whole + CASE WHEN size > 0 AND part >= size THEN 1 ELSE 0 END AS BIGINT) AS copies,
            CAST(whole * size + part AS BIGINT) AS taken
        FROM parts
    """,
}
