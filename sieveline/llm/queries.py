"""Queries over the training-data operators and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, exact_dedup, html_extract, langid, line_dedup, mixing, quality, simhash, suffix_dedup
from .common import cut, join_sized, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_units", "n_removed", "removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, sources = mixing.mix(docs, F.array("source"))
    return join_sized(out, cut(sources), ["key"], "n", docs.count()).select("doc_id", "size", "source_size", "target", "taken")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks as text, start-end,start-end..."""
    spans = F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return chat_format.rotate(table(spark, sf_dir, "conversations")).withColumn("masks", F.array_join(spans, ","))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_exact_dedup, op2_quality, op3_line_dedup, op4_language, op5_decontam, op6_mix, op7_html, op8_chat, op9_simhash, op10_suffix)}

SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
        k AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(n) AS text_sha256 FROM k
    """,
    "op5_decontam": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, g)),
        words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op8_chat": """
        WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS n FROM conversations GROUP BY ALL),
        seen AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
        placed AS (SELECT *, coalesce(CAST(floor(sum(length(text) + length(role) + CASE WHEN role = 'system' THEN 0 ELSE 10 END + 24) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 1048576) AS BIGINT), 0) AS part FROM said),
        m AS (SELECT s.*, perspective,
                     '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
                     text || '<|im_end|>' AS body
              FROM placed s JOIN seen v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
        e AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text) AS upto FROM m)
        SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_messages, CAST(sum(n) - count(*) AS BIGINT) AS n_repeats,
               string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
               coalesce(string_agg(CAST(CAST(upto - length(body) - 1 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(upto - 1 AS INTEGER) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (role = perspective), '') AS masks
        FROM e GROUP BY conv_id, perspective, part
    """,
}
