"""Queries over text functions and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import oracle as o
from ..functions import text as t
from ..operators import lexical
from .catalogue import query, table

LONG = "long"


@query(f"SELECT doc_id, CAST({o.tokens('text')} AS BIGINT) AS tokens FROM documents")
def token_count_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.token_count(F.col("text")).alias("tokens"))


@query(f"SELECT page_id, CAST({o.tokens('html')} AS BIGINT) AS tokens FROM pages")
def token_count_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.token_count(F.col("html")).alias("tokens"))


@query(f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS n_blank, CAST(coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS longest FROM (SELECT doc_id, {o.lines('text')} AS l FROM documents)")
def line_stats(spark: SparkSession, d: str) -> DataFrame:
    ls = table(spark, d, "documents").select("doc_id", t.lines(F.col("text")).alias("l"))
    return ls.select("doc_id", F.size("l").cast(LONG).alias("n_lines"), F.size(F.filter("l", lambda x: F.trim(x) == "")).cast(LONG).alias("n_blank"), F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0)).cast(LONG).alias("longest"))


CAMEL = "replace(p_name, ' ', 'X') || 'HTTPServer_' || replace(p_type, ' ', '_')"


@query(f"SELECT p_partkey, array_to_string({o.parts('n')}, '|') AS parts FROM (SELECT p_partkey, {CAMEL} AS n FROM part)")
def split_identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(t.split_identifier(F.expr(CAMEL)), "|").alias("parts"))


@query(f"WITH {o.bag('b', 'documents', 'doc_id', 'text')} SELECT doc_id, term, count(*) AS n FROM b GROUP BY ALL")
def lex_terms_bag(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("tf", "n")


@query(f"SELECT term, array_to_string(list_sort({o.variants('term')}), ' ') AS folds FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM documents)")
def term_variants(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(t.WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("term")).distinct()
    return words.select("term", F.array_join(F.array_sort(t.variants(F.col("term"))), " ").alias("folds"))


@query(f"WITH {o.bag('b', 'benchmark', 'item_id', 'text')} SELECT i.item_id, coalesce(terms, '') AS terms FROM benchmark i LEFT JOIN (SELECT item_id, string_agg(term, ' ' ORDER BY term) AS terms FROM (SELECT DISTINCT item_id, term FROM b WHERE {o.USABLE}) GROUP BY item_id) USING (item_id)")
def usable_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(t.usable_terms(F.col("text"))), " ").alias("terms"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_$]*'), lambda w: length(w) >= 4 AND regexp_matches(w, '_|.[A-Z]')), lambda w: lower(w)))), ' ') AS identifiers FROM documents""")
def full_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(t.full_identifiers(F.col("text"))), " ").alias("identifiers"))


@query(rf"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(html, '(?i)\b({o.WORDS})\b', 0), lambda w: lower(w)), list_filter([
    CASE WHEN contains(html, '>=') THEN '>=' END, CASE WHEN contains(html, '<=') THEN '<=' END, CASE WHEN contains(html, '==') THEN '==' END, CASE WHEN contains(html, '!=') THEN '!=' END,
    CASE WHEN regexp_matches(html, '(^|[^<>=!])>([^=]|$)') THEN '>' END, CASE WHEN regexp_matches(html, '(^|[^<>=!])<([^=]|$)') THEN '<' END], lambda x: x IS NOT NULL)))), ' ') AS sentinels FROM pages""")
def polarity_inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(t.sentinels(F.col("html")), " ").alias("sentinels"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(left(text, 60), '\\s+$', '') || '…' END AS excerpt FROM conversations")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", t.excerpt(F.col("text"), 60).alias("excerpt"))


@query("SELECT doc_id, sha256(text) AS content_hash, left(sha256('corpus:' || source || '/' || lang || '/doc_' || doc_id || '.txt:1'), 16) AS chunk_id FROM documents")
def digests(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), t.chunk_id(F.lit("corpus"), path, F.lit(1)).alias("chunk_id"))


D_BAG = o.bag("b", "documents", "doc_id", "text")
Q_BAG = o.bag("q", "benchmark", "item_id", "text")
BM25 = f"""{D_BAG}, {Q_BAG},
    tf AS (SELECT doc_id, term, count(*) AS tf FROM b GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    dl AS (SELECT d.doc_id, count(b.term) AS dl FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id), st AS (SELECT greatest(1, count(*)) AS n, greatest(1, avg(dl)) AS avgdl FROM dl),
    qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
    bm AS (SELECT item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / greatest(0.5, df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(1, dl) / avgdl))) AS score
           FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def scores(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """Of each item all documents that share a term, or the best ``most`` by scores of six digits."""
    asked = lexical.query_terms(table(spark, d, "benchmark"), ["item_id"], "text")
    return lexical.bm25(table(spark, d, "documents"), "doc_id", "text", asked, ["item_id"], most, None if most is None else 6)


@query(f"WITH {D_BAG} SELECT term, count(DISTINCT doc_id) AS df FROM b GROUP BY term")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(table(spark, d, "documents"), "doc_id", "text"))


@query(f"WITH {D_BAG} SELECT term, round(ln(1 + (n - df + 0.5) / greatest(0.5, df + 0.5)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM b GROUP BY term), (SELECT count(*) AS n FROM documents)")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return lexical.document_frequency(lexical.postings(docs, "doc_id", "text")).crossJoin(F.broadcast(n)).select("term", F.round(lexical.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query(f"WITH {BM25} SELECT item_id, doc_id, round(score, 5) AS score FROM bm")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).withColumn("score", F.round("score", 5))


@query(f"WITH {BM25} SELECT item_id, doc_id, round(score / max(score) OVER (PARTITION BY item_id), 5) AS score FROM bm")
def bm25_normalized(spark: SparkSession, d: str) -> DataFrame:
    return lexical.normalised(scores(spark, d), ["item_id"]).select("item_id", "doc_id", F.round("score", 5).alias("score"))


TOP = "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= {}"


@query(f"WITH {BM25} SELECT item_id, doc_id, rank FROM ({TOP.format(20)})")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_k(scores(spark, d, 20), ["item_id"], "doc_id", 20).select("item_id", "doc_id", F.col("rank").cast(LONG).alias("rank"))


PASSES = """ids AS (SELECT p_partkey, '' || p_name || ' ' || replace(p_type, ' ', '_') AS task FROM part)"""


def part_tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr("p_name || ' ' || replace(p_type, ' ', '_')").alias("task"))


@query(f"""WITH {PASSES}, {o.bag('b', 'ids', 'p_partkey', 'task')},
    u AS (SELECT p_partkey, string_agg(term, ' ' ORDER BY term) AS terms FROM (SELECT DISTINCT p_partkey, term FROM b WHERE {o.USABLE}) GROUP BY ALL),
    f AS (SELECT p_partkey, string_agg(w, ' ' ORDER BY w) AS terms FROM (SELECT DISTINCT p_partkey, lower(w) AS w FROM (SELECT p_partkey, unnest(regexp_extract_all(task, '[A-Za-z_][A-Za-z0-9_$]*')) AS w FROM ids) WHERE length(w) >= 4 AND regexp_matches(w, '_|.[A-Z]')) GROUP BY ALL)
    SELECT p_partkey, CAST(0 AS INTEGER) AS pass_id, array_to_string(list_sort(string_split(task, ' ')), ' ') AS words FROM ids
    UNION ALL SELECT p_partkey, 1, coalesce(terms, array_to_string(list_sort(string_split(task, ' ')), ' ')) FROM ids LEFT JOIN u USING (p_partkey)
    UNION ALL SELECT p_partkey, 2, coalesce(terms, array_to_string(list_sort(string_split(task, ' ')), ' ')) FROM ids LEFT JOIN f USING (p_partkey)""")
def expand_queries(spark: SparkSession, d: str) -> DataFrame:
    return lexical.expand(part_tasks(spark, d), "p_partkey", "task").select("p_partkey", "pass_id", F.array_join(F.array_sort(F.split("text", " ")), " ").alias("words"))


def _passes(mode: str) -> str:
    return f"""WITH tasks AS (SELECT item_id, text, 0 AS pass_id FROM benchmark), {D_BAG}, {Q_BAG},
    tf AS (SELECT doc_id, term, count(*) AS tf FROM b GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    dl AS (SELECT d.doc_id, count(b.term) AS dl FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id), st AS (SELECT greatest(1, count(*)) AS n, greatest(1, avg(dl)) AS avgdl FROM dl),
    u AS (SELECT item_id, string_agg(DISTINCT term, ' ') AS text FROM q WHERE {o.USABLE} GROUP BY item_id),
    {o.bag('r', 'u', 'item_id', 'text')},
    qt AS (SELECT item_id, 0 AS pass_id, term, count(*) AS times FROM q GROUP BY ALL UNION ALL SELECT item_id, 1, term, count(*) FROM r GROUP BY ALL UNION ALL SELECT item_id, 2, term, count(*) FROM q GROUP BY ALL),
    bm AS (SELECT item_id, pass_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / greatest(0.5, df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(1, dl) / avgdl))) AS score
           FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
    nm AS (SELECT item_id, pass_id, doc_id, score / max(score) OVER (PARTITION BY item_id, pass_id) AS score FROM bm)
    SELECT item_id, doc_id, round({mode}(score), 5) AS score FROM nm GROUP BY ALL"""


def fused(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Benchmark items hold no identifiers, so their third pass falls back to the item itself."""
    passes = lexical.expand(table(spark, d, "benchmark"), "item_id", "text")
    asked = lexical.query_terms(passes, ["item_id", "pass_id"], "text")
    each = lexical.normalised(lexical.bm25(table(spark, d, "documents"), "doc_id", "text", asked, ["item_id", "pass_id"]), ["item_id", "pass_id"])
    return lexical.fuse(each, ["item_id"], "doc_id", mode).withColumn("score", F.round("score", 5))


@query(_passes("max"))
def fuse_max(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, "max")


@query(_passes("sum"))
def fuse_sum(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, "sum")
