"""Queries over sources and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import oracle as o
from ..functions import text as t
from ..operators import chunking, index
from ..sources import corpus
from .catalogue import query, table

FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text, n_chars, source, lang, strlen(text) AS size_bytes FROM documents)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents_as_files(table(spark, d, "documents"))


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1[^/]*/[^/]*/doc_[^/]*5\\.txt$|^(.*/)?fr/[^/]*$|^src2/.*$')")
def glob_policy_filter(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(corpus.matches_any(F.col("path"), ["src1*/*/doc_*5.txt", "**/fr/*", "src2/**"])).select("path")


@query("SELECT 'text' AS language, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL UNION ALL SELECT 'unknown', count(*), CAST(sum(strlen(html)) AS BIGINT) FROM pages")
def language_census(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("pages/"), "page_id", F.lit(".html"))
    own = table(spark, d, "pages").select(corpus.language(page).alias("language"), F.octet_length("html").cast("long").alias("size_bytes"))
    return files(spark, d).select("language", "size_bytes").unionAll(own).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query(f"""WITH {FILES} SELECT CASE WHEN regexp_matches(path, '^(.*/)?de/[^/]*$') THEN 'policy_deny' WHEN size_bytes > 4000 THEN 'too_large' ELSE 'kept' END AS reason, count(*) AS files FROM files GROUP BY ALL""")
def skip_census(spark: SparkSession, d: str) -> DataFrame:
    reason = corpus.skip_reason(F.col("path"), F.col("size_bytes"), F.col("content"), ["**/de/*"], 4000)
    return files(spark, d).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


@query(f"SELECT source, count(*) AS files, CAST(sum({o.tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY source")
def repository_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(t.token_count(F.col("text"))).alias("tokens"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.task'), props) AS task FROM events WHERE trim(props) <> ''")
def task_line_fallback(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").where(F.trim("props") != "")
    return ev.select("event_id", F.coalesce(F.get_json_object("props", "$.task"), "props").alias("task"))


STORED = """stored AS (SELECT path, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(text || '!') END AS h FROM files JOIN labels USING (doc_id) UNION ALL SELECT url, sha256(html) FROM pages)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as scanned; stored are the labelled ones, the low-quality ones of other content, and all pages."""
    now = files(spark, d)
    old = now.join(table(spark, d, "labels"), "doc_id").select("path", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.sha2(F.concat("content", F.lit("!")), 256)).alias("content_hash"))
    return now, old.unionAll(table(spark, d, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("content_hash")))


@query(f"""WITH {FILES}, {STORED} SELECT coalesce(f.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'stale' WHEN h = sha256(text) THEN 'unchanged' ELSE 'changed' END AS status FROM files f FULL JOIN stored s ON f.path = s.path""")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return index.incremental_diff(*snapshots(spark, d))


@query(f"""WITH {FILES}, {STORED} SELECT path, h AS content_hash FROM stored WHERE path NOT IN (SELECT path FROM files) UNION ALL SELECT path, sha256(text) FROM files""")
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    now, old = snapshots(spark, d)
    return index.replace_paths(old, now.select("path", "content_hash"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def replace_latest_symbol(spark: SparkSession, d: str) -> DataFrame:
    return index.latest(table(spark, d, "events"), ["user_id", "event_type"], F.col("event_id"), ["event_id", "value"])


@query("SELECT source, string_agg(DISTINCT regexp_extract(text, '[A-Za-z]+'), ' ' ORDER BY regexp_extract(text, '[A-Za-z]+')) AS names FROM documents GROUP BY source")
def file_symbols_rollup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select("source", F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"))
    return index.rollup_names(names, "source", "name").select("source", F.array_join("names", " ").alias("names"))


LINE_TABLE = f"l AS (SELECT doc_id, unnest(ls) AS line_text, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, {o.lines('text')} AS ls FROM documents))"


@query(f"""WITH {LINE_TABLE}, s AS (SELECT doc_id, regexp_extract(line_text, '[A-Za-z]+') AS name, line AS start, line + length(line_text) % 7 AS e FROM l WHERE length(line_text) > 20)
    SELECT p.doc_id, CAST(p.line AS INTEGER) AS line, max_by(name, start) AS symbol FROM l p LEFT JOIN s ON p.doc_id = s.doc_id AND p.line BETWEEN start AND e GROUP BY ALL""")
def enclosing_symbol_range_join(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "documents").select("doc_id", F.posexplode(t.lines(F.col("text"))).alias("i", "line_text")).withColumn("line", F.col("i") + 1)
    spans = at.where(F.length("line_text") > 20).select("doc_id", F.regexp_extract("line_text", "[A-Za-z]+", 0).alias("name"), F.col("line").alias("start"), (F.col("line") + F.length("line_text") % 7).alias("end"), F.col("line").alias("ord"))
    return index.enclosing(at.select("doc_id", "line"), spans, "doc_id").select("doc_id", "line", "symbol")


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber AS "start", l_linenumber + CAST(floor(l_quantity / 12) AS BIGINT) AS "end" FROM lineitem)
    SELECT l_orderkey, "start", "end" FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.l_orderkey = b.l_orderkey AND b."start" <= a."start" AND a."end" <= b."end" AND (a."start" <> b."start" OR a."end" <> b."end"))""")
def top_level_spans_anti(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 12)).alias("end"))
    return index.top_level(spans, "l_orderkey")


@query()
def chunks_window(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(files(spark, d)).select("path", "start_line", "end_line", "tokens", F.sha2("content", 256).alias("content_hash"))
