"""Queries over claims with reasons, stated needs, coverage, labels, scopes and batch totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import oracle as o
from ..functions import text as t
from ..operators import claims, evaluate, index, lexical, packing, post, report
from ..sources import corpus
from ..sources.store import cut
from .catalogue import QUERIES, query, table
from .evidence import BUDGET, CAND, PATH, REL, folded, packed, paths, relevant, scored
from .ranking import ASKED, CHUNKS, STATED, SYMBOL_SCORES, SYMBOLS, SYMS, asked_terms, chunk_rows, forms, own_terms, stated, stated_origins, symbol_scores, usable

PATH_CLAIMS = f"""{o.bag('pb', 'c', 'path', o.BASENAME.format('path'))}, pt AS (SELECT DISTINCT path, term FROM pb), pf AS (SELECT term, count(*) AS n_files FROM pt GROUP BY term), pn AS (SELECT count(DISTINCT path) AS n FROM pt),
    np AS (SELECT item_id, path, sum((n_files <= greatest(3, 0.01 * n))::INT) AS n_specific FROM pt JOIN qu USING (term) JOIN pf USING (term), pn GROUP BY ALL)"""
REASONS = f"""WITH {SYMBOL_SCORES}, {PATH_CLAIMS}, rs AS (SELECT item_id, doc_id, CASE WHEN n_specific > 0 THEN 'named_symbol' ELSE 'named_symbol_low_specificity' END AS reason FROM sym
    UNION ALL SELECT item_id, doc_id, CASE WHEN n_specific > 0 THEN 'named_path' ELSE 'named_path_low_specificity' END FROM np JOIN c USING (path)
    UNION ALL SELECT item_id, doc_id, 'explicit_path' FROM c, benchmark WHERE path LIKE '%that.txt'), cl AS (SELECT item_id, doc_id, string_agg(DISTINCT reason, ' ' ORDER BY reason) AS reasons FROM rs GROUP BY ALL)"""


def claimed(spark: SparkSession, d: str) -> DataFrame:
    """item_id, doc_id, reasons: every claim of an item on a document, pins of one explicit path included."""
    kind = lambda name: F.when(F.col("n_specific") > 0, name).otherwise(name + "_low_specificity").alias("reason")
    chunks = chunk_rows(spark, d)
    sym = symbol_scores(spark, d).select("item_id", "doc_id", kind("named_symbol"))
    path = QUERIES["named_path_claims"](spark, d).join(chunks.select("path", "doc_id"), "path").select("item_id", "doc_id", kind("named_path"))
    on = F.lit("that.txt").alias("pin")
    pins = chunks.where(claims.pinned(F.col("path"), ["that.txt"])).select("doc_id", on)
    pins = pins.join(table(spark, d, "benchmark").select("item_id", on), "pin").select("item_id", "doc_id", F.lit("explicit_path").alias("reason"))
    return claims.with_reasons(sym.unionByName(path).unionByName(pins), ["item_id", "doc_id"])


@query(f"{REASONS} SELECT item_id, doc_id, reasons FROM cl")
def claim_reasons(spark: SparkSession, d: str) -> DataFrame:
    return claimed(spark, d).withColumn("reasons", F.array_join("reasons", " "))


@query(f"{REASONS} SELECT DISTINCT item_id, doc_id FROM rs WHERE NOT contains(reason, '_low_')")
def claim_candidates(spark: SparkSession, d: str) -> DataFrame:
    return claims.candidates(claimed(spark, d), ["item_id", "doc_id"])


RESOLVED = f"{STATED}, {SYMBOLS}, l AS (SELECT item, unnest({forms('item')}) AS form FROM i), r AS (SELECT symbol, unnest({forms('symbol')}) AS form FROM s), m AS (SELECT item, min(symbol) AS symbol FROM l JOIN r USING (form) GROUP BY item), rv AS (SELECT i.item, m.symbol FROM i LEFT JOIN m ON i.item = m.item)"


@query(f"WITH {RESOLVED} SELECT count(*) AS total, count(symbol) AS resolved, count(*) - count(symbol) AS unresolved, CASE WHEN count(*) > count(symbol) THEN (count(*) - count(symbol)) || ' stated items are not in the index' ELSE '' END AS note FROM rv")
def resolution_block(spark: SparkSession, d: str) -> DataFrame:
    return claims.resolution(QUERIES["stated_resolution"](spark, d))


@query(f"WITH {RESOLVED}, {o.bag('rb', 'rv', 'item', 'CASE WHEN symbol IS NOT NULL THEN item END')}, {SYMS}, {ASKED} SELECT term FROM qu WHERE term IN (SELECT term FROM st) UNION SELECT term FROM rb WHERE {o.USABLE}")
def stated_claim_terms(spark: SparkSession, d: str) -> DataFrame:
    kept = claims.gate(usable(asked_terms(spark, d)), usable(own_terms(spark, d)))
    return claims.stated_terms(kept, QUERIES["stated_resolution"](spark, d))


@query(f"""WITH {SYMS}, {ASKED}, og AS (SELECT item_id, term, origin FROM qu, (SELECT unnest(['stated_need', 'stated_symbol']) AS origin) WHERE origin = 'stated_need' OR term IN (SELECT term FROM st))
    SELECT item_id, origin, count(DISTINCT doc_id) AS chunks FROM og JOIN sa USING (term) GROUP BY ALL""")
def stated_claim_summary(spark: SparkSession, d: str) -> DataFrame:
    """Asked terms are stated needs, and stated symbols where a symbol has them; a document cites the terms of its symbol."""
    asked = usable(asked_terms(spark, d))
    origins = asked.join(stated_origins(spark, d), "term").select("item_id", "term", F.explode(F.split("origins", " ")).alias("origin"))
    cited = own_terms(spark, d).select("doc_id", "term").join(asked, "term")
    return claims.stated_summary(cited, origins, "item_id", "doc_id")


ADM = f"adm AS (SELECT item_id, doc_id FROM ({folded('0 AS n', f'r.used + c.tokens <= {BUDGET}', '0')}))"


@query(f"""WITH {CAND}, {REL}, {ADM}, pk AS (SELECT item_id, {PATH} AS path, tokens FROM adm JOIN cand USING (item_id, doc_id) JOIN documents USING (doc_id)), us AS (SELECT item_id, sum(tokens) AS used FROM pk GROUP BY item_id),
    rq AS (SELECT item_id, {PATH} AS path, true AS known FROM rel JOIN documents USING (doc_id) UNION SELECT item_id, 'gone.txt', false FROM benchmark)
    SELECT item_id, path, CASE WHEN NOT known THEN 'not_indexed' WHEN coalesce(used, 0) >= {BUDGET} THEN 'budget' ELSE 'dropped' END AS why FROM rq ANTI JOIN pk USING (item_id, path) LEFT JOIN us USING (item_id)""")
def required_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every document that holds an item's first words is required, and one path that no index has."""
    own = paths(spark, d).select("doc_id", "path")
    got = packed(scored(spark, d)).select("item_id", "doc_id", "tokens")
    got = got.join(lexical.chosen(own, "doc_id", got), "doc_id")
    met = cut(relevant(spark, d))
    required = met.join(lexical.chosen(own, "doc_id", met), "doc_id").select("item_id", "path").unionByName(table(spark, d, "benchmark").select("item_id", F.lit("gone.txt").alias("path")))
    return packing.coverage(required, own, got, "item_id", BUDGET)


@query(f"SELECT path, tokens, row_number() OVER (ORDER BY path) AS position, CAST(sum(tokens) OVER (ORDER BY path) AS BIGINT) AS upto FROM (SELECT {PATH} AS path, CAST({o.tokens('text')} AS BIGINT) AS tokens FROM documents)")
def full_context(spark: SparkSession, d: str) -> DataFrame:
    rows = paths(spark, d).select("path", t.token_count(F.col("text")).alias("tokens"))
    return index.in_order(rows, ["path"], "tokens")


@query(f"SELECT path FROM (SELECT {PATH} AS path FROM documents) WHERE path LIKE 'src1/en/%' OR path LIKE 'src3%'")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).where(index.in_scope(F.col("path"), ["src1/en/", "src3"])).select("path")


@query(f"SELECT path, path LIKE 'src1/%' AS is_within FROM (SELECT {PATH} AS path FROM documents)")
def is_within(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("path", index.within(F.col("path"), "src1/").alias("is_within"))


@query(f"SELECT path, NOT path LIKE 'src1/%' OR regexp_matches(path, '^src1/en/[^/]*7\\.txt$') AS allowed FROM (SELECT {PATH} AS path FROM documents)")
def path_policy(spark: SparkSession, d: str) -> DataFrame:
    policy = corpus.PathPolicy(["src1/**"], ["src1/en/*7.txt"])
    return paths(spark, d).select("path", policy.allowed(F.col("path")).alias("allowed"))


SQUEEZED = "trim(regexp_replace(html, '<[^>]*>', ' ', 'g'))"


@query(f"SELECT page_id, {o.tokens(SQUEEZED)} < {o.tokens('html')} AS compacted, CAST(least({o.tokens(SQUEEZED)}, {o.tokens('html')}) AS BIGINT) AS tokens FROM pages")
def compact_evidence(spark: SparkSession, d: str) -> DataFrame:
    bare = F.trim(F.regexp_replace("html", "<[^>]*>", " "))
    got = post.compact_evidence(F.col("html"), bare)
    return table(spark, d, "pages").select("page_id", got["compacted"].alias("compacted"), got["tokens"].alias("tokens"))


SPANS = "ck AS (SELECT doc_id AS key, source AS path, doc_id % 50 AS s, doc_id % 50 + 20 AS e, CASE WHEN doc_id % 3 = 0 THEN lang END AS symbol FROM documents)"
LABELS = "lb AS (SELECT d.doc_id % 20 AS task, CASE WHEN quality = 1 THEN 'required' WHEN toxic = 1 THEN 'irrelevant' ELSE 'helpful' END AS kind, source AS path, CASE WHEN d.doc_id % 2 = 0 THEN lang END AS symbol, CASE WHEN d.doc_id % 5 > 0 THEN d.doc_id % 40 END AS a FROM labels l JOIN documents d USING (doc_id))"


@query(f"""WITH {SPANS}, {LABELS} SELECT task, key, CAST(min(CASE WHEN kind = 'irrelevant' THEN 0 ELSE 1 END) AS INTEGER) AS relevant FROM ck JOIN lb USING (path)
    WHERE (a IS NULL OR (s <= a AND e >= a + 8)) AND (lb.symbol IS NULL OR ck.symbol IS NULL OR lb.symbol = ck.symbol) GROUP BY ALL""")
def relevance_labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of lines of their sources, labelled rows as labels of 20 tasks."""
    docs = table(spark, d, "documents")
    first = F.col("doc_id") % 50
    chunks = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("path"), first.alias("start_line"), (first + 20).alias("end_line"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("symbol"))
    a = F.col("doc_id") % 40
    kind = F.when(F.col("quality") == 1, "required").when(F.col("toxic") == 1, "irrelevant").otherwise("helpful")
    labels = table(spark, d, "labels").join(docs, "doc_id").select((F.col("doc_id") % 20).alias("task"), kind.alias("kind"), F.col("source").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("symbol"), F.when(F.col("doc_id") % 5 > 0, F.array(a, a + 8)).alias("lines"))
    return evaluate.relevance_labels(chunks, labels, "task")


@query("""WITH r AS (SELECT n_chars AS c, least(n_chars, 500) AS s, CASE WHEN n_chars > 0 THEN 100.0::DOUBLE * (n_chars - least(n_chars, 500)) / n_chars ELSE 0 END AS p FROM documents)
    SELECT count(*) AS tasks, CAST(sum(c) AS BIGINT) AS candidate_tokens, CAST(sum(s) AS BIGINT) AS selected_tokens, round(list_sort(list(p))[len(list(p)) // 2 + 1], 6) AS median_reduction_pct FROM r""")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "documents").select(F.col("n_chars").alias("candidate_tokens"), F.least("n_chars", F.lit(500)).alias("selected_tokens"))
    return evaluate.batch_totals(runs).withColumn("median_reduction_pct", F.round("median_reduction_pct", 6))


@query(f"SELECT path, content_hash FROM (SELECT {PATH} AS path, sha256(text) AS content_hash FROM documents)")
def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents_as_files(table(spark, d, "documents")).select("path", "content_hash")


@query(f"SELECT conv_id, CAST(sum({o.tokens('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def message_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the messages of a conversation, which is one request."""
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("messages"))
    return said.select("conv_id", report.message_tokens(F.col("messages")).alias("tokens"))


@query("""SELECT item_id, doc_id, CASE WHEN s AND p THEN 0 WHEN t OR (n AND p) THEN 1 WHEN s THEN 2 ELSE 3 END AS class
    FROM (SELECT doc_id % 7 AS item_id, doc_id, doc_id % 2 = 0 AS s, doc_id % 3 = 0 AS p, doc_id % 5 = 0 AS t, doc_id % 11 = 0 AS n FROM documents)""")
def overlap_class(spark: SparkSession, d: str) -> DataFrame:
    of = lambda n: F.col("doc_id") % n == 0
    return table(spark, d, "documents").select((F.col("doc_id") % 7).alias("item_id"), "doc_id", report.overlap_class(of(2), of(3), of(5), of(11)).alias("class"))
