"""Queries over structural scores and claims.

A chunk is a document; its symbol is its first two words of four letters or more, joined by an underscore, and its path
ends in the symbol.  German documents lie under tests/.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import oracle as o
from ..functions import text as t
from ..operators import claims, lexical, structural
from .catalogue import query, table
from .text import BM25, TOP, scores

CHUNKS = """c AS (SELECT doc_id, symbol, CASE WHEN lang = 'de' THEN 'tests/' ELSE '' END || source || '/' || lang || '/' || symbol || '.txt' AS path
    FROM (SELECT *, array_to_string(regexp_extract_all(text, '[A-Za-z]{4,}')[1:2], '_') AS symbol FROM documents))"""
S_BAG = o.bag("sb", "c", "doc_id", "symbol")
Q_BAG = o.bag("q", "benchmark", "item_id", "text")
SYMS = f"{CHUNKS}, {S_BAG}, sa AS (SELECT DISTINCT doc_id, term FROM sb), st AS (SELECT * FROM sa WHERE {o.USABLE}), f AS (SELECT term, count(DISTINCT path) AS n_files FROM st JOIN c USING (doc_id) GROUP BY term), nf AS (SELECT count(DISTINCT path) AS n FROM st JOIN c USING (doc_id))"
ASKED = f"{Q_BAG}, qa AS (SELECT DISTINCT item_id, term FROM q), qu AS (SELECT * FROM qa WHERE {o.USABLE})"


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 2)
    docs = table(spark, d, "documents").withColumn("symbol", F.array_join(words, "_"))
    path = F.concat(F.when(F.col("lang") == "de", "tests/").otherwise(""), "source", F.lit("/"), "lang", F.lit("/"), "symbol", F.lit(".txt"))
    return docs.select("doc_id", "symbol", path.alias("path"))


def own_terms(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).select("doc_id", "path", F.explode(F.array_distinct(t.lex_terms(F.col("symbol")))).alias("term"))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where((F.length("term") >= t.TERM_LENGTH) & ~F.col("term").isin(t.GENERIC_TERMS))


def asked_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(t.lex_terms(F.col("text")))).alias("term"))


def frequencies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files of each term, and in one row the number of files that have a usable term."""
    own = usable(own_terms(spark, d))
    freq = own.select("path", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_files"))
    return freq, own.agg(F.count_distinct("path").alias("n"))


@query(f"WITH {SYMS} SELECT term, n_files FROM f")
def symbol_term_file_freq(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_rows(spark, d)
    return structural.term_files(rows, "path", structural.symbol_terms(F.array("symbol")))


@query(f"WITH {CHUNKS}, {o.bag('pb', 'c', 'path', o.BASENAME.format('path'))} SELECT term, count(DISTINCT path) AS n_files FROM pb GROUP BY term")
def path_term_file_freq(spark: SparkSession, d: str) -> DataFrame:
    return structural.term_files(chunk_rows(spark, d), "path", t.basename_terms(F.col("path")))


@query(f"WITH {SYMS} SELECT term, n_files, n_files <= greatest(3, 0.01 * n) AS specific FROM f, nf")
def specificity_gate(spark: SparkSession, d: str) -> DataFrame:
    freq, n = frequencies(spark, d)
    return freq.crossJoin(F.broadcast(n)).select("term", "n_files", structural.specific(F.col("n_files"), F.col("n")).alias("specific"))  # n is one row


EXPLICIT = ["src1/en", "src3", "_that.txt", "tests/src0/de/Erach_enieheiten.txt"]


@query(f"WITH {CHUNKS}, e AS (SELECT unnest(['{"', '".join(EXPLICIT)}']) AS p) SELECT doc_id, max(CASE WHEN path = p THEN 1.0 WHEN path LIKE '%' || replace(p, '_', chr(1) || '_') ESCAPE chr(1) OR list_contains(string_split(path, '/'), p) THEN 0.8 ELSE 0 END)::DOUBLE AS score FROM c, e GROUP BY doc_id")
def path_score(spark: SparkSession, d: str) -> DataFrame:
    explicit = F.array(*[F.lit(p) for p in EXPLICIT])
    return chunk_rows(spark, d).select("doc_id", structural.path_score(F.col("path"), explicit, F.array().cast("array<string>"), F.lit(False)).alias("score"))


SYMBOL_SCORES = f"""{SYMS}, {ASKED}, m AS (SELECT item_id, doc_id, count(*) AS shared, count(*) FILTER ({o.USABLE}) AS matched, count(*) FILTER ({o.USABLE} AND n_files <= greatest(3, 0.01 * n)) AS n_specific
        FROM sa JOIN qa USING (term) LEFT JOIN f USING (term), nf GROUP BY ALL),
    na AS (SELECT doc_id, count(*) AS n_own FROM sa GROUP BY doc_id), nq AS (SELECT item_id, count(*) AS n_task FROM qa GROUP BY item_id),
    sym AS (SELECT item_id, doc_id, matched / (n_own + n_task - shared) AS score, n_specific FROM m JOIN na USING (doc_id) JOIN nq USING (item_id) WHERE matched > 0)"""


def symbol_scores(spark: SparkSession, d: str) -> DataFrame:
    """item_id, doc_id, score, n_specific of the pairs that share a usable term; all others score 0."""
    own, asked = own_terms(spark, d), asked_terms(spark, d)
    freq, n = frequencies(spark, d)
    use = (F.length("term") >= t.TERM_LENGTH) & ~F.col("term").isin(t.GENERIC_TERMS)
    rare = use & structural.specific(F.col("n_files"), F.col("n"))
    hit = own.join(asked, "term").join(freq, "term", "left").crossJoin(F.broadcast(n))  # n is one row
    m = hit.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"), F.count(F.when(use, 1)).alias("matched"), F.count(F.when(rare & F.col("n_files").isNotNull(), 1)).alias("n_specific")).where("matched > 0")
    n_own = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_own"))
    n_task = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_task"))
    return m.join(n_own, "doc_id").join(n_task, "item_id").select("item_id", "doc_id", (F.col("matched") / (F.col("n_own") + F.col("n_task") - F.col("shared"))).alias("score"), "n_specific")


@query(f"WITH {SYMBOL_SCORES} SELECT item_id, doc_id, round(score, 6) AS score FROM sym")
def symbol_score(spark: SparkSession, d: str) -> DataFrame:
    return symbol_scores(spark, d).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS} SELECT doc_id, CASE WHEN path NOT LIKE 'tests/%' THEN 0.0 WHEN symbol LIKE 'test\\_%' ESCAPE '\\' THEN 0.5 ELSE 0.2 END::DOUBLE AS score FROM c")
def test_pair_score(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).select("doc_id", structural.test_pair_score(F.col("path"), F.col("symbol")).alias("score"))


test_pair_score.__test__ = False
INITIAL = f"""{BM25}, {SYMBOL_SCORES.replace('st AS (', 'stt AS (').replace('FROM st JOIN', 'FROM stt JOIN').replace(Q_BAG + ', ', '')},
    lx AS (SELECT item_id, doc_id, score / max(score) OVER (PARTITION BY item_id) AS lex FROM ({TOP.format(20)})),
    ini AS (SELECT item_id, doc_id, 0.35 * lex + 0.25 * coalesce(sym.score, 0) + 0.1 * CASE WHEN path LIKE 'tests/%' THEN 0.2 ELSE 0 END AS initial FROM lx JOIN c USING (doc_id) LEFT JOIN sym USING (item_id, doc_id))"""


def initial(spark: SparkSession, d: str) -> DataFrame:
    lex = lexical.top_k(scores(spark, d).withColumn("_s", F.col("score")).withColumn("score", F.round("score", 6)), ["item_id"], "doc_id", 20).withColumn("score", F.col("_s"))
    lex = lexical.normalised(lex, ["item_id"]).select("item_id", "doc_id", F.col("score").alias("lexical"))
    sym = symbol_scores(spark, d).select("item_id", "doc_id", F.col("score").alias("symbol_score"))
    both = lex.join(sym, ["item_id", "doc_id"], "left").join(chunk_rows(spark, d), "doc_id")
    score = structural.weighted(lexical=F.col("lexical"), symbol=F.coalesce("symbol_score", F.lit(0.0)), test=structural.test_pair_score(F.col("path"), F.lit(None).cast("string")))
    return both.select("item_id", "doc_id", structural.final(score).alias("score"))


@query(f"WITH {INITIAL} SELECT item_id, doc_id, round(initial, 5) AS score FROM ini")
def weighted_initial(spark: SparkSession, d: str) -> DataFrame:
    return initial(spark, d).withColumn("score", F.round("score", 5))


@query(f"WITH {INITIAL} SELECT item_id, doc_id, round(initial / max(initial) OVER (PARTITION BY item_id), 5) AS score FROM ini")
def final_score_norm(spark: SparkSession, d: str) -> DataFrame:
    return lexical.normalised(initial(spark, d), ["item_id"]).select("item_id", "doc_id", F.round("score", 5).alias("score"))


@query(f"WITH {CHUNKS} SELECT doc_id, CASE WHEN path LIKE 'tests/%' THEN 'test' WHEN symbol <> '' THEN 'implementation' ELSE 'supporting' END AS category FROM c")
def categorize(spark: SparkSession, d: str) -> DataFrame:
    symbol = F.when(F.col("symbol") != "", F.col("symbol"))
    return chunk_rows(spark, d).select("doc_id", structural.category(F.col("path"), symbol, F.array().cast("array<string>")).alias("category"))


@query(f"WITH {CHUNKS} SELECT doc_id, path FROM c WHERE path LIKE '%that.txt' OR path LIKE '%the.txt' OR path = 'src1/en/x.txt'")
def explicit_pins(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).where(claims.pinned(F.col("path"), ["that.txt", "the.txt", "src1/en/x.txt"])).select("doc_id", "path")


@query(f"WITH {CHUNKS} SELECT doc_id, path FROM c WHERE regexp_matches(path, '^src1.*on[^/]*\\.txt$') OR regexp_matches(string_split(path, '/')[-1], '^src1.*on.*\\.txt$|^Th...._.*\\.txt$') OR regexp_matches(path, '^Th...._.*\\.txt$') OR regexp_matches(path, '^src1.*on.*\\.txt$')")
def authority_pins(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).where(claims.authority(F.col("path"), ["src1*on*.txt", "./Th????_*.txt"])).select("doc_id", "path")


@query(f"WITH {SYMBOL_SCORES} SELECT item_id, doc_id, n_specific > 0 AS claimed FROM sym")
def named_symbol_claims(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose shared terms are all too common are kept as unclaimed, for the note of low specificity."""
    return symbol_scores(spark, d).select("item_id", "doc_id", (F.col("n_specific") > 0).alias("claimed"))


@query(f"""WITH {CHUNKS}, {o.bag('pb', 'c', 'path', o.BASENAME.format('path'))}, pt AS (SELECT DISTINCT path, term FROM pb), {ASKED}, pf AS (SELECT term, count(*) AS n_files FROM pt GROUP BY term), nf AS (SELECT count(DISTINCT path) AS n FROM pt)
    SELECT item_id, path, count(*) AS matched, CAST(sum((n_files <= greatest(3, 0.01 * n))::INT) AS BIGINT) AS n_specific FROM pt JOIN qu USING (term) JOIN pf USING (term), nf GROUP BY ALL""")
def named_path_claims(spark: SparkSession, d: str) -> DataFrame:
    own = chunk_rows(spark, d).select("path").distinct().select("path", F.explode(t.basename_terms(F.col("path"))).alias("term"))
    freq = own.groupBy("term").agg(F.count(F.lit(1)).alias("n_files"))
    n = own.agg(F.count_distinct("path").alias("n"))
    own = own.crossJoin(F.broadcast(n))  # n is one row
    hit = own.join(usable(asked_terms(spark, d)), "term").join(freq, "term")
    return hit.groupBy("item_id", "path").agg(F.count(F.lit(1)).alias("matched"), F.sum(structural.specific(F.col("n_files"), F.col("n")).cast("int")).alias("n_specific"))


@query(f"WITH {CHUNKS}, n AS (SELECT DISTINCT lower(unnest(string_split(symbol, '_'))) AS name FROM c WHERE path NOT LIKE 'tests/%'), p AS (SELECT DISTINCT path FROM c WHERE path LIKE 'tests/%') SELECT path, name FROM p JOIN n ON contains(lower(path), name) WHERE name <> ''")
def test_pair_theta(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_rows(spark, d)
    test = structural.is_test(F.col("path"))
    names = rows.where(~test).select(F.explode(F.split(F.lower("symbol"), "_")).alias("name")).where("name <> ''").distinct()
    return claims.contains_pairs(rows.where(test).select("path").distinct(), names)


test_pair_theta.__test__ = False
STATED = "i AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z]{4,}') || '_' || regexp_extract_all(text, '[A-Za-z]{4,}')[2] AS item FROM documents UNION SELECT DISTINCT regexp_extract(text, '[A-Za-z]{4,}') FROM benchmark)"


def forms(n: str) -> str:
    base = f"list_concat([lower({n}), regexp_replace(lower({n}), '[_\\-.$]', '', 'g')], {o.variants(f'lower({n})')})"
    return f"list_distinct(list_concat({base}, list_transform({base}, lambda z: regexp_replace(z, '[_\\-.$]', '', 'g'))))"


def stated(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    docs = table(spark, d, "documents").select(F.concat(F.regexp_extract("text", "[A-Za-z]{4,}", 0), F.lit("_"), F.get(words, F.lit(1))).alias("item"))
    return docs.unionAll(table(spark, d, "benchmark").select(F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("item"))).distinct()


SYMBOLS = "s AS (SELECT DISTINCT array_to_string(regexp_extract_all(html, '[a-z]{5,}')[20:20], '') AS symbol FROM pages UNION SELECT DISTINCT regexp_extract(text, '[A-Za-z]{4,}') FROM conversations)"


def page_symbols(spark: SparkSession, d: str) -> DataFrame:
    word = F.coalesce(F.get(F.regexp_extract_all("html", F.lit("[a-z]{5,}"), F.lit(0)), F.lit(19)), F.lit(""))
    return table(spark, d, "pages").select(word.alias("symbol")).unionAll(table(spark, d, "conversations").select(F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("symbol"))).distinct()


@query(f"WITH {STATED}, {SYMBOLS}, l AS (SELECT item, unnest({forms('item')}) AS form FROM i), r AS (SELECT symbol, unnest({forms('symbol')}) AS form FROM s), m AS (SELECT item, min(symbol) AS symbol FROM l JOIN r USING (form) GROUP BY item) SELECT i.item, m.symbol FROM i LEFT JOIN m ON i.item = m.item")
def stated_resolution(spark: SparkSession, d: str) -> DataFrame:
    return claims.resolve(stated(spark, d), page_symbols(spark, d))


@query(f"WITH {STATED}, {SYMBOLS}, l AS (SELECT DISTINCT item, lower(unnest({o.parts('item')})) AS part FROM i), r AS (SELECT DISTINCT symbol, lower(unnest({o.parts('symbol')})) AS part FROM s), m AS (SELECT item, symbol, count(*) AS shared FROM l JOIN r USING (part) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY shared DESC, symbol) AS INTEGER) AS rank FROM m QUALIFY rank <= 3")
def nearest_symbols_top3(spark: SparkSession, d: str) -> DataFrame:
    return claims.nearest(stated(spark, d), page_symbols(spark, d), lambda c: F.transform(t.split_identifier(c), F.lower))


@query(f"WITH {SYMS}, {ASKED} SELECT item_id, term, term IN (SELECT term FROM st) AS kept FROM qu")
def need_gate(spark: SparkSession, d: str) -> DataFrame:
    return claims.gate(usable(asked_terms(spark, d)), usable(own_terms(spark, d)))


@query(f"WITH {SYMS}, {ASKED} SELECT term, string_agg(DISTINCT origin, ' ' ORDER BY origin) AS origins FROM (SELECT term, 'stated_need' AS origin FROM qu UNION ALL SELECT term, 'stated_symbol' FROM st) GROUP BY term")
def stated_origins(spark: SparkSession, d: str) -> DataFrame:
    both = usable(asked_terms(spark, d)).select("term", F.lit("stated_need").alias("origin")).unionAll(usable(own_terms(spark, d)).select("term", F.lit("stated_symbol")))
    return both.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("origin")), " ").alias("origins"))
