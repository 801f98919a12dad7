"""The engine's surface: index files once, then select evidence for one request or many by the same plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import TEST_WORDS, ascii_words, basename_terms, chunk_id, lex_terms
from .operators import chunking, claims, index, lexical, packing, post, privacy, report, structural
from .sources import corpus
from .sources.store import cut

MOST_TOKENS, SCHEMA_VERSION = 30_000, "1"


class Engine:
    """``files`` has path, language and content; ``index`` cuts them, ``select`` packs evidence for requests."""

    def __init__(self, spark: SparkSession, repository: str = "corpus") -> None:
        self.spark, self.repository = spark, repository
        self.chunks: DataFrame | None = None
        self._hashes: DataFrame | None = None

    def index(self, files: DataFrame, target: int = 400, overlap: int = 40, strategy: str = "window") -> DataFrame:
        """Chunks with their enclosing symbol and the symbols of their file."""
        pieces = chunking.chunks(files, target, overlap, strategy)
        found = chunking.symbols(files)
        points = pieces.select("path", F.col("start_line").alias("line")).distinct()
        inside = index.enclosing(points, found, "path").withColumnRenamed("line", "start_line")
        names = index.rollup_names(found, "path", "name").withColumnRenamed("names", "file_symbols")
        out = pieces.join(inside, ["path", "start_line"], "left").join(names, "path", "left")
        rows = out.select(
            F.concat_ws(":", "path", "start_line").alias("key"), chunk_id(F.lit(self.repository), F.col("path"), F.col("start_line")).alias("chunk_id"),
            "path", "start_line", "end_line", "tokens", "symbol", F.coalesce("file_symbols", F.array().cast("array<string>")).alias("file_symbols"), "content", F.sha2("content", 256).alias("content_hash"),
        )
        self.chunks = cut(rows)
        self._hashes = cut(files.select("path", F.sha2("content", 256).alias("content_hash")))
        return self.chunks

    def index_folder(self, root: str, never_read: list[str] | None = None, **how: object) -> DataFrame:
        files = corpus.scan(self.spark, root, never_read).where(F.col("reason").isNull())
        return self.index(files.select(F.col("rel_path").alias("path"), "language", "content"), **how)

    def score(self, requests: DataFrame, fusion: str = "max", explicit: list[str] | None = None) -> DataFrame:
        """request_id, key, score: the weighted signals of each pass of a request, fused and over the best of the request.

        A pass scores the chunks that share a term with its text, whose names or paths do, and those at explicit paths."""
        chunks = self._indexed()
        by = ["request_id", "pass_id"]
        passes = cut(lexical.expand(requests, "request_id", "task"))
        asked = cut(lexical.query_terms(passes, by, "text"))
        terms = asked.select(*by, "term")
        names, paths = self._names(), self._path_terms()
        none = F.lit(0.0)
        lex = lexical.normalised(lexical.bm25(chunks, "key", "content", asked, by), by)
        sym, inner = claims.matched(names, terms, by), claims.inside(names, terms, by)
        own = paths.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        path = claims.matched(paths, terms, by).where("specific").join(own, "key").withColumn("share", F.size("terms") / F.col("n"))
        pins = self._pinned(explicit or [], boundary=True).join(passes.select(*by, F.explode(F.array(*[F.lit(p) for p in explicit])).alias("pin")), "pin") if explicit else None
        signals = [
            lex.select(*by, "key", F.col("score").alias("lexical"), none.alias("symbol"), none.alias("path")),
            sym.select(*by, "key", none.alias("lexical"), F.col("score").alias("symbol"), none.alias("path")),
            inner.join(sym.select(*by, "key"), [*by, "key"], "left_anti").select(*by, "key", none.alias("lexical"), F.lit(0.6).alias("symbol"), none.alias("path")),
            path.select(*by, "key", none.alias("lexical"), none.alias("symbol"), F.col("share").alias("path")),
        ]
        if pins is not None:
            signals.append(pins.select(*by, "key", none.alias("lexical"), none.alias("symbol"), "path"))
        every = reduce(DataFrame.unionByName, signals).groupBy(*by, "key").agg(*[F.max(c).alias(c) for c in ("lexical", "symbol", "path")])
        every = every.join(chunks.select("key", F.col("path").alias("file"), F.col("symbol").alias("named")), "key")
        score = structural.weighted(lexical=F.col("lexical"), symbol=F.col("symbol"), path=F.col("path"), test=structural.test_pair_score(F.col("file"), F.col("named")))
        return lexical.normalised(lexical.fuse(every.withColumn("score", score), ["request_id"], "key", fusion), ["request_id"])

    def _names(self) -> DataFrame:
        """key, path, name, term: the terms of a chunk's symbol, or else of each symbol of its file."""
        names = F.when(F.col("symbol").isNotNull(), F.array("symbol")).otherwise(F.col("file_symbols"))
        return self._indexed().select("key", "path", F.explode(names).alias("name")).select("key", "path", "name", F.explode(F.array_distinct(lex_terms(F.col("name")))).alias("term"))

    def _path_terms(self) -> DataFrame:
        """key, path, name, term: the terms of a chunk's file name."""
        return self._indexed().select("key", "path", F.col("path").alias("name"), F.explode(basename_terms(F.col("path"))).alias("term"))

    def _pinned(self, explicit: list[str], boundary: bool = False) -> DataFrame:
        """key, pin, path (its score) of the chunks that an explicit path names; with ``boundary`` also by a folder of that name."""
        held = F.array(*[F.lit(p) for p in explicit])
        path = F.col("path")
        near = lambda p: path.endswith(p) | (F.array_contains(F.split(path, "/"), p) if boundary else F.lit(False))
        found = self._indexed().select("key", "path", F.explode(F.filter(held, near)).alias("pin"))
        return found.select("key", "pin", F.when(path == F.col("pin"), 1.0).otherwise(0.8).alias("path"))

    def claims(self, requests: DataFrame, explicit: list[str] | None = None, authority: list[str] | None = None, stated: DataFrame | None = None) -> DataFrame:
        """request_id, key, reasons, symbol_terms, path_terms of every chunk that a request claims, before any cap.

        ``stated`` (request_id, term) adds terms of a stated need to those of the task."""
        chunks = self._indexed()
        terms = lexical.query_terms(requests, ["request_id"], "task").select("request_id", "term")
        if stated is not None:
            terms = terms.unionByName(stated.select("request_id", "term")).distinct()
        terms, ids, none = cut(terms), requests.select("request_id"), F.array().cast("array<string>")
        sym = claims.matched(self._names(), terms, ["request_id"])
        path = claims.matched(self._path_terms(), terms, ["request_id"])
        rows = [
            sym.select("request_id", "key", F.when(F.col("specific"), "named_symbol").otherwise("named_symbol_low_specificity").alias("reason"), F.col("terms").alias("symbol_terms"), none.alias("path_terms")),
            path.select("request_id", "key", F.when(F.col("specific"), "named_path").otherwise("named_path_low_specificity").alias("reason"), none.alias("symbol_terms"), F.col("terms").alias("path_terms")),
        ]
        plain = lambda df, reason: df.select("request_id", "key", F.lit(reason).alias("reason"), none.alias("symbol_terms"), none.alias("path_terms"))
        if explicit:
            rows.append(plain(self._pinned(explicit).join(ids.select("request_id", F.explode(F.array(*[F.lit(p) for p in explicit])).alias("pin")), "pin"), "explicit_path"))
        if authority:
            fired = chunks.where(claims.authority(F.col("path"), authority)).select("key", F.lit(0).alias("on"))
            rows.append(plain(fired.join(ids.withColumn("on", F.lit(0)), "on"), "authority"))
        found = cut(reduce(DataFrame.unionByName, rows))
        low = F.col("reason").endswith("_low_specificity")
        sources = found.where(~low).select("request_id", "key").distinct().join(chunks.select("key", "path"), "key").where(~structural.is_test(F.col("path")))
        found = found.unionByName(plain(claims.test_pairs(sources, chunks.select("key", "path"), "request_id"), "test_pair"))
        lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("symbol_terms", "path_terms")]
        return found.groupBy("request_id", "key").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), *lists)  # a chunk's reasons

    def wants_tests(self, requests: DataFrame) -> DataFrame:
        """request_id, wants_tests: whether a task has a word for tests or names the stem of a test file."""
        words = requests.select("request_id", F.explode(ascii_words(F.col("task"))).alias("word"))
        stems = self._indexed().where(structural.is_test(F.col("path"))).select(F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")).alias("word")).distinct()
        known = stems.unionByName(self.spark.createDataFrame([(w,) for w in TEST_WORDS], "word string")).distinct()
        asks = words.join(known, "word", "left_semi").select("request_id", F.lit(True).alias("asks")).distinct()
        return requests.select("request_id").distinct().join(asks, "request_id", "left").select("request_id", F.coalesce("asks", F.lit(False)).alias("wants_tests"))

    def candidates(self, requests: DataFrame, explicit: list[str] | None = None, authority: list[str] | None = None, required: list[str] | None = None, stated: DataFrame | None = None) -> DataFrame:
        """The rows that ``packing.pack`` packs: all scored and claimed chunks that some pass can admit."""
        chunks = self._indexed()
        found = cut(self.claims(requests, explicit, authority, stated))
        scored = cut(self.score(requests, explicit=explicit).select("request_id", "key", "score"))
        rows = scored.join(found, ["request_id", "key"], "full_outer").withColumn("score", F.coalesce("score", F.lit(0.0)))
        rows = rows.join(chunks.select("key", "path", "tokens", "symbol", "file_symbols"), "key")
        has = lambda r: F.coalesce(F.array_contains("reasons", r), F.lit(False))
        strong, named = has("named_symbol") | has("test_pair"), has("named_path")
        rows = rows.withColumns({"pinned": has("explicit_path") | has("authority"), "strong": strong, "named_path": named, "mandatory": strong | named})
        capped = packing.per_file_cap(rows.where("mandatory AND NOT pinned").select("request_id", "key", "path", "score"), "request_id", "path", "key").where("demoted").select("request_id", "key", "demoted")
        rows = rows.join(capped, ["request_id", "key"], "left").withColumn("claim", F.col("mandatory") & ~F.col("pinned") & F.col("demoted").isNull())
        terms = lexical.query_terms(requests, ["request_id"], "task").select("request_id", "term")
        terms = cut(terms if stated is None else terms.unionByName(stated.select("request_id", "term")).distinct())
        post_ = lexical.postings(chunks, "key", "content").join(F.broadcast(terms.select("term").distinct()) if terms.count() <= lexical.ASKED else terms.select("term").distinct(), "term", "left_semi")
        n = chunks.agg(F.count(F.lit(1)).cast("double").alias("n"))
        weights = lexical.document_frequency(post_).crossJoin(F.broadcast(n)).select("term", lexical.idf(F.col("df"), F.col("n")).alias("idf"))  # n is one row
        hit = rows.where("claim").select("request_id", "key", F.explode(F.array_union("symbol_terms", "path_terms")).alias("term"))
        relevance = report.claim_relevance(hit, weights, "request_id", "key")
        path_words = rows.where("claim").select("request_id", "key", F.explode(F.array_distinct(lex_terms(F.col("path")))).alias("term"))
        on = path_words.join(terms, ["request_id", "term"], "left_semi").select("request_id", "key", F.lit(True).alias("on_path")).distinct()
        rows = rows.join(relevance, ["request_id", "key"], "left").join(on, ["request_id", "key"], "left").join(self.wants_tests(requests), "request_id")
        on_path = F.coalesce("on_path", F.lit(False))
        rows = rows.withColumns({
            "relevance": F.coalesce("relevance", F.lit(0.0)), "on_path": on_path, "overlap": report.overlap_class(F.col("strong"), on_path, has("test_pair"), F.col("named_path")),
            "is_test": structural.is_test(F.col("path")), "category": structural.category(F.col("path"), F.col("symbol"), F.col("file_symbols")), "required": F.col("path").isin(required or []),
        })
        sets = lexical.term_ids(chunks, "key", "content")
        return packing.shortlist(rows.drop("symbol", "file_symbols", "mandatory", "demoted"), "request_id").join(sets, "key")

    def select(self, requests: DataFrame, token_budget: int = 12_000, explicit: list[str] | None = None, exclude: list[str] | None = None, authority: list[str] | None = None, required: list[str] | None = None, stated: DataFrame | None = None) -> DataFrame:
        """Packed evidence in order: request_id, position, pass, path, lines, symbol, score, reasons, category, strategy, content."""
        chunks = self._indexed()
        rows = cut(self.candidates(requests, explicit, authority, required, stated))
        packed = packing.pack(rows, "request_id", min(token_budget, MOST_TOKENS))
        out = packed.join(rows.select("request_id", "key", "score", "reasons", "category"), ["request_id", "key"]).join(chunks, "key").where(post.excluded_by(F.col("path"), exclude or []).isNull())
        kind = post.content_type(F.col("path"), F.col("content"))
        why = F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array(F.col("pass"))))
        out = out.select("request_id", "position", "pass", "key", "path", "start_line", "end_line", "symbol", F.round("score", 4).alias("score"), why.alias("reasons"), "category", post.strategy(kind, F.col("pass") == "pin").alias("strategy"), "tokens", "content_hash", "content")
        out = cut(out)
        clean = privacy.redact_requests(out, "request_id", "key", "position", "content")
        out = out.drop("content").join(clean.withColumnRenamed("redacted", "content"), ["request_id", "key"])
        return cut(privacy.cleared(out, "request_id", "content"))

    def stated_summary(self, evidence: DataFrame, stated: DataFrame) -> DataFrame:
        """request_id, origin, chunks: claims in the pack that cite terms of each stated origin (request_id, term, origin)."""
        cited = evidence.where(F.col("pass") == "claim").select("request_id", "key", "path", "symbol")
        words = cited.select("request_id", "key", F.explode(F.array_distinct(F.concat(basename_terms(F.col("path")), lex_terms(F.col("symbol"))))).alias("term"))
        return claims.stated_summary(words, stated, "request_id", "key")

    def full_context(self) -> DataFrame:
        """Everything in order of path and line, with the tokens up to each chunk: the baseline without selection."""
        return index.in_order(self._indexed().select("key", "path", "start_line", "tokens"), ["path", "start_line"], "tokens")

    def refresh(self, files: DataFrame, pins: list[str] | None = None, **how: object) -> dict[str, int]:
        """Brings the index up to ``files`` (all of them, or those at ``pins``) and counts what was new, changed, stale and
        unchanged; only new and changed files are cut again."""
        now = files.withColumn("content_hash", F.sha2("content", 256))
        old = self.hashes()
        if pins:
            now, old = now.where(claims.pinned(F.col("path"), pins)), old.where(claims.pinned(F.col("path"), pins))
        seen = cut(index.incremental_diff(now, old))
        counts = {"new": 0, "changed": 0, "stale": 0, "unchanged": 0} | {r["status"]: r["n"] for r in seen.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        todo = seen.where(F.col("status").isin("new", "changed")).select("path")
        if counts["new"] + counts["changed"] + counts["stale"]:
            kept, hashes = self.chunks, self._hashes
            gone = seen.where(F.col("status") != "unchanged")
            self.index(files.join(todo, "path", "left_semi"), **how)
            if kept is not None:
                self.chunks = cut(index.forget(kept, gone).unionByName(self.chunks))
                self._hashes = cut(index.forget(hashes, gone).unionByName(self._hashes))
        return counts

    def hashes(self) -> DataFrame:
        """path and content_hash of every indexed file."""
        return self.spark.createDataFrame([], "path string, content_hash string") if self._hashes is None else self._hashes

    def save(self, folder: str) -> None:
        """Writes chunks, hashes and the index's own settings as Parquet."""
        for name, df in (("chunks", self._indexed()), ("hashes", self.hashes()), ("meta", index.meta(self.spark, {"repository": self.repository, "schema_version": SCHEMA_VERSION}))):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")

    def load(self, folder: str) -> DataFrame:
        """Reads what ``save`` wrote; an index of another schema version raises ValueError."""
        meta = {r["key"]: r["value"] for r in self.spark.read.parquet(f"{folder}/meta").collect()}
        if meta.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"index of schema version {meta.get('schema_version')}, not {SCHEMA_VERSION}")
        self.repository = meta["repository"]
        self._hashes = self.spark.read.parquet(f"{folder}/hashes")
        self.chunks = self.spark.read.parquet(f"{folder}/chunks")
        return self.chunks

    def markdown(self, evidence: DataFrame) -> DataFrame:
        return post.markdown(evidence.withColumn("section", F.when(F.col("pass") == "pin", "explicit").otherwise(F.col("category"))), "request_id")

    def accounting(self, requests: DataFrame, evidence: DataFrame) -> DataFrame:
        """Tokens packed a request, and what share of the corpus that leaves out."""
        total = self._indexed().agg(F.sum("tokens").alias("candidate_tokens"))
        own = evidence.groupBy("request_id").agg(F.sum("tokens").alias("selected_tokens"), F.sum(F.when(F.col("pass").isin("pin", "claim"), F.col("tokens")).otherwise(0)).alias("required_tokens"))
        both = requests.select("request_id").join(own, "request_id", "left").na.fill(0).crossJoin(F.broadcast(total))  # total is one row
        return both.withColumn("reduction_pct", F.round(100.0 * (F.col("candidate_tokens") - F.col("selected_tokens")) / F.col("candidate_tokens"), 2))

    def _indexed(self) -> DataFrame:
        if self.chunks is None:
            raise ValueError("index files first")
        return self.chunks
