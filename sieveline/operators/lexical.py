"""BM25 over postings.

Texts are split once, in Arrow batches whose distinct words are folded once.  The postings of the terms that a batch of
requests asks for are stored, a row a document; frequencies are counted from them, and documents meet requests as blocks of a
product of two sparse matrices, so that a term of most documents costs one outer product and no join; what a later step can't
use is left out block by block (``shortlists``).  The requests' terms are broadcast up to ``ASKED`` of them; beyond that
postings and requests are joined by term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import pieces, tidy
from ..functions.text import WORDS_OF, fold_word, full_identifiers, lex_terms, usable_terms, word_terms, words
from ..sources.store import cut
from . import shortlists

K1, B = 1.2, 0.75
#: Term entries of the requests of a batch that are broadcast, scores in a block, and words whose folds a worker remembers.
ASKED, BLOCK, KNOWN = 500_000, 1 << 18, 1 << 16


def terms(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, term, one row an occurrence, for short texts: words are exploded first, so that their folds compile to straight code."""
    words_of = docs.select(*key, F.explode(words(F.col(text))).alias("word"))
    return words_of.select(*key, F.explode(word_terms(F.col("word"))).alias("term"))


class Folds(dict):
    """The terms of each word met so far."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= KNOWN:
            self.clear()
        out = self[word] = fold_word(word)
        return out


def bag(text: str | None, folds: Folds) -> Counter:
    """Terms of a text and how often each occurs."""
    out: Counter = Counter()
    for word, n in Counter(WORDS_OF.findall(text or "")).items():
        for term in folds[word]:
            out[term] += n
    return out


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf of every row, in one narrow pass; rows that repeat a key stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = Folds()
        for part in pieces(batches):
            bags = [bag(x, folds) for x in part.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
            yield pa.record_batch([part.column(0).take(pa.array(rows)), pa.array([t for x in bags for t in x], pa.string()), pa.array([n for x in bags for n in x.values()], pa.int64())], names=[key, "term", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(tidy(run), f"`{key}` {kind}, term string, tf long")


def term_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, terms: the distinct terms of every row, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = Folds()
        for part in pieces(batches):
            sets = [sorted({t for w in set(WORDS_OF.findall(x or "")) for t in folds[w]}) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.string()))], names=[key, "terms"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(tidy(run), f"`{key}` {kind}, terms array<string>")


def term_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, terms: the distinct terms of every row as 64-bit numbers, for comparing sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for part in pieces(batches):
            sets = []
            for x in part.column(1).to_pylist():
                own: set[int] = set()
                for w in set(WORDS_OF.findall(x or "")):
                    if w not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[w] = [int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in fold_word(w)]
                    own.update(known[w])
                sets.append(sorted(own))
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=[key, "terms"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(tidy(run), f"`{key}` {kind}, terms array<long>")


def chosen(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The documents among ``keys``, which are few against them: their texts stay where they are while the keys are."""
    keys = cut(keys.select(key).distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= ASKED else keys, key, "left_semi")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(lex_terms(F.col(text))).cast("long").alias("dl"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / F.greatest(F.lit(0.5), df + 0.5))


def stats(dl: DataFrame) -> DataFrame:
    """One row: number of documents and mean length, at least 1."""
    return dl.agg(F.greatest(F.lit(1), F.count(F.lit(1))).cast("double").alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("dl"), F.lit(1.0))).alias("avgdl"))


def _asked_postings(docs: DataFrame, key: str, text: str, place: dict[str, int], carry: list[str]) -> DataFrame:
    """key, dl and the postings (terms, tf) of the asked terms, and what is carried along, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, known = Folds(), shared.value
        for part in pieces(batches):
            dl, at, tf = [], [], []
            for x in part.column(1).to_pylist():
                own = bag(x, folds)
                hit = sorted((known[t], n) for t, n in own.items() if t in known)
                dl.append(own.total())
                at.append([t for t, _ in hit])
                tf.append([n for _, n in hit])
            yield pa.record_batch([part.column(0), pa.array(dl, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32())), *part.columns[2:]], names=[key, "dl", "terms", "tf", *carry])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string"), *carry).mapInArrow(tidy(run), f"`{key}` {kind}, dl long, terms array<int>, tf array<int>{kinds}")


def bm25(docs: DataFrame, key: str, text: str, query_terms: DataFrame, query_key: list[str], most: int | None = None, digits: int | None = None) -> DataFrame:
    """query_key..., key, score of every pair that shares a term; ``query_terms`` has query_key..., term, times.

    With ``most`` only the best of each query, by score (rounded to ``digits``, if given), then key: each block of documents
    keeps its own best first.
    """
    return prepare(docs, key, text, query_terms, query_key, digits).pairs(None if most is None else shortlists.Best(most), most)


def prepare(docs: DataFrame, key: str, text: str, query_terms: DataFrame, query_key: list[str], digits: int | None = None, carry: list[str] | None = None) -> Blocks | Joined:
    """Scores of documents for the requests, rounded to ``digits``, if given; ``carry`` are columns of documents that their pairs keep."""
    carry = carry or []
    if query_terms.select("term").limit(ASKED + 1).count() > ASKED:
        out = _joined(docs, key, text, query_terms, query_key)
        out = out if digits is None else out.withColumn("score", F.round("score", digits))
        return Joined(out.join(docs.select(key, *carry), key) if carry else out, key, query_key)
    return Blocks(docs, key, text, query_terms, query_key, digits, carry)


class Joined:
    """Scores by joins on terms, where the requests are too many to be broadcast."""

    def __init__(self, scores: DataFrame, key: str, query_key: list[str]) -> None:
        self.scores, self.key, self.query_key = scores, key, query_key

    def pairs(self, keep: shortlists.Keep | None = None, most: int | None = None) -> DataFrame:
        return self.scores if most is None else top_k(self.scores, self.query_key, self.key, most).drop("rank")

    def ranks(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.query_key).orderBy(F.desc("score"), F.asc(self.key))
        ranked = self.scores.select(*self.query_key, self.key, F.row_number().over(w).cast("long").alias("rank"))
        return ranked.join(rows.select(*self.query_key, self.key), [*self.query_key, self.key], "left_semi")

    def totals(self, column: str) -> DataFrame:
        return self.scores.groupBy(*self.query_key).agg(F.sum(column).alias(column))


class Blocks:
    """Scores of blocks of documents against all requests at once."""

    def __init__(self, docs: DataFrame, key: str, text: str, query_terms: DataFrame, query_key: list[str], digits: int | None, carry: list[str]) -> None:
        rows = query_terms.select(F.struct(*query_key).alias("q"), "term", "times").collect()  # ASKED at most
        places = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        queries = sorted({r["q"] for r in rows}, key=str)
        number = {q: i for i, q in enumerate(queries)}
        held = cut(_asked_postings(docs, key, text, places, carry))
        whole = stats(held).first()
        found = {r["t"]: r["df"] for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # ASKED at most
        q = np.array([number[r["q"]] for r in rows], np.int64)
        t = np.array([places[r["term"]] for r in rows], np.int64)
        df = np.array([found.get(x, 0) for x in range(len(places))], float)
        weight = np.array([r["times"] for r in rows], float) * np.log(1 + (whole["n"] - df + 0.5) / np.maximum(0.5, df + 0.5))[t] if rows else np.zeros(0)
        order = np.lexsort((q, t))
        first = np.searchsorted(t[order], np.arange(len(places) + 1))
        self.spark, self.held, self.key, self.query_key, self.digits, self.carry, self.queries = docs.sparkSession, held, key, query_key, digits, carry, queries
        self.shared = self.spark.sparkContext.broadcast((first, q[order], weight[order], len(queries), whole["avgdl"]))
        schema = ", ".join(f"`{c}` {query_terms.schema[c].dataType.simpleString()}" for c in query_key)
        self.names = self.spark.createDataFrame([(i, *x) for i, x in enumerate(queries)], f"_q int, {schema}")

    def _each(self, work: Callable[[int], Callable[[pa.RecordBatch | None, np.ndarray], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
        """Rows of what ``work`` makes for a task and its number of requests: a function of a block of documents and its
        scores, -1 where no term is shared, that is called without a block at the task's end."""
        shared, digits = self.shared, self.digits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, asks, weight, n_queries, avgdl = shared.value
            do = work(n_queries)
            step = max(1, BLOCK // max(1, n_queries))
            for b in batches:
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    terms = part.column("terms")
                    sizes = np.diff(np.r_[np.asarray(terms.offsets)])
                    doc = np.repeat(np.arange(part.num_rows), sizes)
                    t, tf = terms.flatten().to_numpy(), part.column("tf").flatten().to_numpy().astype(float)
                    norm = 1 - B + B * np.maximum(1, part.column("dl").to_numpy()) / avgdl
                    gain = tf * (K1 + 1) / (tf + K1 * norm[doc])
                    score = np.zeros((part.num_rows, n_queries))
                    by = np.argsort(t, kind="stable")
                    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(t[by]) != 0]), len(t)] if len(t) else np.zeros(1, np.int64)
                    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        own = slice(first[t[by[s]]], first[t[by[s]] + 1])
                        score[doc[by[s:e], None], asks[own]] += gain[by[s:e], None] * weight[own]
                    none = score <= 0
                    if digits is not None:
                        np.round(score, digits, out=score)
                    score[none] = -1
                    yield from do(part, score)
            yield from do(None, np.zeros((0, n_queries)))

        return self.held.mapInArrow(tidy(run), schema)

    def pairs(self, keep: shortlists.Keep | None = None, most: int | None = None) -> DataFrame:
        """query_key..., key, what is carried, score: all pairs or, with ``keep``, those that it leaves of each task's
        documents; with ``most`` the best of these."""
        key, carry = self.key, self.carry

        def work(n_queries: int) -> Callable[[pa.RecordBatch | None, np.ndarray], Iterator[pa.RecordBatch]]:
            state = None if keep is None else keep.begin(n_queries)

            def do(part: pa.RecordBatch | None, score: np.ndarray) -> Iterator[pa.RecordBatch]:
                if part is None:
                    return
                if keep is not None:
                    keep.drop(state, part, score)
                d, n = np.nonzero(score >= 0)
                yield pa.record_batch([pa.array(n.astype(np.int32)), *(part.column(c).take(pa.array(d)) for c in (key, *carry)), pa.array(score[d, n])], names=["_q", key, *carry, "score"])

            return do

        kinds = ", ".join(f"`{c}` {self.held.schema[c].dataType.simpleString()}" for c in (key, *carry))
        out = self._each(work, f"_q int, {kinds}, score double")
        if most is not None:
            out = out.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), F.asc(key)))).where(F.col("rank") <= most).drop("rank")
        return out.join(F.broadcast(self.names), "_q").select(*self.query_key, key, *carry, "score")  # ASKED queries at most

    def ranks(self, rows: DataFrame) -> DataFrame:
        """query_key..., key, rank among all pairs of its request, by score and then key, of ``rows`` (a few a request): blocks
        count what stands before each."""
        key, number = self.key, {q: i for i, q in enumerate(self.queries)}
        asked = sorted(((number[r["q"]], r["s"], r["k"]) for r in rows.select(F.struct(*self.query_key).alias("q"), F.col("score").alias("s"), F.col(key).alias("k")).toLocalIterator()), key=lambda x: x[:2])
        own: dict[int, list[tuple[int, float, object]]] = {}
        for i, (q, s, k) in enumerate(asked):
            own.setdefault(q, []).append((i, s, k))
        shared = self.spark.sparkContext.broadcast({q: (np.array([i for i, _, _ in x]), np.array([s for _, s, _ in x]), [k for _, _, k in x]) for q, x in own.items()})
        total = len(asked)

        def work(_: int) -> Callable[[pa.RecordBatch | None, np.ndarray], Iterator[pa.RecordBatch]]:
            ahead = np.zeros(total, np.int64)

            def do(part: pa.RecordBatch | None, score: np.ndarray) -> Iterator[pa.RecordBatch]:
                if part is None:
                    hit = np.flatnonzero(ahead)
                    yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(ahead[hit])], names=["_i", "_n"])
                    return
                for q, (at, edges, keys) in shared.value.items():
                    s = score[:, q]
                    low = np.searchsorted(edges, s, "left")  # edges below the score
                    ahead[at] += np.cumsum(np.bincount(low, minlength=len(edges) + 1)[:0:-1])[::-1]
                    high = np.searchsorted(edges, s, "right")
                    for d in np.flatnonzero(high > low).tolist():
                        k = part.column(key)[d].as_py()
                        for j in range(low[d], high[d]):
                            ahead[at[j]] += k < keys[j]

            return do

        kind = self.held.schema[key].dataType.simpleString()
        counts = self._each(work, "_i int, _n long").groupBy("_i").agg(F.sum("_n").alias("_n"))
        listed = self.spark.createDataFrame([(i, q, k) for i, (q, _, k) in enumerate(asked)], f"_i int, _q int, `{key}` {kind}")
        out = listed.join(counts, "_i", "left").join(F.broadcast(self.names), "_q")
        return out.select(*self.query_key, key, (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("rank"))

    def totals(self, column: str) -> DataFrame:
        """query_key... and the sum of a carried whole number over all pairs of the request."""

        def work(n_queries: int) -> Callable[[pa.RecordBatch | None, np.ndarray], Iterator[pa.RecordBatch]]:
            sums, met = np.zeros(n_queries, np.int64), np.zeros(n_queries, bool)

            def do(part: pa.RecordBatch | None, score: np.ndarray) -> Iterator[pa.RecordBatch]:
                if part is None:
                    q = np.flatnonzero(met)
                    yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(sums[q])], names=["_q", column])
                    return
                hit = score >= 0
                np.add(sums, np.where(hit, part.column(column).to_numpy()[:, None], 0).sum(0), out=sums)
                np.logical_or(met, hit.any(0), out=met)

            return do

        sums = self._each(work, f"_q int, `{column}` long").groupBy("_q").agg(F.sum(column).alias(column))
        return sums.join(F.broadcast(self.names), "_q").select(*self.query_key, column)


def _joined(docs: DataFrame, key: str, text: str, query_terms: DataFrame, query_key: list[str]) -> DataFrame:
    """The same by joins on terms, for any number of requests."""
    post = cut(postings(docs, key, text))
    dl = docs.select(key).join(post.groupBy(key).agg(F.sum("tf").alias("dl")), key, "left").select(key, F.coalesce("dl", F.lit(0)).alias("dl"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = query_terms.join(df, "term").crossJoin(F.broadcast(stats(dl)))  # stats is one row
    weighed = weighed.withColumn("idf", idf(F.col("df"), F.col("n")))
    norm = 1 - B + B * F.greatest(F.lit(1), F.col("dl")) / F.col("avgdl")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    return post.join(dl, key).join(weighed.drop("df", "n"), "term").groupBy(*query_key, key).agg(F.sum(part).alias("score"))


def query_terms(queries: DataFrame, key: list[str], text: str) -> DataFrame:
    return terms(queries, key, text).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("times"))


def normalised(scores: DataFrame, query_key: list[str]) -> DataFrame:
    """Scores over the best of their query, from an aggregate joined back rather than a window over a whole query."""
    top = scores.groupBy(*query_key).agg(F.max("score").alias("top"))
    return scores.join(top, query_key).withColumn("score", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)).drop("top")


def top_k(scores: DataFrame, query_key: list[str], key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*query_key).orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, pass_id, text: the task, its usable terms, its identifiers; what is empty falls back to the task."""
    t = F.col(text)
    either = lambda terms: F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(t)
    return queries.select(key, F.posexplode(F.array(t, either(usable_terms(t)), either(full_identifiers(t)))).alias("pass_id", "text"))


def fuse(scores: DataFrame, query_key: list[str], key: str, mode: str) -> DataFrame:
    if mode not in ("max", "sum"):
        raise ValueError(f"fusion is max or sum, not {mode!r}")
    return scores.groupBy(*query_key, key).agg((F.max if mode == "max" else F.sum)("score").alias("score"))
