"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Words are maximal runs of letters (any byte from 0x80 counts as one), of digits, or of other signs.  Word unigrams and
bigrams hash into ``2 ** BITS`` weights, where all bigrams of a word with itself, next to it or after one other word, are
one feature each, so that stuttering is learned from other words' stuttering; a document's value of a feature is its share of the document's n-grams times
``SCALE``, and its score the logistic function of the sparse dot product.

Training reads a bounded sample: about ``per_class`` labelled documents of each class in expectation, chosen by a hash of
doc_id, whole texts.  Scoring reads every whole text.

Defined results: a null or empty text has no n-grams and gets the intercept's score; labels that are null are ignored; a
doc_id labelled more than once takes the majority (ties: 1); without labels of both classes every score is 0.5 (predicted
1); repeated rows get equal scores; a null doc_id is held in, has no label and is scored like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M2, U64, bucket_of, carried, loads, mix, restored, row_sums, slices, span_hashes, text_bytes, texts, token_runs, tidy

BITS, SCALE, PER_CLASS, EPOCHS = 18, 12.0, 2000, 4
STUTTER = np.array([1, 2], U64) << U64(60)
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def ngrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams then bigrams of each row, as feature numbers, and the first of each row (n + 1 values)."""
    start, length, first = token_runs(KIND[buf], at)
    h = span_hashes(loads(buf), start, length)
    n = len(h)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    same = row[1:] == row[:-1]
    both = np.empty(2 * n, U64)
    both[0::2] = h
    if n:
        both[1::2][: n - 1] = mix(h[:-1] * M2 + h[1:])
        twice = np.zeros(n, bool)
        twice[: n - 2] = (h[: n - 2] == h[2:]) & (row[: n - 2] == row[2:])
        both[1::2][twice] = STUTTER[1]
        both[1::2][: n - 1][h[:-1] == h[1:]] = STUTTER[0]
    real = np.ones(2 * n, bool)
    real[1::2][: n - 1] = same
    real[2 * n - 1 :] = False
    before = np.r_[0, np.cumsum(real)]
    return (both[real] >> U64(64 - BITS)).astype(np.int64), before[2 * first]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.1) -> np.ndarray:
    """Weights, the intercept last: one adaptive proximal step a document and epoch."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(EPOCHS):
        for f, x, y in rows:
            w = weights(f)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - step * w
            n[f] += g * g
    return weights(slice(None))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Labelled documents to learn from: doc_id, y, rank."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", 3) != 1))
    by_id = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    share = by_id.groupBy("y").agg((F.lit(float(per_class)) / F.count(F.lit(1))).alias("share")).collect()
    rank = (F.xxhash64(F.lit("quality"), "doc_id") % (1 << 30) + (1 << 30)) / float(1 << 31)
    keep = F.lit(False)
    for r in share:
        keep = keep | ((F.col("y") == r["y"]) & (rank < float(r["share"])))
    return by_id.where(keep).withColumn("rank", rank)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray | None:
    """Weights, or None if one class is missing.  The driver gets the sample's features only."""
    chosen = _sample(docs, labels, per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = text_bytes(b.column("text"))
            f, first = ngrams(buf, at)
            packed = []
            for i, j in zip(first[:-1], first[1:], strict=True):
                u, c = np.unique(f[i:j], return_counts=True)
                packed.append(np.r_[u.astype("<i4"), c.astype("<i4")].tobytes())
            yield pa.record_batch([b.column("rank"), b.column("y"), pa.array(packed, pa.binary())], names=["rank", "y", "features"])

    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "rank", "y").mapInArrow(tidy(features), "rank double, y int, features binary").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    data = []
    for r in sorted(rows, key=lambda r: (r["rank"], r["y"], bytes(r["features"]))):
        u, c = np.frombuffer(r["features"], "<i4").reshape(2, -1)
        data.append((np.r_[u, 1 << BITS], np.r_[c * (SCALE / max(1, c.sum())), 1.0], r["y"]))
    return ftrl(data)


def _scorer(docs: DataFrame, weights: np.ndarray | None) -> Callable[[pa.Array], np.ndarray]:
    """Scores of the texts of a batch; the weights are broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))

    def score(text: pa.Array) -> np.ndarray:
        w = shared.value
        buf, at = text_bytes(text)
        out = np.full(len(text), 0.5)
        for i, j in slices(at, 1 << 20) if w is not None else ():
            f, first = ngrams(buf[at[i] : at[j]], at[i : j + 1] - at[i])
            out[i:j] = 1 / (1 + np.exp(-np.clip(row_sums(w[f], first) * SCALE / np.maximum(1, np.diff(first)) + w[-1], -30, 30)))
        return out

    return score


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    score = _scorer(docs, train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = score(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return texts(docs, held).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, whole, in one narrow pass: no text is shuffled."""
    score = _scorer(docs, train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(pc.fill_null(b.column("raw"), "")) >= 0.5))

    columns, schema = carried(docs)
    return restored(docs.select(*columns).mapInArrow(tidy(run), schema), docs)
