"""Language identification by error-correcting output codes.

Each language has a codeword; one binary logistic classifier over hashed byte trigrams predicts each bit.  Decoding sums
the logistic losses of the bits against every codeword, takes the codeword of least loss, and flags a text as ambiguous
if the runner-up's share is within ``margin``.  Few languages use the exhaustive code, more use random balanced columns
of fixed seeds, of which the code with the largest least distance is taken.

Training reads a bounded sample: about ``per_lang`` documents of each language in expectation, chosen by a hash of
doc_id, whole texts.  Prediction reads every whole text.

Defined results: a null text, an empty one or one without letters is ``und`` with score 0; one learned language is
predicted for all the rest with score 1; none learned gives ``und`` throughout; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, row_sums, slices, text_bytes, texts

BITS, PER_LANG, EPOCHS, SCALE = 15, 400, 4, 10.0
#: Bytes as the classifiers see them: lower case, everything but letters a space.
SEEN = np.full(256, 32, np.uint8)
SEEN[97:123] = np.arange(97, 123)
SEEN[65:91] = np.arange(97, 123)
SEEN[128:] = np.arange(128, 256)


def code_of(k: int) -> np.ndarray:
    """k codewords of +1 and -1, every column splitting the languages."""
    if k <= 6:
        return np.array([[1 if c >> i & 1 else -1 for c in range(1, 1 << (k - 1))] for i in range(k)], np.float32).reshape(k, -1)
    best, apart = np.zeros((k, 0), np.float32), -1
    for seed in range(20):  # of several random codes the one whose closest words differ most
        rng, columns = np.random.default_rng(7 + seed), []
        while len(columns) < max(15, int(10 * np.log2(k))):
            columns.append(np.where(rng.permutation(k) < k // 2, 1, -1))
        code = np.array(columns, np.float32).T
        least = distances(code).min()
        if least > apart:
            best, apart = code, least
    return best


def distances(code: np.ndarray) -> np.ndarray:
    """Bits in which each two different code words differ."""
    far = (code.shape[1] - code @ code.T) / 2
    return far[np.triu_indices(len(code), 1)]


def trigrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each row and the first of each row (n + 1 values)."""
    s = np.insert(SEEN[buf], np.sort(np.r_[at[:-1], at[1:]]), 32).astype(np.uint32)  # a space before and after each row
    at = at + 2 * np.arange(len(at))
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    h = ((s[:-2] | s[1:-1] << np.uint32(8) | s[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    inside = np.ones(len(h), bool)
    inside[at[1:-1] - 2] = inside[at[1:-1] - 1] = False
    blank = (s[:-2] == 32) & (s[1:-1] == 32)
    inside &= ~blank
    before = np.r_[0, np.cumsum(inside)]
    return h[inside].astype(np.int64), before[np.minimum(at, len(h))]


def train(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, codewords and weights (the intercept last), one column a bit."""
    usable = docs.where(F.col("lang").isNotNull() & F.coalesce(bucket_of("doc_id", 4) != 2, F.lit(False)))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    code = code_of(len(langs)) if len(langs) > 1 else np.zeros((len(langs), 0), np.float32)
    w = np.zeros(((1 << BITS) + 1, code.shape[1]))
    if len(langs) < 2:
        return langs, code, w.astype(np.float32)
    rank = (F.xxhash64(F.lit("language"), F.col("doc_id").cast("long")) % (1 << 30) + (1 << 30)) / float(1 << 31)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, per_lang / counts[lang])])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = text_bytes(b.column("text"))
            f, first = trigrams(buf, at)
            packed = []
            for i, j in zip(first[:-1], first[1:], strict=True):
                u, c = np.unique(f[i:j], return_counts=True)
                packed.append(np.r_[u.astype("<i4"), c.astype("<i4")].tobytes())
            yield pa.record_batch([b.column("rank"), b.column("y"), pa.array(packed, pa.binary())], names=["rank", "y", "features"])

    rows = texts(usable.where(rank < share[F.col("lang")]), rank.alias("rank"), F.col("lang").alias("y")).select("text", "rank", "y").mapInArrow(features, "rank double, y string, features binary").collect()
    seen = np.ones_like(w)
    order = sorted(rows, key=lambda r: (r["rank"], r["y"], bytes(r["features"])))
    for _ in range(EPOCHS):
        for r in order:
            u, c = np.frombuffer(r["features"], "<i4").reshape(2, -1)
            f, x = np.r_[u, 1 << BITS], np.r_[c * (SCALE / max(1, c.sum())), 0.1][:, None]
            bits = code[langs.index(r["y"])]
            g = -x * (bits / (1 + np.exp(np.clip(bits * (x.T @ w[f])[0], -30, 30))))[None, :]
            seen[f] += g * g
            w[f] -= 0.5 * g / np.sqrt(seen[f])
    return langs, code, w.astype(np.float32)


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Share of each language: the softmax of minus the loss of its codeword."""
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * code[None], -30, 30))).sum(2)
    e = np.exp(loss.min(1, keepdims=True) - loss)
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, per_lang: int = PER_LANG, margin: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, w = model.value
        for b in batches:
            n = b.num_rows
            letters = pc.match_substring_regex(b.column("text"), r"\p{L}").to_numpy(zero_copy_only=False)
            best, score, close = np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
            if len(langs) > 1 and n:
                buf, at = text_bytes(b.column("text"))
                margins = np.zeros((n, code.shape[1]))
                for i, j in slices(at, 1 << 19):
                    f, first = trigrams(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                    margins[i:j] = row_sums(w[f], first) * SCALE / np.maximum(1, np.diff(first))[:, None] + 0.1 * w[-1]
                share = decode(margins, code)
                best, top = share.argmax(1), np.sort(share, 1)
                score, close = top[:, -1], top[:, -1] - top[:, -2] < margin
            und = ~letters if langs else np.ones(n, bool)
            pred = ["und" if u else langs[k] for u, k in zip(und.tolist(), best.tolist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(np.where(und, 0.0, score)), pa.array(close | und)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    held = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return texts(docs, held).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
