"""Benchmark decontamination by winnowing.

A document's word ``K``-grams are hashed, and of every ``WINDOW - K + 1`` consecutive ones the smallest is kept as a
fingerprint, so any shared span of ``WINDOW`` words shares one.  Kept fingerprints are joined with the benchmark's; each
hit is extended to the ``WINDOW``-word spans around it, which are verified word by word.  An item of fewer words is one
window of its own length, where every gram of that length is kept.

The benchmark is a query set: it is cut into blocks of about ``block_words`` words, each a broadcast of its own, and every
batch of documents is split into words once and meets the blocks one after another, in one narrow pass.  The blocks of a
large benchmark stand side by side in a worker (about 300 bytes a word).

Defined results: null or empty texts have no words, so no hits; a null item text or one without words never occurs;
repeated items count once an item_id; a null item_id hits and counts like any other, but has no name to list; an empty
benchmark leaves every document clean; repeated rows give equal rows; columns beyond doc_id and text are ignored, and
``clean`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M2, U64, carried, loads, mix, restored, slices, span_hashes, text_bytes, texts, token_runs, tidy

WINDOW, K, BLOCK_WORDS = 10, 5, 200_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes after lower-casing: digits, a to z and everything from 0x80.
WORD = np.zeros(256, np.uint8)
WORD[48:58] = WORD[97:123] = WORD[128:] = 1


def fold(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words."""
    if len(h) < k:
        return h[:0]
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * M2 + h[i : len(h) - k + 1 + i]
    return mix(out)


def smallest(h: np.ndarray, w: int) -> np.ndarray:
    out = h
    span = 1
    while span * 2 <= w and len(out) > span:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (w - span)], out[w - span :]) if span < w else out


class Block:
    """The windows of some items: fingerprints of full windows, and for each window length its hash, words and items."""

    def __init__(self, items: list[tuple[str | None, bytes]]) -> None:
        self.windows: dict[int, dict[int, dict[bytes, set[str | None]]]] = {}
        prints: list[np.ndarray] = []
        for item, text in items:
            buf = LOWER[np.frombuffer(text, np.uint8)]
            start, length, _ = token_runs(WORD[buf], np.array([0, len(buf)]))
            if not len(start):
                continue
            h, n = span_hashes(loads(buf), start, length), min(WINDOW, len(start))
            raw = buf.tobytes()
            words = [raw[s : s + x] for s, x in zip(start.tolist(), length.tolist(), strict=True)]
            own = self.windows.setdefault(n, {})
            for i, g in enumerate(fold(h, n).tolist()):
                own.setdefault(g, {}).setdefault(b" ".join(words[i : i + n]), set()).add(item)
            if n == WINDOW:
                prints.append(smallest(fold(h, K), WINDOW - K + 1))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, U64)
        self.hashes = {n: np.array(sorted(w), U64) for n, w in self.windows.items()}

    def starts(self, h: np.ndarray, n: int) -> np.ndarray:
        """Where a window of n words may occur."""
        if n < WINDOW:
            return np.flatnonzero(member(fold(h, n), self.hashes[n]))
        low = smallest(fold(h, K), WINDOW - K + 1)
        near = np.flatnonzero(member(low, self.prints))  # a window is near if its own fingerprint is the benchmark's
        return near[member(fold(h, WINDOW)[near], self.hashes[n])] if len(near) else near


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _blocks(bench: DataFrame, block_words: int) -> Iterator[Block]:
    """Blocks of the benchmark, one after another; only one is on the driver at a time."""
    rows = bench.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-int(size) // (6 * block_words)))
    for i in range(count):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(count)) == i) if count > 1 else rows
        yield Block([(r["item"], r["text"].encode()) for r in part.collect()])


def _shared(docs: DataFrame, bench: DataFrame, block_words: int) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(bench, block_words)]


def decontaminate(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the hit spans (word numbers) and items of every row."""
    shared = _shared(docs, bench, block_words)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans, items = np.zeros(b.num_rows, np.int64), [set() for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
            for i, j, count, found in _hits(shared, b.column("text")):
                n_words[i:j] = count
                for r, s, n, keys in found:
                    items[r] |= keys
                    spans[r].add((s, s + n))
            merged = [joined(x) for x in spans]
            hit = [sum(e - s for s, e in x) for x in merged]
            names = [sorted(x - {None}) for x in items]
            yield pa.record_batch(
                [
                    b.column("doc_id"), pa.array(n_words), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                    pa.array([x > 0 for x in hit], pa.bool_()), pa.array([[{"first": s, "last": e - 1} for s, e in x] for x in merged], kind), pa.array(names, pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
            )

    return texts(docs).mapInArrow(tidy(scan), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,last:long>>, items array<string>")


def clean(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, whole, in one narrow pass: no text is shuffled."""
    shared = _shared(docs, bench, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            free = np.ones(b.num_rows, bool)
            for *_, found in _hits(shared, pc.fill_null(b.column("raw"), "")):
                free[[r for r, *_ in found]] = False
            yield b.filter(pa.array(free))

    columns, schema = carried(docs)
    return restored(docs.select(*columns).mapInArrow(tidy(scan), schema), docs)


def joined(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _hits(shared: list[Broadcast], text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, int, set[str | None]]]]]:
    """Slices of a batch: first and last row, words of each, and verified windows (row, first word, words, items)."""
    buf, at = text_bytes(text)
    for i, j in slices(at, 1 << 20):
        low = LOWER[buf[at[i] : at[j]]]
        start, length, first = token_runs(WORD[low], at[i : j + 1] - at[i])
        h, found_all = span_hashes(loads(low), start, length), []
        for block in shared:
            for n, own in block.value.windows.items():
                found = block.value.starts(h, n)
                row = np.searchsorted(first, found, "right") - 1
                fits = found + n <= first[row + 1] if len(found) else np.zeros(0, bool)
                for s, r in zip(found[fits].tolist(), row[fits].tolist(), strict=True):
                    words = b" ".join(low[start[x] : start[x] + length[x]].tobytes() for x in range(s, s + n))
                    if keys := own.get(int(fold(h[s : s + n], n)[0]), {}).get(words):
                        found_all.append((i + r, s - int(first[r]), n, keys))
        yield i, j, np.diff(first), found_all
