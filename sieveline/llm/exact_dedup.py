"""Exact dedup by a tree merge of sorted digest runs.

Every input partition makes one sorted run of digests per digest range.  Runs then meet in binomial rounds: in round k
those whose numbers differ in bit k are exchanged and merged by a multiway merge into one, and each digest keeps its count
and the verified smallest rank (longest text, then smallest identifier, then first row) at every level.  Within a run a
digest occurs once, so a group of copies adds at most one entry a partition, however large it is.  Ranges are as many as
the input needs, so no task holds all digests.  Texts are hashed once; the verdicts on groups of a thousandth of all rows
or more (a thousand groups at most) are broadcast to their members, all others meet theirs in a shuffle.

Defined results: a null text counts as empty; all empty texts are one group; a null doc_id ranks after any other, the
largest long included; of repeated rows with one doc_id exactly one is kept; an empty table gives an empty result; columns
beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, cut, join_heavy, numbered, parts, rows_of, text_bytes, texts, tidy

#: Bytes that normalisation deletes.
SPACE = b" \t\n\x0b\x0c\r"
ROUNDS, HELD = 6, 400_000
#: A key is a digest and the length that verifies it; both sides of a comparison lose trailing zero bytes alike.
ENTRY = np.dtype([("key", "S40"), ("chars", "<i8"), ("nameless", "<i8"), ("doc", "<i8"), ("row", "<i8"), ("n", "<i8")])


def digests(rows: DataFrame) -> DataFrame:
    """number, doc_id, key (digest of the normalised text and its length), and the code points of the original text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = text_bytes(b.column("text"))
            raw = buf.tobytes()
            units = [raw[s:e].translate(None, SPACE) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [b.column("number"), b.column("doc_id"), pa.array([hashlib.sha256(u).digest() + len(u).to_bytes(8, "big") for u in units], pa.binary()), pc.utf8_length(b.column("text")).cast(pa.int64())],
                names=["number", "doc_id", "key", "chars"],
            )

    return rows.mapInArrow(tidy(run), "number long, doc_id long, key binary, chars long")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted runs as one: keys of both keep the better rank and the sum of their counts."""
    place = np.searchsorted(a["key"], b["key"])
    shared = place < len(a)
    shared[shared] = a["key"][place[shared]] == b["key"][shared]
    new = np.flatnonzero(~shared)
    out = np.empty(len(a) + len(new), ENTRY)
    theirs = np.zeros(len(out), bool)
    theirs[place[new] + np.arange(len(new))] = True
    out[theirs], out[~theirs] = b[new], a
    if shared.any():
        at, other = np.flatnonzero(~theirs)[place[shared]], b[shared]
        own = out[at]
        total, better = own["n"] + other["n"], np.zeros(len(own), bool)
        tied = np.ones(len(own), bool)
        for name, sign in (("chars", -1), ("nameless", 1), ("doc", 1), ("row", 1)):
            x, y = own[name], other[name]
            better |= tied & (y > x if sign < 0 else y < x)
            tied &= x == y
        own[better] = other[better]
        own["n"] = total
        out[at] = own
    return out


def multiway(runs: Iterable[np.ndarray]) -> np.ndarray:
    """One sorted run of many, the shortest two at a time."""
    turn = count()
    heap = [(len(r), next(turn), r) for r in runs]
    if not heap:
        return np.zeros(0, ENTRY)
    heapq.heapify(heap)
    while len(heap) > 1:
        r = merge(heapq.heappop(heap)[2], heapq.heappop(heap)[2])
        heapq.heappush(heap, (len(r), next(turn), r))
    return heap[0][2]


def sorted_run(e: np.ndarray) -> np.ndarray:
    """Entries in any order as a run: sorted by key, one entry a key."""
    e = e[np.lexsort((e["row"], e["doc"], e["nameless"], -e["chars"], e["key"]))]
    head = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]]) if len(e) else np.zeros(0, np.int64)
    out = e[head]
    if len(e):
        out["n"] = np.add.reduceat(e["n"], head)
    return out


def runs(members: DataFrame, ranges: int) -> DataFrame:
    """Sorted runs of the input's partitions: range, run, entries."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, run = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            run = b.column("run")[0].as_py()
            e = np.zeros(b.num_rows, ENTRY)
            e["key"] = np.array(b.column("key").to_pylist(), "S40")
            e["chars"], e["row"], e["n"] = b.column("chars").to_numpy(), b.column("number").to_numpy(), 1
            e["nameless"], e["doc"] = pc.is_null(b.column("doc_id")).to_numpy(zero_copy_only=False), pc.fill_null(b.column("doc_id"), 0).to_numpy()
            held.append(sorted_run(e))
            if sum(map(len, held)) > HELD:
                yield from deal(multiway(held), run)
                held = []
        yield from deal(multiway(held), run)

    def deal(e: np.ndarray, run: int) -> Iterator[pa.RecordBatch]:
        if len(e):
            head = np.frombuffer(e["key"].tobytes(), np.uint8).reshape(-1, 40)[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
            of = head * ranges >> 32
            cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(e)]
            yield pa.record_batch([pa.array(of[cuts[:-1]], pa.int32()), pa.array([run] * (len(cuts) - 1), pa.int32()), pa.array([e[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["range", "run", "entries"])

    return members.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(1 << ROUNDS))).mapInArrow(tidy(make), "range int, run int, entries binary")


def tree_merge(level: DataFrame) -> DataFrame:
    """Binomial rounds: the two halves of each pair of run numbers meet; the last round tells the winner of every key."""

    def meet(t: pa.Table) -> pa.Table:
        e = multiway(np.frombuffer(x.as_buffer(), ENTRY) for x in t.column("entries").combine_chunks())
        return pa.table({"range": t.column("range")[:1], "run": t.column("run")[:1], "entries": pa.array([e.tobytes()], pa.binary())})

    def decide(t: pa.Table) -> pa.Table:
        e = multiway(np.frombuffer(x.as_buffer(), ENTRY) for x in t.column("entries").combine_chunks())
        raw = e["key"].tobytes()
        keys = pa.array([raw[i : i + 40] for i in range(0, len(raw), 40)], pa.binary())
        return pa.table({"key": keys, "keep_id": pa.array(e["doc"], mask=e["nameless"] != 0), "keep_number": pa.array(e["row"].copy()), "group_size": pa.array(e["n"].copy())})

    for left in range(ROUNDS - 1, -1, -1):
        pairs = level.withColumn("run", F.shiftright("run", 1)).groupBy("range", "run")
        level = pairs.applyInArrow(meet, "range int, run int, entries binary") if left else pairs.applyInArrow(decide, "key binary, keep_id long, keep_number long, group_size long")
    return level


def _verdicts(rows: DataFrame, ranges: int | None) -> DataFrame:
    """number, doc_id, keep_id, keep_number, group_size and key of rows of number, doc_id and text."""
    members = cut(digests(rows))
    best = cut(tree_merge(runs(members, ranges or parts(rows))))
    return join_heavy(members, best, ["key"], "group_size", members.count())


def exact_dedup(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    found = _verdicts(texts(docs, F.monotonically_increasing_id().alias("number")), ranges)
    return found.select("doc_id", "keep_id", "group_size", (F.col("number") == F.col("keep_number")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def unique(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps: one of each group."""
    rows = numbered(docs)
    copies = cut(_verdicts(rows_of(rows), ranges).where(F.col("number") != F.col("keep_number")).select("number"))
    return among(rows, copies, "left_anti").select("row.*")
