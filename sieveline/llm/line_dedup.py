"""Substring dedup by hashing lines.

A unit is a line, cut further after sentence-final signs that white space follows, so that a passage pasted into the
middle of a paragraph meets its copies; sentences of fewer than ``min_words`` words join the next short ones.  Units are
normalised (ASCII lower case, runs of white space to one space) and hashed to 128 bits: a whole line however short it is,
but short sentences beside longer ones together with those, so that they go only where that neighbour repeats too.  Digests are grouped over all documents, and only the occurrence of
the smallest (doc_id, offset) stays.  What is removed keeps its byte offsets in the original UTF-8 text.

Defined results: null and empty texts have no units; within one text the first of equal units stays; rows that repeat a
doc_id count in the order of their texts; a null doc_id ranks last; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .chunks import PACKED, chunked, groups, in_order, packed

UNIT = re.compile(rb"[^\n.!?]*(?:[.!?]+(?![\s.!?]|\Z)[^\n.!?]*)*(?:[.!?]+|\n|\Z)")
MIN_WORDS = 6


def units(raw: bytes, min_words: int) -> list[tuple[int, int, bytes | None]]:
    """Start, end and digest (None: white space only) of every unit; together they are the whole text."""
    out: list[tuple[int, int, bytes | None]] = []
    since, held = 0, []  # of the short sentences that wait
    before: list[bytes] = []  # words of the unit before in the same line

    def close(s: int, e: int, words: list[bytes], *beside: bytes) -> None:
        if e > s:
            out.append((s, e, xxhash.xxh3_128_digest(b"\n".join([b" ".join(words), *beside])) if words else None))

    def close_short(e: int) -> None:
        if before and len(held) < min_words:
            close(since, e, held, b" ".join(before), b"")
        else:
            close(since, e, held)

    for m in UNIT.finditer(raw):
        s, e = m.span()
        words = raw[s:e].lower().split()
        if len(words) >= min_words:
            close(since, s, held, b" ".join(words))
            close(s, e, words)
            since, held, before = e, [], [] if raw[e - 1 : e] == b"\n" else words
            continue
        held += words
        if len(held) >= min_words or raw[e - 1 : e] == b"\n":
            close_short(e)
            since, held, before = e, [], [] if raw[e - 1 : e] == b"\n" else held
    close_short(len(raw))
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_units, n_removed, removed spans and kept_text for every row of ``docs``."""
    rows, n = chunked(docs)

    def send(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, doc, raw = in_order(t)
        first: dict[bytes, int] = {}
        for d, r in zip(doc.tolist(), raw, strict=True):
            for _, _, g in units(r, min_words):
                if g is not None:
                    first.setdefault(g, d)
        g, d = np.array(list(first), "V16"), np.array(list(first.values()), "<i8")
        of = np.frombuffer(g.tobytes(), "<u8")[::2] % np.uint64(n) if len(g) else np.zeros(0, np.uint64)
        out = [(b, g[at].tobytes() + d[at].tobytes()) for b, at in groups(of.astype(np.int64))]
        return packed(key[0].as_py(), [b for b, _ in out], [p for _, p in out])

    def decide(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        parts = t.column("payload").to_pylist()
        sizes = [len(x) // 24 for x in parts]
        g = np.frombuffer(b"".join(x[: 16 * k] for x, k in zip(parts, sizes, strict=True)), "<u8").reshape(-1, 2)
        d = np.frombuffer(b"".join(x[16 * k :] for x, k in zip(parts, sizes, strict=True)), "<i8")
        chunk = np.repeat(t.column("chunk").to_numpy(), sizes)
        order = np.lexsort((chunk, d, g[:, 1], g[:, 0]))
        again = np.zeros(len(order), bool)
        again[1:] = (g[order[1:]] == g[order[:-1]]).all(1)
        out = [(c, g[order[again][at]].tobytes()) for c, at in groups(chunk[order[again]])]
        return packed([c for c, _ in out], key[0].as_py(), [p for _, p in out])

    def remove(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, _, raw = in_order(t)
        lost = {p[i : i + 16] for p in answers.column("payload").to_pylist() for i in range(0, len(p), 16)}
        n_units, spans, kept = [], [], []
        for r in raw:
            own, gone, rest, last = units(r, min_words), [], [], 0
            for s, e, g in own:
                if g is None:
                    continue
                if g in lost:
                    gone.append((s, e))
                    rest.append(r[last:s])
                    last = e
                else:
                    lost.add(g)
            n_units.append(len(own))
            spans.append([{"start": s, "end": e} for s, e in gone])
            kept.append((b"".join([*rest, r[last:]])).decode())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_units": pa.array(n_units, pa.int64()), "n_removed": pa.array([len(x) for x in spans], pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array(kept, pa.string())})

    lost = rows.groupBy("chunk").applyInArrow(send, PACKED).groupBy("bucket").applyInArrow(decide, PACKED)
    return rows.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_units long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
