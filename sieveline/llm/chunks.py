"""Chunks of documents that talk to hash buckets, in packed rows.

Documents are dealt into chunks by a hash of doc_id.  A chunk folds what it holds (each key once, with its smallest rank
in the chunk) and sends one packed row to each bucket of keys; a bucket decides over all chunks and answers with one
packed row a chunk.  A key shared by a third of all rows therefore weighs no more than one entry a chunk, and both sides
are as many as the text needs.  The chunk exchange is the same plan wherever it is used, so Spark runs it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

CHUNK, LEAST = 6 << 20, 48
PACKED = "chunk int, bucket int, payload binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK) -> tuple[DataFrame, int]:
    """chunk, doc_id, text; and the number of chunks."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(LEAST, -(-int(size) // chunk_bytes))
    return texts(docs).select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text"), n


def in_order(t: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    """doc_ids (None last), the same as integers, and UTF-8 texts, in an order that reruns repeat."""
    ids, raw = t.column("doc_id").to_pylist(), [x.encode() for x in t.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i]))
    ids, raw = [ids[i] for i in order], [raw[i] for i in order]
    return ids, np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64), raw


def packed(chunk: list[int] | int, bucket: list[int] | int, payload: list[bytes]) -> pa.Table:
    n = len(payload)
    full = lambda x: pa.array([x] * n if isinstance(x, int) else x, pa.int32())
    return pa.table({"chunk": full(chunk), "bucket": full(bucket), "payload": pa.array(payload, pa.binary())})


def groups(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``of`` with the places that hold it."""
    if len(of):
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(of[order[i]]), order[i:j]
