"""Substring dedup by longest-previous-factor arrays.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller doc_id.  Each window of
SPAN bytes is dealt by its minimiser, the smallest hash of its ``GRAM``-byte grams, so equal windows meet:

1. Chunks of documents send their distinct minimisers to hash buckets, which answer with those that two documents share.
2. Chunks send, for each run of windows with a shared minimiser, the bytes of the run (its context), once a chunk.
3. A bucket sorts the suffixes of its distinct contexts by prefix doubling; a context's value is its smallest doc_id.  In
   suffix order, the previous and next smaller values and the prefixes shared on the way to them give each suffix's
   longest previous factor, capped at SPAN.  A window goes if that is SPAN, or if its whole context also stands in an
   earlier document.  (A context alone with its minimiser has no previous factor, so it needs no sort.)
4. Chunks join the removed ranges of each document and cut them out.

A minimiser of more than ``hot`` occurrences sends its windows one by one instead, as contexts of SPAN bytes dealt by their
own hashes, so that a very common line spreads over all buckets.  False agreement of minimiser hashes only adds contexts to
sort; results rest on the bytes.

Defined results: a null text is empty and loses nothing, as does any of fewer than SPAN bytes; rows that repeat a doc_id
do not remove each other's bytes; a null doc_id counts as larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .chunks import PACKED, chunked, groups, in_order, packed
from .common import M1, M2, U64, loads, mix, trim

SPAN, GRAM, HOT = 50, 20, 6000
PIECE, SORTED = 1 << 18, 1 << 18
LOW = U64((1 << 44) - 1)


def run_minima(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows inside rows with one minimiser: its hash, first window, number of windows, and row."""
    parts = []
    n = len(buf) - SPAN + 1
    row_end = np.repeat(at[1:], np.diff(at))
    for s in range(0, max(n, 0), PIECE):
        e = min(s + PIECE, n)
        v = loads(buf[s : e + SPAN - 1])
        m = e - s + SPAN - GRAM
        low = mix(v[:m] * M1 ^ (v[8 : 8 + m] + M2) * M2 ^ (v[12 : 12 + m] ^ M1) * U64(0xD6E8FEB86659FD93))
        for step in (1, 2, 4, 8, SPAN - GRAM + 1 - 16):
            low = np.minimum(low[:-step], low[step:])
        inside = row_end[s:e] >= np.arange(s + SPAN, e + SPAN)
        edge = np.empty(e - s, bool)
        edge[0] = True
        edge[1:] = (low[1:] != low[:-1]) | (row_end[s + 1 : e] != row_end[s : e - 1])
        first = np.flatnonzero(edge)
        count = np.add.reduceat(inside, first, dtype=np.int64)
        first, count = first[count > 0], count[count > 0]
        parts.append((low[first], first + s, count))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z
    h, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, first, count, np.searchsorted(at, first, "right") - 1


def classes(text: np.ndarray) -> np.ndarray:
    """Ranks, in suffix order, of the SPAN-byte prefixes of all suffixes; the text is followed by zero bytes."""

    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        own = keys[order]
        out = np.empty(len(keys), np.int64)
        out[order] = np.cumsum(np.r_[0, own[1:] != own[:-1]])
        return out

    def after(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        out[: max(0, len(rank) - by)] = rank[by:] + 1
        return out

    rank = ranked(loads(text).byteswap())
    for by in (8, 16, SPAN - 32):
        rank = ranked(rank << 31 | after(rank, by))
    return rank


def common_prefixes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each suffix and the one before it in ``at`` the length of their common prefix, SPAN at most; 0 for the first.

    ``words`` are the loads of the text.
    """
    out = np.full(len(at), SPAN, np.int64)
    out[:1] = 0
    open_ = np.arange(1, len(at))
    for off in (0, 8, 16, 24, 32, 40, SPAN - 8):
        x = words[at[open_] + off] ^ words[at[open_ - 1] + off]
        cut = x != 0
        last = x[cut]
        last &= ~last + U64(1)  # the lowest bit, in the first byte that differs
        out[open_[cut]] = off + np.bitwise_count(last - U64(1)) // 8
        open_ = open_[~cut]
    return out


def _reach(value: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Of each place the prefix it shares with the last place before it of a smaller value, if that is SPAN or more.

    Places point one back and jump over those that are not smaller along their pointers, with the least prefix on the way;
    a walk ends where that falls below SPAN.
    """
    back, least = np.arange(-1, len(value) - 1), shared.copy()
    walk = np.flatnonzero(least >= SPAN)
    walk = walk[value[back[walk]] >= value[walk]]
    while len(walk):
        j = back[walk]
        least[walk] = np.minimum(least[walk], least[j])
        back[walk] = back[j]
        walk = walk[least[walk] >= SPAN]
        walk = walk[value[back[walk]] >= value[walk]]
    return least


def longest_previous(value: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order: the longer of the prefixes shared with the previous and the next
    place of smaller value; right where it is SPAN, below SPAN elsewhere."""
    after = _reach(value[::-1], np.r_[shared[:0], np.zeros(min(1, len(shared)), np.int64), shared[:0:-1]])[::-1]
    return np.maximum(_reach(value, shared), after)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """n buckets, up to 2 ** 32, from a hash mixed again: minimisers are small values, so their own upper bits are not even."""
    return ((mix(h) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def tag_of(bucket: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A minimiser's name: its bucket and the bits that were sent."""
    return mix(bucket.astype(U64) * M1 ^ (h & LOW))


def _send_minima(n: int):  # noqa: ANN202
    def send(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        trim()
        _, doc, raw = in_order(t)
        buf, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        h, _, _, row = run_minima(buf, at)
        order = np.lexsort((doc[row], h)) if len(h) else np.zeros(0, np.int64)
        h, d = h[order], doc[row[order]]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else order
        size = np.diff(np.r_[head, len(h)])
        code = np.where(d[head] != d[head + size - 1], np.clip(np.log2(size).astype(np.int64), 1, 15), 0)
        word = (h[head] & LOW) << U64(4) | code.astype(U64)
        six = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)[:, :6]
        out = [(b, six[at].tobytes()) for b, at in groups(bucket_of(h[head], n))]
        return packed(key[0].as_py(), [b for b, _ in out], [p for _, p in out])

    return send


def _shared_minima(hot: int):  # noqa: ANN202
    def decide(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        payload = t.column("payload").to_pylist()
        sizes = np.array([len(x) // 6 for x in payload])
        word = np.zeros((sizes.sum(), 8), np.uint8)
        word[:, :6] = np.frombuffer(b"".join(payload), np.uint8).reshape(-1, 6)
        word = word.view("<u8").ravel()
        chunk, h, code = np.repeat(t.column("chunk").to_numpy(), sizes), word >> U64(4), (word & U64(15)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, chunk, code = h[order], chunk[order], code[order]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[head, len(h)])
        shared = (size > 1) | (code[head] > 0)
        often = np.add.reduceat(1 << code, head) > hot
        word = (h | np.repeat(often, size).astype(U64) << U64(63))[np.repeat(shared, size)]
        out = [(c, word[at].tobytes()) for c, at in groups(chunk[np.repeat(shared, size)])]
        return packed([c for c, _ in out], key[0].as_py(), [p for _, p in out])

    return decide


def _encode(contexts: dict[tuple[int, bytes], list[int]], doc: np.ndarray, places: np.ndarray, rows: np.ndarray) -> bytes:
    """Contexts with their group (minimiser), and of each its occurrences: doc_id, row and place."""
    own = list(contexts)
    occ = np.fromiter((i for x in contexts.values() for i in x), np.int64)
    parts = [np.array([len(own), len(occ)], "<i8"), np.array([g for g, _ in own], "<u8"), np.array([len(c) for _, c in own], "<u4"), np.array([len(x) for x in contexts.values()], "<u4"), doc[rows[occ]].astype("<i8"), rows[occ].astype("<u4"), places[occ].astype("<u4")]
    return zstandard.compress(b"".join([*(x.tobytes() for x in parts), *(c for _, c in own)]), 1)


def _decode(p: bytes) -> tuple[np.ndarray, ...]:
    p = zstandard.decompress(p)
    n, m = np.frombuffer(p, "<i8", 2).tolist()
    at, out = 16, []
    for kind, k in (("<u8", n), ("<u4", n), ("<u4", n), ("<i8", m), ("<u4", m), ("<u4", m)):
        out.append(np.frombuffer(p, kind, k, at))
        at += k * out[-1].itemsize
    return *out, np.frombuffer(p, np.uint8, -1, at)


def _send_contexts(n: int):  # noqa: ANN202
    def send(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        _, doc, raw = in_order(t)
        text = b"".join(raw)
        buf, at = np.frombuffer(text, np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        h, first, count, row = run_minima(buf, at)
        bucket = bucket_of(h, n)
        known = [np.frombuffer(p, "<u8") for p in answers.column("payload").to_pylist()]
        dealt: dict[int, dict[tuple[int, bytes], list[int]]] = {}
        places, rows = [], []
        if known and len(h):
            tags = np.concatenate([tag_of(np.full(len(x), b), x) for b, x in zip(answers.column("bucket").to_pylist(), known, strict=True)])
            often = np.concatenate(known) >> U64(63) != 0
            order = np.argsort(tags)
            tags, often = tags[order], often[order]
            tag = tag_of(bucket, h)
            place = np.minimum(np.searchsorted(tags, tag), len(tags) - 1)
            hit = np.flatnonzero(tags[place] == tag)
            hot = often[place[hit]]
            i = 0
            for b, g, s, c, r in zip(bucket[hit[~hot]].tolist(), tag[hit[~hot]].tolist(), first[hit[~hot]].tolist(), count[hit[~hot]].tolist(), row[hit[~hot]].tolist(), strict=True):
                dealt.setdefault(b, {}).setdefault((g, text[s : s + c + SPAN - 1]), []).append(i)
                places.append(s - at[r])
                rows.append(r)
                i += 1
            hot = hit[hot]
            starts = np.repeat(first[hot] - np.r_[0, np.cumsum(count[hot])[:-1]], count[hot]) + np.arange(count[hot].sum()) if len(hot) else hot
            for s, r in zip(starts.tolist(), np.repeat(row[hot], count[hot]).tolist(), strict=True):
                w = text[s : s + SPAN]
                g = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                dealt.setdefault(g % n, {}).setdefault((g, w), []).append(i)
                places.append(s - at[r])
                rows.append(r)
                i += 1
        places, rows = np.array(places, np.int64), np.array(rows, np.int64)
        return packed(key[0].as_py(), list(dealt), [_encode(x, doc, places, rows) for x in dealt.values()])

    return send


def _match(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    trim()
    chunks = t.column("chunk").to_numpy()
    group, size, times, doc, row, place, text = (list(x) for x in zip(*map(_decode, t.column("payload").to_pylist()), strict=True))
    chunk = np.repeat(chunks, [len(x) for x in doc])
    group, size, times, doc, row, place, text = (np.concatenate(x) for x in (group, size, times, doc, row, place, text))
    ends = np.cumsum(size.astype(np.int64))
    ctx = np.repeat(np.arange(len(size)), times)  # of each occurrence
    raw = text.tobytes()
    seen: dict[tuple[int, bytes], int] = {}
    same = np.array([seen.setdefault((g, raw[e - s : e]), len(seen)) for g, s, e in zip(group.tolist(), size.tolist(), ends.tolist(), strict=True)], np.int64)
    k = len(seen)
    one = np.zeros(k, np.int64)
    one[same[::-1]] = np.arange(len(same))[::-1]
    owner = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(owner, same[ctx], doc)
    unique, gid, members = np.unique(group[one], return_inverse=True, return_counts=True)
    varied = members[gid] > 1
    occ_ctx = same[ctx]
    later = doc > owner[occ_ctx]  # the whole context also stands in an earlier document
    plain = ~varied[occ_ctx] & later
    spans = [(chunk[plain], row[plain], place[plain].astype(np.int64), place[plain] + size[one][occ_ctx[plain]].astype(np.int64))]
    todo = np.flatnonzero(varied)
    todo = todo[np.argsort(gid[todo], kind="stable")]
    upto = np.cumsum(size[one[todo]].astype(np.int64))
    by_ctx = np.argsort(occ_ctx, kind="stable")
    starts = np.searchsorted(occ_ctx[by_ctx], np.arange(k + 1))
    i = 0
    while i < len(todo):
        j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SORTED, "right"))
        j = max(j, i + 1)
        while j < len(todo) and gid[todo[j]] == gid[todo[j - 1]]:  # a group is never cut
            j += 1
        own = todo[i:j]
        piece = np.frombuffer(b"".join(raw[ends[c] - size[c] : ends[c]] for c in one[own].tolist()), np.uint8)
        n_win = size[one[own]].astype(np.int64) - SPAN + 1
        base = np.r_[0, np.cumsum(n_win + SPAN - 1)][:-1]
        win = np.repeat(base - np.r_[0, np.cumsum(n_win)[:-1]], n_win) + np.arange(n_win.sum())
        order = np.argsort(classes(piece)[win], kind="stable")
        previous = np.empty(len(win), bool)
        previous[order] = longest_previous(np.repeat(owner[own], n_win)[order], common_prefixes(loads(piece), win[order])) >= SPAN
        at = np.r_[0, np.cumsum(n_win)]
        slot = np.full(k, -1)
        slot[own] = np.arange(len(own))
        occ = np.concatenate([by_ctx[starts[c] : starts[c + 1]] for c in own.tolist()])
        s = slot[occ_ctx[occ]]
        for a in range(0, len(occ), 1 << 16):
            o, c = occ[a : a + (1 << 16)], s[a : a + (1 << 16)]
            each = n_win[c]
            off = np.arange(each.sum()) - np.repeat(np.r_[0, np.cumsum(each)[:-1]], each)
            whose = np.repeat(np.arange(len(o)), each)
            gone = previous[at[c][whose] + off] | later[o][whose]
            edge = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (whose[1:] == whose[:-1])])
            last = np.flatnonzero(gone & ~np.r_[gone[1:] & (whose[1:] == whose[:-1]), False])
            w = o[whose[edge]]
            spans.append((chunk[w], row[w], place[w] + off[edge], place[w] + off[last] + SPAN))
        i = j
    chunk, row, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    out = [(c, np.stack([row[at], start[at], end[at]], 1).astype("<u4").tobytes()) for c, at in groups(chunk)]
    return packed([c for c, _ in out], key[0].as_py(), [p for _, p in out])


def _remove(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
    trim()
    ids, _, raw = in_order(t)
    size = np.array([len(x) for x in raw], np.int64)
    at = np.r_[0, np.cumsum(size)]
    cover = np.zeros(at[-1] + 1, np.int32)
    for p in answers.column("payload").to_pylist():
        row, start, end = np.frombuffer(p, "<u4").reshape(-1, 3).T.astype(np.int64)
        np.add.at(cover, at[row] + start, 1)
        np.add.at(cover, at[row] + end, -1)
    gone = np.cumsum(cover[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = at[:-1][size > 0]
    begins[heads] = gone[heads]
    total = lambda x: np.diff(np.r_[0, np.cumsum(x)][at]).astype(np.int64)
    removed, spans = total(gone), total(begins)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    kept = [r if not n else buf[s:e][~gone[s:e]].tobytes() for r, n, s, e in zip(raw, removed.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept": pa.array(kept, pa.binary())})


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row of ``docs``."""
    rows, n = chunked(docs)
    shared = rows.groupBy("chunk").applyInArrow(_send_minima(n), PACKED).groupBy("bucket").applyInArrow(_shared_minima(hot), PACKED)
    contexts = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_contexts(n), PACKED)
    removed = contexts.groupBy("bucket").applyInArrow(_match, PACKED)
    return rows.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
