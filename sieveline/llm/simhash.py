"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit set where over half of its word shingles' 64-bit hashes have it.  Distinct fingerprints are
dealt into shards; each shard is a BK-tree, children keyed by their integer Hamming distance to the parent, and a query
follows only the edges within the radius of its own distance.  Trees of many shards are built and walked at once, level by
level.  A shard's tree and its queries travel together by the shard's key, since their size grows with the data and so
cannot be broadcast.

Two ways to deal: ``blocks`` is exact for a small radius (fingerprints within it agree on some of the blocks of bits;
blocks and agreeing picks follow the number of fingerprints).  ``bands`` is for near copies by shared shingles: a node is a
distinct set of shingle hashes with the fingerprint of that set, dealt by its smallest permuted hashes, so that a pair of
Jaccard similarity s meets but for (1 - s) ** BANDS of them.  The shard's BK-tree finds partners within ``radius``, sketches
drop those that cannot be alike, and the groups of what is left are compared by their sets, which are made again from the
texts of those alone: a pair links if the exact similarity of its sets is ``ALIKE`` or more.

A shard beyond ``TILE`` fingerprints is cut into slices (TILES at most) that meet in pairs of their own.  A shard beyond
``CROWD`` sets (``ROOM`` hashes) is cut into slices that first link within themselves; then only the sets outside the shard's
largest linked group, in blocks, meet all slices, so that rows stay linear in a dense group of any number of texts.

Links within a shard come out as one star a group, never as all pairs; groups are joined by alternating large and small
stars, cut by checkpoints.  Hubs, shard keys and fingerprints that hold a thousandth of the rows are joined by broadcasting
what belongs to them, a thousand rows at most.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; texts of fewer words than a
shingle hash as a whole; equal fingerprints (with bands: equal sets) are one node, so repeated rows cost nothing; rows whose
doc_id is null link like any other but name a group only if it has no doc_id at all; exactly one row of a group is its
representative, repeated doc_ids or not; an empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, among, cut, join_heavy, loads, numbered, packed, parts, release, rows_of, slices, span_hashes, stored, text_bytes, texts, token_runs, tidy
from .decontam import LOWER
from .decontam import fold as words_fold

SEED, BANDS, TILE, TILES = 42, 8, 1024, 64
#: Fingerprints that meet in one walk of the trees.
WALK = 1 << 20
#: Near copies by bands: the least Jaccard similarity, as a fraction; the sets and hashes of a slice; exact comparisons at once.
ALIKE, CROWD, ROOM, NEAREST = (4, 5), 4096, 1 << 19, 32
#: Bins of a sketch, and the least share of agreeing ones; a pair of similarity 0.8 falls short of it by six standard errors.
BINS, AGREE = 256, 0.65
EDGES = np.arange(BINS, dtype=U64) << U64(56)
TURNS = np.random.default_rng(5).integers(1, 2**63, BANDS).astype(U64) | U64(1)
SHOWN = np.ones(256, np.uint8)
SHOWN[[9, 10, 11, 12, 13, 32]] = 0


def shingle_hashes(raw: bytes, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of an ASCII-lower-cased text."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, U64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], U64)
    joined, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    one = xxhash.xxh64_intdigest
    start, out = 0, []
    for i in range(k - 1, len(ends)):
        out.append(one(joined[start : ends[i]], SEED))
        start = ends[i - k + 1] + 1
    return np.array(out, U64)


def fold(h: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def sketch(h: np.ndarray) -> bytes:
    """A byte of the smallest hash in each of BINS ranges of hashes; zero where a range has none."""
    out = np.zeros(BINS, np.uint8)
    if len(h):
        own = np.sort(h * TURNS[0])
        at = np.searchsorted(own, EDGES)
        full = np.flatnonzero(at < np.r_[at[1:], len(own)])
        out[full] = (own[at[full]] * TURNS[1] >> U64(32)) % U64(255) + U64(1)
    return out.tobytes()


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of ``a`` and ``b``) estimate a Jaccard similarity of AGREE or more; two empty ones do."""
    return ((a == b) & (a > 0)).sum(1) >= AGREE * ((a | b) > 0).sum(1)


def sets_of(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its distinct k-word shingles (of fewer words: of the whole), in order; any good hash serves."""
    buf, at = text_bytes(text)
    for i, j in slices(at, 1 << 20):
        low = LOWER[buf[at[i] : at[j]]]
        start, length, first = token_runs(SHOWN[low], at[i : j + 1] - at[i])
        words = span_hashes(loads(low), start, length)
        whole = words_fold(words, k)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(whole[s : e - k + 1]) if e - s >= k else words_fold(words[s:e], e - s) if e > s else words[:0]


def fingerprints(rows: DataFrame, k: int = 3, bands: int = 0) -> DataFrame:
    """number, doc_id and fp (as a signed long) of every row; with bands also their keys, and digest, size and sketch of its set."""
    schema = "number long, doc_id long, fp long" + ", bands array<long>, digest binary, size long, sketch binary" * bool(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column("number"), b.column("doc_id")]
            if not bands:
                buf, at = text_bytes(b.column("text"))
                raw = buf.tobytes()
                columns.append(pa.array([fold(shingle_hashes(raw[s:e], k)) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()))
            else:
                fp, keys, digests, sizes, sketches = [], [], [], [], []
                for own in sets_of(b.column("text"), k):
                    turned = own[:, None] * TURNS[:bands]
                    fp.append(fold(own))
                    keys.append((turned ^ (turned >> U64(31))).min(0).view(np.int64) if len(own) else np.zeros(bands, np.int64))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    sketches.append(sketch(own))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fp) * bands + 1, bands), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                columns += [pa.array(fp, pa.int64()), lists, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(tidy(run), schema)


def shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """node (the row's number) and set (its hashes in order, eight bytes each) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                made = [x.tobytes() for x in sets_of(b.column("text").slice(i, 1000), k)]
                yield pa.record_batch([b.column("number").slice(i, len(made)), pa.array(made, pa.binary())], names=["node", "set"])

    return rows.mapInArrow(tidy(run), "node long, set binary")


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of each range [low, high), and which range each is of."""
    size = high - low
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of], of


class BKTrees:
    """The BK-trees of consecutive shards of fingerprints: ``keys`` in order of shard, ``cuts`` their bounds.

    Every place in ``keys`` is a node.  All trees grow by one level at a time: of the fingerprints that wait at an edge
    (parent, distance), the first becomes the child and the others wait at its edges.  Edges are held sorted by parent and
    distance, so that the edges within a radius are one range.  An equal fingerprint hangs at distance 0.
    """

    def __init__(self, keys: np.ndarray, cuts: np.ndarray) -> None:
        self.keys, self.root = keys, np.repeat(cuts[:-1], np.diff(cuts))
        wait = np.flatnonzero(self.root != np.arange(len(keys)))
        parent, edges, children = self.root[wait], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(wait):
            edge = parent * 65 + np.bitwise_count(keys[wait] ^ keys[parent])
            order = np.argsort(edge, kind="stable")
            edge, wait = edge[order], wait[order]
            head = np.r_[True, edge[1:] != edge[:-1]]
            edges.append(edge[head])
            children.append(wait[head])
            parent = np.repeat(wait[head], np.diff(np.r_[np.flatnonzero(head), len(wait)]))[~head]
            wait = wait[~head]
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of places of one shard at most ``radius`` apart, the queries themselves included."""
        node = self.root[queries]
        while len(queries):
            far = np.bitwise_count(self.keys[queries] ^ self.keys[node]).astype(np.int64)
            hit = far <= radius
            yield queries[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(far + radius, 64), "right")
            at, of = spread(low, high)
            queries, node = queries[of], self.child[at]

    def walks(self, cuts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b), a > b, of all shards, so many queries at once that about WALK nodes can be visited."""
        load = np.cumsum(np.repeat(np.diff(cuts), np.diff(cuts)))
        i = 0
        while i < len(load):
            j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + WALK)))
            for a, b in self.near(np.arange(i, min(j, len(load))), radius):
                yield a[a > b], b[a > b]
            i = j


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of each place the first place known of its group) with the groups of the pairs (a, b) joined."""
    live = label[a] != label[b]
    a, b = a[live], b[live]
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (label[label] != label).any():
            label = label[label]
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def linked_groups(keys: np.ndarray, cuts: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of each shard the first place of its linked group."""
    label = np.arange(len(keys))
    for a, b in BKTrees(keys, cuts).walks(cuts, radius):
        label = join(label, a, b)
    return label


def maybe_groups(keys: np.ndarray, cuts: np.ndarray, radius: int, size: np.ndarray, sketches: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each set of each shard the first place of its group, where sets link that may be alike by fingerprint, size and
    sketch; ``group`` numbers groups that are linked already."""
    p, q = ALIKE
    shard = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((group, shard))
    head = np.r_[True, (group[order][1:] != group[order][:-1]) | (shard[order][1:] != shard[order][:-1])]
    label = np.empty(len(keys), np.int64)
    label[order] = np.repeat(order[head], np.diff(np.r_[np.flatnonzero(head), len(order)]))
    for a, b in BKTrees(keys, cuts).walks(cuts, radius):
        new = (label[a] != label[b]) & (q * np.minimum(size[a], size[b]) >= p * np.maximum(size[a], size[b]))
        a, b = a[new], b[new]
        for i in range(0, len(a), 1 << 13):
            x, y = a[i : i + (1 << 13)], b[i : i + (1 << 13)]
            new = label[x] != label[y]
            x, y = x[new], y[new]
            both = agree(sketches[x], sketches[y])
            label = join(label, x[both], y[both])
    return label


def alike_groups(flat: np.ndarray, at: np.ndarray, fp: np.ndarray, radius: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each set of a shard (``at`` bounds them in ``flat``) a number of its linked group, by exact similarity.

    ``group`` numbers groups that are linked already.  A set is compared with its nearest fingerprints first and never with
    members of its own group, so a dense group takes few comparisons a set.
    """
    p, q = ALIKE
    n, size = len(at) - 1, np.diff(at)
    order = np.argsort(size, kind="stable")
    size, fp = size[order], fp[order]
    label = np.arange(n) if group is None else np.unique(group, return_inverse=True)[1][order]
    start = at[:-1][order]
    ids = np.unique(flat, return_inverse=True)[1]
    low, mark = np.searchsorted(q * size, p * size), np.zeros(len(flat) + 1, bool)
    for i in range(1, n):
        if low[i] >= i or not size[i]:
            continue
        far = np.bitwise_count(fp[low[i] : i] ^ fp[i])
        near = np.flatnonzero((far <= radius) & (label[low[i] : i] != label[i]))
        near = near[np.argsort(far[near], kind="stable")] + low[i]
        own = ids[start[i] : start[i] + size[i]]
        mark[own] = True
        while len(near):
            few, near = near[:NEAREST], near[NEAREST:]
            places, _ = spread(start[few], start[few] + size[few])
            common = np.add.reduceat(mark[ids[places]], np.cumsum(size[few]) - size[few], dtype=np.int64)
            for x in np.unique(label[few[(p + q) * common >= p * (size[few] + size[i])]]).tolist():
                label[label == x] = label[i]
            near = near[label[near] != label[i]]
        mark[own] = False
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def _block_keys(count: int, radius: int) -> list[Column]:
    """Shard keys under which fingerprints within ``radius`` meet: all picks of agreeing blocks."""
    bits = max(1, count).bit_length()
    blocks = next((m for m in range(radius + 1, radius + 4) if 64 * (m - radius) // m >= bits - 3), radius + 4)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for n, pick in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in pick)
        out.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return out


def _whole(batches: Iterator[pa.RecordBatch], key: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``key``, about ``most`` rows or one group each, and the bounds of their groups."""

    def cuts_of(t: pa.Table) -> np.ndarray:
        k = np.stack([t.column(c).to_numpy() for c in key], 1)
        return np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        cuts = cuts_of(t)
        if len(cuts):
            yield t.slice(0, int(cuts[-1])), np.r_[0, cuts].astype(np.int64)
            t = t.slice(int(cuts[-1]))
        held, rows = t.to_batches(), 0 if len(cuts) else t.num_rows
    t = pa.Table.from_batches(held) if held else None
    if t is not None and t.num_rows:
        yield t, np.r_[0, cuts_of(t), t.num_rows].astype(np.int64)


def _stars(node: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one of its group, itself left out."""
    order = np.lexsort((node, group))
    head = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    least = np.repeat(node[order[head]], np.diff(np.r_[head, len(order)]))
    far = node[order] != least
    return node[order][far], least[far]


def _dealt(df: DataFrame, key: list[str]) -> DataFrame:
    return df.repartition(parts(df), *key).sortWithinPartitions(*key)


def _links(keyed: DataFrame, radius: int, total: int | None = None) -> DataFrame:
    """Rows of key, fp and node in; stars (a, b), a > b, of the groups of every shard out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _whole(batches, ["key", "i", "j"], 1 << 15):
            a, b = _stars(t.column("node").to_numpy(), linked_groups(t.column("fp").to_numpy().view(U64), cuts, radius))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    dealt = join_heavy(keyed, sizes, ["key"], "n", keyed.count() if total is None else total).withColumn("s", F.least(F.ceil(F.col("n") / TILE), F.lit(TILES)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    tiles = F.when(F.col("s") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"))))
    dealt = dealt.withColumn("t", F.explode(tiles)).select("key", F.col("t.i").cast("long").alias("i"), F.col("t.j").cast("long").alias("j"), "fp", "node")
    return _dealt(dealt, ["key", "i", "j"]).mapInArrow(tidy(run), "a long, b long")


def _in_slices(shards: DataFrame, held: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Stars (a, b) that ``run`` finds among the nodes of each shard: ``shards``, a stored table, has key, node and s, the
    number of slices that the shard is cut into, and ``held`` what ``run`` needs of each node.

    Slices first link within themselves.  Of shards of several slices, only the nodes outside the shard's largest linked
    group, in blocks of ``CROWD``, then meet all slices; ``run`` compares no two nodes of one label.
    """
    own, key = F.pmod(F.xxhash64("node", "key"), F.col("s")), ["key", "i", "j"]
    first = shards.select("key", own.alias("i"), F.lit(0).cast("long").alias("j"), "node", F.col("node").alias("label")).join(held, "node")
    links = _dealt(first, key).mapInArrow(tidy(run), "a long, b long")
    wide = shards.where("s > 1")
    if wide.isEmpty():
        return links
    links = cut(links)
    wide = cut(wide.join(components(links), "node", "left").select("key", "node", "s", F.coalesce("label", "node").alias("label")))
    largest = wide.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("n"))
    wide = join_heavy(wide, largest, ["key"], "n", wide.count())
    blocks = F.ceil((F.col("n") - F.col("top.m")) / CROWD).cast("long")
    outside = F.col("label") != F.col("top.label")
    tile = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    block = F.pmod(F.xxhash64(F.lit(1), "node"), F.greatest(blocks, F.lit(1)))
    mine = F.transform(F.sequence(F.lit(1).cast("long"), blocks), lambda j: tile(own, j))
    asked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda i: tile(i, block + 1))
    tiles = F.when(blocks < 1, F.array().cast("array<struct<i:bigint,j:bigint>>")).when(outside, F.array_distinct(F.concat(mine, asked))).otherwise(mine)
    second = wide.withColumn("t", F.explode(tiles)).select("key", "t.i", "t.j", "node", "label").join(held, "node")
    return links.unionByName(_dealt(second, key).mapInArrow(tidy(run), "a long, b long"))


def _alike_links(rows: DataFrame, k: int, radius: int, nodes: DataFrame, total: int, held: list[str] | None = None) -> DataFrame:
    """Stars (a, b), a > b, of the groups of sets that share a band and are alike; ``nodes`` has one row a set.

    Shards by band first find what may be alike, from fingerprints and sketches; the linked groups of that are the shards
    of the exact comparison, so each set travels once.
    """

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _whole(batches, ["key", "i", "j"], 1 << 13):
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            node, fp, size, label = (t.column(c).to_numpy() for c in ("node", "fp", "size", "label"))
            a, b = _stars(node, maybe_groups(fp.view(U64), cuts, radius, size, sketches, label))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _whole(batches, ["key", "i", "j"], 1 << 12):
            node, fp, label = (t.column(c).to_numpy() for c in ("node", "fp", "label"))
            sets = t.column("set")
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                raw = sets.slice(s, e - s).to_pylist()
                at = np.r_[0, np.cumsum([len(x) // 8 for x in raw])]
                a, b = _stars(node[s:e], alike_groups(np.frombuffer(b"".join(raw), U64), at, fp[s:e].view(U64), radius, label[s:e]))
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    keyed = nodes.select("node", F.posexplode("bands").alias("p", "v")).select(F.xxhash64("p", "v").alias("key"), "node")
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shards = cut(join_heavy(keyed, crowds, ["key"], "n", total).select("key", "node", F.ceil(F.col("n") / CROWD).cast("long").alias("s")))
    groups = cut(with_labels(components(_in_slices(packed(shards, total), nodes.select("node", "fp", "size", "sketch"), maybe))))
    linked = groups.count()
    groups = packed(groups, linked)
    alone = groups.select(F.col("node").alias("number"))
    sets = stored(shingle_sets(among(rows, alone, "left_semi"), k).join(nodes.select("node", "fp"), "node"), held)
    crowds = groups.join(nodes.select("node", "size"), "node").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    slices_of = F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("hashes") / ROOM)).cast("long")
    shards = cut(packed(join_heavy(groups, crowds, ["label"], "n", linked).select(F.col("label").alias("key"), "node", slices_of.alias("s")), linked))
    return _in_slices(shards, sets, exact)


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node reaches, by alternating large and small stars.

    Links lead down (a > b), so the least of a node's neighbours is known from the links that begin at it, and all is done
    when each node begins one link, to a node that begins none.
    """
    edges, total = cut(links.distinct()), None
    while True:
        begins, ends = F.struct(F.col("a").alias("node"), F.col("b").alias("m"), F.lit(0).alias("n")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("m"), F.lit(1).alias("n"))
        nodes = edges.select(F.explode(F.array(begins, ends)).alias("e")).groupBy("e.node").agg(F.min("e.m").alias("m"), F.sum("e.n").alias("n"), F.count("e.m").alias("up"))
        nodes = cut(nodes if total is None else packed(nodes, total))
        state = nodes.agg(F.sum("n").alias("n"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("n") > 0)).alias("open")).first()
        if not state["open"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        total = state["n"]
        low = packed(nodes, total).where("n > 0").select(F.col("node").alias("b"), F.coalesce("m", "node").alias("m"), "n")
        large = join_heavy(packed(edges, total), low, ["b"], "n", total).select("a", F.col("m").alias("b"))
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where(F.col("a") != F.col("b")).distinct()
        edges = cut(packed(small, total))


def with_labels(groups: DataFrame) -> DataFrame:
    """node, label of ``components``, with a row for each label too."""
    both = F.array(F.struct("node", "label"), F.struct(F.col("label").alias("node"), "label"))
    return groups.select(F.explode(both).alias("e")).select("e.*").distinct()


def _classes(rows: DataFrame, k: int, radius: int, bands: int, held: list[str] | None = None) -> DataFrame:
    """number, doc_id, fp and the representative (nameless, doc_id, number) of every row's group; ``held`` gets the paths of
    the tables that were stored for it."""
    keep = (lambda df: stored(df, held)) if bands else cut
    by = "digest" if bands else "fp"
    members = keep(fingerprints(rows, k, bands))
    more = [F.first(c).alias(c) for c in ("fp", "bands", "size", "sketch")] if bands else []
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "number")).alias("best")
    nodes = keep(members.groupBy(by).agg(F.min("number").alias("node"), best, F.count(F.lit(1)).alias("n"), *more))
    whole = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if bands:
        links = _alike_links(rows, k, radius, nodes, whole["nodes"] * bands, held)
    else:
        keys = _block_keys(whole["nodes"], radius)
        links = _links(nodes.select("fp", "node", F.explode(F.array(*keys)).alias("key")), radius, whole["nodes"] * len(keys))
    linked = cut(nodes.select("node", "best").join(with_labels(components(links)), "node"))
    total = linked.count()
    linked = packed(linked, total)
    tops = linked.groupBy("label").agg(F.min("best").alias("top"), F.count(F.lit(1)).alias("m"))
    tops = packed(join_heavy(linked.select("node", "label"), tops, ["label"], "m", total).select("node", "top"), total)
    found = nodes.join(tops, "node", "left").select(by, F.coalesce("top", "best").alias("top"), "n")
    return join_heavy(members.select(*dict.fromkeys(["number", "doc_id", "fp", by])), found, [by], "n", whole["rows"]).select("number", "doc_id", "fp", "top")


def near_dedup(docs: DataFrame, k: int = 3, radius: int = 3, bands: int = 0) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest doc_id reachable) of every row of ``docs``."""
    rows = rows_of(numbered(docs)) if bands else texts(docs, F.monotonically_increasing_id().alias("number"))
    return _classes(rows, k, radius, bands).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("top.doc_id").alias("component_id"))


def representatives(docs: DataFrame, k: int = 3, radius: int = 3, bands: int = 0) -> DataFrame:
    """The rows of ``docs``, whole, that stand for their groups: of the smallest doc_id, one of each group."""
    rows, held = numbered(docs), []
    copies = cut(_classes(rows_of(rows), k, radius, bands, held).where(F.col("number") != F.col("top.number")).select("number"))
    release(docs.sparkSession, held)
    return among(rows, copies, "left_anti").select("row.*")
