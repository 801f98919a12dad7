"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  Each pattern supplies its words once
a repetition, every further repetition at a higher (convex) cost; each source demands its target; the cheapest flow routes
supply to quotas.  As a word's cost is the same wherever it goes, cheapest means: a maximal flow of single passes, then
augmented by second passes, and so on, so the flow is one maximal flow a repetition.  Sources that share no document take
no part in each other's flow: sources are joined into components by the patterns that overlap, each component is routed in
a task of its own, and a source that overlaps with none just takes its target.

A pattern's flow is whole passes over its documents plus a rest, and the rest goes to the documents that rank first by a
seeded hash, found by a histogram of ranks in three steps, so no pattern is ever sorted in one task.  What the first
document over the edge leaves open is filled by the largest documents that fit, ``FILLS`` times.

Patterns, sources and flows stay in tables; the driver gets sums.  A component must fit a task: about 2 KB a pattern.

Defined results: a null text has size 0 and takes 0; a null source is a source that sorts last; a document of no source
takes 0; rows that repeat both doc_id and text are taken or left together; an empty table gives an empty result; reruns
agree; columns beyond doc_id, text and the sources are ignored, and ``mixed`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_sized, numbered, packed, positions, row_sums, rows_of, text_bytes, texts, tidy
from .simhash import components, with_labels

RATIO, WEIGHTS, REPEAT, SEED, FILLS = 1.5, (3, 1, 2), 2, 11, 4
#: Ranks are hashes of RANK bits, looked at DIGIT bits at a time.
RANK, DIGIT = 60, 12
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def sizes(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """number, doc_id, sources, key (the pattern as text), size (words between white space) and seeded rank of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = text_bytes(b.column("text"))
            n = np.zeros(b.num_rows)
            if len(buf):
                full = ~BLANK[buf]
                begins = full.copy()
                begins[1:] &= ~full[:-1]
                heads = at[:-1][np.diff(at) > 0]
                begins[heads] = full[heads]
                n = row_sums(np.ones(int(begins.sum()), np.int8), np.searchsorted(np.flatnonzero(begins), at))
            kept = ["number", "doc_id", "sources", "key", "rank"]
            yield pa.record_batch([*map(b.column, kept), pa.array(n.astype(np.int64))], names=[*kept, "size"])

    rank = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), 64 - RANK)
    rows = rows.withColumn("sources", F.array_sort(F.array_distinct("sources"))).withColumn("key", F.to_json(F.struct("sources"))).withColumn("rank", rank)
    return rows.select("number", "doc_id", "sources", "key", "rank", "text").mapInArrow(tidy(count), "number long, doc_id long, sources array<string>, key string, rank long, size long")


def targets(own: DataFrame, ratio: float, weights: tuple[int, ...], repeat: int, total: int) -> DataFrame:
    """``own`` (source, size) with place and target: shares of ratio x total by weight; a share stops at repeat x its source,
    and the excess is shared again."""
    own = positions(own, F.col("source").asc_nulls_last())
    own = cut(own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))))
    cap, free, left = F.lit(float(repeat)) * F.col("size"), F.lit(True), float(ratio * total)
    share = F.lit(0.0)
    known = own.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    own, whole = packed(own, known["n"]), known["w"]
    while whole:
        share = F.lit(left) * F.col("weight") / F.lit(float(whole))
        stop = own.where(free & (share > cap)).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("weight").alias("w")).first()
        if not stop["n"]:
            break
        free = free & (share <= cap)
        left = max(0.0, left - float(repeat) * stop["size"])
        whole -= stop["w"]
    return own.withColumn("target", F.when(free, share).otherwise(cap))


def route(supply: list[int], member: list[list[int]], demand: list[int], repeat: int) -> list[list[int]]:
    """Min-cost flow from patterns to sources: words that each pattern gives to each of its sources.

    One maximal flow a repetition, by blocking flows in levels; the r-th repetition of a pattern costs 2 r - 1 a word.
    """
    p, s = len(supply), len(demand)
    to, room, first = [], [], [[] for _ in range(p + s)]
    for i in range(p):
        for j in member[i]:
            first[i].append(len(to))
            first[p + j].append(len(to) + 1)
            to += [p + j, i]
            room += [repeat * supply[i], 0]
    stock, need = [0] * p, list(demand)
    for _ in range(repeat):
        stock = [x + n for x, n in zip(stock, supply, strict=True)]
        while True:
            level = [-1] * (p + s)
            wave = [i for i in range(p) if stock[i]]
            for i in wave:
                level[i] = 0
            reached = False
            while wave and not reached:
                after = []
                for x in wave:
                    for e in first[x]:
                        y = to[e]
                        if room[e] and level[y] < 0:
                            level[y] = level[x] + 1
                            after.append(y)
                            reached |= y >= p and need[y - p] > 0
                wave = after
            if not reached:
                break
            turn = [0] * (p + s)
            for i in range(p):
                while stock[i]:  # one path at a time, along edges that lead one level on
                    path, x = [], i
                    while not (x >= p and need[x - p] and path):
                        if turn[x] < len(first[x]):
                            e = first[x][turn[x]]
                            if room[e] and level[to[e]] == level[x] + 1:
                                path.append(e)
                                x = to[e]
                            else:
                                turn[x] += 1
                        elif path:
                            x = to[path.pop() ^ 1]
                            turn[x] += 1
                        else:
                            break
                    if not path:
                        break
                    flow = min(stock[i], need[x - p], *(room[e] for e in path))
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    stock[i] -= flow
                    need[x - p] -= flow
    return [[room[e ^ 1] for e in own] for own in first[:p]]


def _routed(patterns: DataFrame, sources: DataFrame, repeat: int) -> DataFrame:
    """key and flow of every pattern: ``patterns`` has key, sources and size, ``sources`` place and target."""
    member = patterns.select("key", "size", F.posexplode("sources").alias("i", "source"))
    member = member.join(sources.select(F.col("source").alias("own"), "place", "target"), F.col("source").eqNullSafe(F.col("own"))).select("key", "size", "place", "target")
    lead = member.groupBy("key").agg(F.min("place").alias("b"), F.count(F.lit(1)).alias("n"))
    overlapping = lead.where("n > 1").select("key", "b")
    want = F.floor(F.col("target") + 0.5).cast("long")
    if overlapping.isEmpty():
        return member.select("key", want.alias("flow"))
    member = cut(member)
    groups = components(member.join(overlapping, "key").where("place > b").select(F.col("place").alias("a"), "b"))
    groups = cut(with_labels(groups))
    held = member.join(groups, member["place"] == groups["node"], "left").select("key", "size", "place", want.alias("want"), "label")

    def flow(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("key", "size", "place", "want")), strict=True))
        keys, places = sorted({r[0] for r in rows}), sorted({r[2] for r in rows})
        at, of = {k: i for i, k in enumerate(keys)}, {p: i for i, p in enumerate(places)}
        supply, demand, lists = [0] * len(keys), [0] * len(places), [[] for _ in keys]
        for k, n, p, w in rows:
            supply[at[k]], demand[of[p]] = n, w
            lists[at[k]].append(of[p])
        return pa.table({"key": pa.array(keys, pa.string()), "flow": pa.array([sum(x) for x in route(supply, lists, demand, repeat)], pa.int64())})

    shared = held.where("label IS NOT NULL").groupBy("label").applyInArrow(flow, "key string, flow long")
    return held.where("label IS NULL").select("key", F.col("want").alias("flow")).unionByName(shared)


def _taken(rows: DataFrame, ratio: float, weights: tuple[int, ...], repeat: int, seed: int) -> tuple[DataFrame, DataFrame]:
    rows = cut(sizes(rows, seed))
    patterns = cut(rows.groupBy("key").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    whole = patterns.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("patterns")).first()
    few = whole["patterns"]
    patterns = packed(patterns, few)
    own = patterns.select("size", "n", F.explode("sources").alias("source")).groupBy("source").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    sources = cut(targets(own, ratio, weights, repeat, whole["size"]))
    state = patterns.join(_routed(patterns, sources, repeat), "key", "left").withColumn("flow", F.coalesce("flow", F.lit(0)))
    passes = F.when(F.col("size") > 0, F.floor(F.col("flow") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    state = state.withColumn("whole", passes).select("key", "n", "whole", (F.col("flow") - F.col("whole") * F.col("size")).alias("rest"), F.lit(0).cast("long").alias("low"), F.array().cast("array<bigint>").alias("fills"), F.array().cast("array<bigint>").alias("shut"))
    state = cut(packed(state, few))
    known = lambda: join_sized(rows, state, ["key"], "n", whole["n"], few)
    for step in (1, 2, 3):  # ranks below ``low`` are taken; the last step looks at single ranks
        shift, span = RANK - DIGIT * step if step < 3 else 0, RANK - DIGIT * (step - 1)
        near = known().where((F.col("rest") > 0) & (F.col("rank") >= F.col("low")) & (F.shiftright(F.col("rank") - F.col("low"), span) == 0))
        hist = near.groupBy("key", "rest", F.shiftright("rank", shift).alias("digit")).agg(F.sum("size").alias("m"))
        hist = hist.withColumn("upto", F.sum("m").over(Window.partitionBy("key").orderBy("digit")))
        if step < 3:
            edge = hist.where(F.col("upto") > F.col("rest")).groupBy("key").agg(F.min(F.struct("digit", (F.col("upto") - F.col("m")).alias("before"))).alias("e")).select("key", "e.digit", "e.before")
        else:
            edge = hist.where(F.col("upto") <= F.col("rest")).groupBy("key").agg((F.max("digit") + 1).alias("digit"), F.max("upto").alias("before"))
        state = state.join(edge, "key", "left").select("key", "n", "whole", (F.col("rest") - F.coalesce("before", F.lit(0))).alias("rest"), F.coalesce(F.shiftleft("digit", shift), "low").alias("low"), "fills", "shut")
        state = cut(packed(state, few))
    for _ in range(FILLS):
        fit = known().where((F.col("rank") >= F.col("low")) & F.col("size").between(1, F.col("rest")) & ~F.array_contains("fills", F.col("rank")) & ~F.array_contains("shut", F.col("rank")))
        best = cut(packed(fit.groupBy("key").agg(F.max(F.struct("size", "rank")).alias("b"), F.count(F.lit(1)).alias("n")).select("key", "n", F.col("b.rank").alias("at")), few))
        if best.isEmpty():
            break
        alike = join_sized(rows, best, ["key"], "n", whole["n"]).where(F.col("rank") == F.col("at")).groupBy("key", "at").agg(F.sum("size").alias("m"))
        fits = F.coalesce(F.col("m") <= F.col("rest"), F.lit(False))
        added = lambda to, when: F.when(when, F.concat(to, F.array("at"))).otherwise(F.col(to)).alias(to)
        state = state.join(alike, "key", "left").select("key", "n", "whole", (F.col("rest") - F.when(fits, F.col("m")).otherwise(0)).alias("rest"), "low", added("fills", fits), added("shut", ~fits & F.col("at").isNotNull()))
        state = cut(packed(state, few))
    copies = F.col("whole") + ((F.col("rank") < F.col("low")) | F.array_contains("fills", F.col("rank"))).cast("long")
    out = known().withColumn("copies", copies).select("number", "doc_id", "sources", "key", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return out, sources.select("source", F.to_json(F.struct(F.array("source").alias("sources"))).alias("key"), F.col("size").alias("source_size"), "target", "n")


def mix(docs: DataFrame, sources: Column, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """doc_id, sources, key, size, copies and taken of every row; and source, key (of documents of this source alone),
    source_size, target and n (rows) of every source."""
    rows = texts(docs, F.monotonically_increasing_id().alias("number"), sources.cast("array<string>").alias("sources"))
    out, known = _taken(rows, ratio, weights, repeat, seed)
    return out.drop("number"), known


def mixed(docs: DataFrame, source: str = "source") -> DataFrame:
    """The rows of ``docs``, whole, that the mix takes, with size, copies and taken (mix_... where ``docs`` has such a column)."""
    rows = numbered(docs)
    own = rows_of(rows, F.array(F.col("row").getField(source).cast("string")).alias("sources"))
    taken = _taken(own, RATIO, WEIGHTS, REPEAT, SEED)[0].where("copies > 0").select("number", F.struct("size", "copies", "taken").alias("mix"))
    names = {c.lower() for c in docs.columns}
    more = [F.col("mix").getField(c).alias(f"mix_{c}" if c in names else c) for c in ("size", "copies", "taken")]
    return rows.join(taken, "number").select("row.*", *more)
