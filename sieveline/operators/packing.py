"""Budgeted packing: greedy folds over one request's ranked candidates, which misfits do not stop.

Single folds are ``aggregate`` expressions over a request's candidates, a few numbers each, so parallelism is across
requests.  The pack of all passes, whose state is the set of terms chosen so far, is a grouped map over the candidates that
``shortlist`` keeps: of all scored chunks exactly those that some pass can admit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

PER_FILE, CLAIMS, PATHS, DEPTH = 2, 24, 60, 60
CORE_HELD, DEPTH_SHARE, OVERLAP = 0.05, 0.25, 0.25
#: Sections in the order of a pack.
CATEGORIES = ["explicit", "interface", "implementation", "test", "supporting"]
ADMITTED = "array<struct<key:bigint,used:bigint>>"


def unique_chunks(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first occurrence of each chunk."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("v")).select(key, "v.*")


def per_file_cap(rows: DataFrame, request: str, path: str, key: str, most: int = PER_FILE) -> DataFrame:
    w = Window.partitionBy(request, path).orderBy(F.desc("score"), F.asc(key))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("demoted", F.col("place") > most).drop("place")


def gather(rows: DataFrame, request: str) -> DataFrame:
    """request, items: the candidates in rank order; rows have rank, key, tokens, path."""
    return rows.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("rank", "key", "tokens", "path"))).alias("items"))


def _fold(items: Column, admit) -> Column:  # noqa: ANN001
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("paths"), F.array().cast(ADMITTED).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ok = admit(acc, x)
        used = F.when(ok, acc["used"] + x["tokens"]).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.when(ok, F.array_append(acc["paths"], x["path"])).otherwise(acc["paths"]).alias("paths"), F.when(ok, F.array_append(acc["out"], F.struct(x["key"].alias("key"), used.alias("used")))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(items, start, step)["out"]


def greedy(items: Column, budget: int) -> Column:
    """Every candidate that still fits, in order."""
    return _fold(items, lambda acc, x: acc["used"] + x["tokens"] <= budget)


def claims(items: Column, budget: int, share: float, most: int = CLAIMS) -> Column:
    """Claims in order, up to a share of the budget and ``most`` of them."""
    return _fold(items, lambda acc, x: (F.size(acc["out"]) < most) & (acc["used"] + x["tokens"] <= int(min(budget, share * budget))))


def breadth(items: Column, budget: int, paths: int = PATHS) -> Column:
    """One candidate a path, within the budget less the held-back tail; a path's later candidate may fit where its first did not."""
    core = budget - int(CORE_HELD * budget)
    return _fold(items, lambda acc, x: (F.size(acc["paths"]) < paths) & ~F.array_contains(acc["paths"], x["path"]) & (acc["used"] + x["tokens"] <= core))


def tail(items: Column, taken_paths: Column, used: Column, budget: int) -> Column:
    """Paths that nothing was taken from yet, within the whole budget."""
    return _fold(items, lambda acc, x: ~F.array_contains(F.concat(acc["paths"], taken_paths), x["path"]) & (used + acc["used"] + x["tokens"] <= budget))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def demote_twins(claimed: DataFrame, request: str, term: str, key: str) -> DataFrame:
    """A claim off the task's paths is demoted if another claim of the same term is on them: an aggregate, not a self-join."""
    on = claimed.groupBy(request, term).agg(F.bool_or("on_path").alias("any_on"))
    return claimed.join(on, [request, term]).groupBy(request, key).agg(F.bool_or(~F.col("on_path") & F.col("any_on")).alias("demoted"))


def mandatory_cap(items: Column, pinned_tokens: Column, budget: int, share: float) -> Column:
    """Mandatory candidates that fit a share of the budget which the pins have already drawn on."""
    return _fold(items, lambda acc, x: pinned_tokens + acc["used"] + x["tokens"] <= int(share * budget))


def claim_list(rows: list[dict], wants_tests: bool = True) -> list[dict]:
    """Claims worth a place, in score order.  A file's first claim by symbol or test pair always counts, a further one if
    its path is named or it brings new symbol terms; a claim by path alone counts once for a file without any other."""
    strong = {r["path"] for r in rows if r["claim"] and r.get("strong", True)}
    covered: dict[str, set[str]] = {}
    out = []
    for r in rows:
        if not r["claim"] or r.get("is_test") and not wants_tests:
            continue
        known, terms = covered.get(r["path"]), set(r.get("symbol_terms") or ())
        worth = known is None
        if r.get("strong", True):
            worth |= bool(r.get("named_path")) or bool(terms - (known or set()))
        else:
            worth &= r["path"] not in strong
        if worth:
            covered.setdefault(r["path"], set()).update(terms)
            out.append(r)
    return out


def claim_order(claimed: list[dict], required: set[str] = frozenset()) -> list[dict]:
    """Required paths first; then by relevance, class of overlap and rank, with twins of claims on the task's paths last."""
    on_path = set().union(*(set(r.get("symbol_terms") or ()) for r in claimed if r.get("on_path")))
    twin = lambda r: not r.get("on_path") and bool(on_path & set(r.get("symbol_terms") or ()))
    return sorted(claimed, key=lambda r: (r["path"] not in required, twin(r), -r.get("relevance", 0.0), r.get("overlap", 3), r["rank"]))


def file_tokens(packed: DataFrame, request: str) -> DataFrame:
    """Tokens of a pack by file, and the pack's share of its budget."""
    return packed.groupBy(request, "path").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("chunks"))


def shortlist(rows: DataFrame, request: str) -> DataFrame:
    """The rows that some pass of ``pack_one`` can admit, with their rank among all of the request (score, then key).

    Pins and claims stay.  Depth looks at the first DEPTH rows that nothing else took, and claims and breadth take CLAIMS and
    PATHS at most.  Breadth and tail take one row a path: after one that did not fit only a smaller one can, as the room
    left never grows, so of each path the rows smaller than all before them stay.
    """
    order = [F.desc("score"), F.asc("key")]
    before = Window.partitionBy(request, "path").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(*order)))
    ranked = ranked.withColumns({"_least": F.min("tokens").over(before), "_pins": F.sum(F.col("pinned").cast("int")).over(Window.partitionBy(request))})
    step = F.col("_least").isNull() | (F.col("tokens") < F.col("_least"))
    return ranked.where(F.col("pinned") | F.col("claim") | (F.col("rank") <= DEPTH + CLAIMS + PATHS + F.col("_pins")) | step).drop("_least", "_pins")


def pack_one(rows: list[dict], budget: int, claim_share: float = 1.0, wants_tests: bool = True, required: set[str] = frozenset(), cutoff: float | None = None, counts: dict | None = None) -> list[tuple[int, str]]:
    """All passes over one request: pins, claims, breadth, depth, tail.  Rows come in rank order with key, path, tokens,
    score, terms, and the flags pinned and claim, and what ``claim_list`` and ``claim_order`` look at if it is known; the
    result is (key, pass) in order of admission.  ``counts``, if given, gets the diagnostics."""
    chosen: list[tuple[int, str]] = []
    used, core = 0, max(0, budget - int(CORE_HELD * budget))
    taken: set[int] = set()
    paths: set[str] = set()
    by_file: dict[str, int] = {}
    by_kind: dict[str, int] = {}
    picked_terms: list[set] = []
    spent: dict[str, int] = {}

    def take(r: dict, name: str) -> None:
        nonlocal used
        chosen.append((r["key"], name))
        taken.add(r["key"])
        used += r["tokens"]
        kind = r.get("category") or "supporting"
        for held, at in ((by_file, r["path"]), (by_kind, kind), (spent, name)):
            held[at] = held.get(at, 0) + r["tokens"]
        picked_terms.append(set(r["terms"] or ()))

    def closest(own: set) -> float:
        both = ((len(own & p), len(own) + len(p)) for p in picked_terms)
        return max((n / (total - n) for n, total in both if total > n), default=0.0)

    for r in rows:
        if r["pinned"]:
            take(r, "pin")
    claimed = claim_order(claim_list([r for r in rows if r["key"] not in taken], wants_tests), required)
    dropped = 0
    for r in claimed[:CLAIMS]:
        if used + r["tokens"] <= min(budget, claim_share * budget):
            take(r, "claim")
            paths.add(r["path"])
        else:
            dropped += 1
    late = [] if wants_tests else [r for r in rows if r.get("is_test")]
    for r in [r for r in rows if wants_tests or not r.get("is_test")] + late:
        if r["key"] not in taken and r["path"] not in paths:
            if len(paths) >= PATHS:
                break
            if used + r["tokens"] <= core:
                take(r, "breadth")
                paths.add(r["path"])
    seen = skipped = 0
    for r in rows:
        if r["key"] in taken:
            continue
        seen += 1
        if cutoff is not None and r["score"] < cutoff:
            skipped += 1
            continue
        room = by_file.get(r["path"], 0) + r["tokens"] <= max(r["tokens"], int(DEPTH_SHARE * budget))
        if seen <= DEPTH and room and used + r["tokens"] <= core and r["score"] - OVERLAP * closest(set(r["terms"] or ())) >= 0:
            take(r, "depth")
    for r in rows if core < budget else []:
        if r["key"] not in taken and r["path"] not in paths and used + r["tokens"] <= budget:
            take(r, "tail")
            paths.add(r["path"])
    if counts is not None:
        each = {p: sum(1 for _, q in chosen if q == p) for p in passes()}
        pins = spent.get("pin", 0)
        counts |= {
            "selected_count": len(chosen), "used_tokens": used, "budget": budget, "budget_exceeded": used > budget, "overflow_tokens": max(0, used - budget),
            "mandatory_tokens": pins + spent.get("claim", 0), "unconditional_tokens": pins, "minimum_achievable_budget": pins, "budget_feasible": pins <= budget,
            "claims_admitted": each["claim"], "claims_dropped_budget": dropped, "claims_capped": max(0, len(claimed) - CLAIMS),
            "breadth_paths": len(paths), "breadth_chunks": each["breadth"], "depth_chunks": each["depth"], "tail_fill": each["tail"],
            "pin_candidates": sum(1 for r in rows if r["pinned"] or r["claim"]), "pin_candidates_selected": sum(1 for r in rows if (r["pinned"] or r["claim"]) and r["key"] in taken),
            "per_file_tokens": by_file, "per_category_tokens": by_kind, "score_cutoff_skipped": skipped,
        }
    return chosen


def _packed(own: list[dict], budget: int, counts: dict | None = None) -> list[tuple]:
    """(key, pass) in order of category, score and rank."""
    flag = own[0].get("wants_tests")
    out = pack_one(own, budget, 1.0, True if flag is None else flag, {r["path"] for r in own if r.get("required")}, counts=counts)
    by_key = {r["key"]: r for r in own}
    place = lambda x: (CATEGORIES.index(by_key[x[0]].get("category") or "supporting"), -by_key[x[0]]["score"], by_key[x[0]]["rank"])
    return sorted(out, key=place)


def pack(rows: DataFrame, request: str, budget: int) -> DataFrame:
    """request, key, pass, position for every admitted candidate; rows have rank and the fields of ``pack_one``, and
    wants_tests, required and category if they are known."""
    kinds = {c: rows.schema[c].dataType for c in (request, "key")}
    arrow = to_arrow_schema(rows.select(request, "key").schema)

    def run(t: pa.Table) -> pa.Table:
        own = sorted(t.to_pylist(), key=lambda r: r["rank"])
        out = _packed(own, budget)
        return pa.table({request: pa.array([own[0][request]] * len(out), arrow.field(request).type), "key": pa.array([k for k, _ in out], arrow.field("key").type), "pass": pa.array([p for _, p in out], pa.string()), "position": pa.array(range(1, len(out) + 1), pa.int32())})

    return rows.groupBy(request).applyInArrow(run, f"`{request}` {kinds[request].simpleString()}, key {kinds['key'].simpleString()}, pass string, position int")


def diagnostics(rows: DataFrame, request: str, budget: int) -> DataFrame:
    """request, diagnostics: the counts of each request's pack, as JSON with keys in order."""
    kind, arrow = rows.schema[request].dataType, to_arrow_schema(rows.select(request).schema)

    def run(t: pa.Table) -> pa.Table:
        own, counts = sorted(t.to_pylist(), key=lambda r: r["rank"]), {}
        _packed(own, budget, counts)
        return pa.table({request: pa.array([own[0][request]], arrow.field(0).type), "diagnostics": pa.array([json.dumps(counts, sort_keys=True)], pa.string())})

    return rows.groupBy(request).applyInArrow(run, f"`{request}` {kind.simpleString()}, diagnostics string")


def coverage(required: DataFrame, indexed: DataFrame, packed: DataFrame, request: str, budget: int) -> DataFrame:
    """request, path, why of every required path that is not in the pack: not_indexed, budget (nothing was left) or dropped.

    ``required`` has request and path, ``indexed`` path, ``packed`` request, path and tokens."""
    used = packed.groupBy(request).agg(F.sum("tokens").alias("used"))
    missed = required.select(request, "path").distinct().join(packed.select(request, "path").distinct(), [request, "path"], "left_anti")
    known = indexed.select("path", F.lit(True).alias("known")).distinct()
    why = F.when(F.col("known").isNull(), "not_indexed").when(F.coalesce("used", F.lit(0)) >= budget, "budget").otherwise("dropped")
    return missed.join(known, "path", "left").join(used, request, "left").select(request, "path", why.alias("why"))


def recovery(claimed: DataFrame, admitted: DataFrame, request: str, key: str, most: int = 5) -> DataFrame:
    """The best claims that were not admitted."""
    missed = claimed.join(admitted, [request, key], "left_anti")
    w = Window.partitionBy(request).orderBy(F.desc("score"), F.asc(key))
    return missed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def passes() -> Iterator[str]:
    yield from ("pin", "claim", "breadth", "depth", "tail")


def recovery_prompt(missed: DataFrame, request: str) -> DataFrame:
    """request, prompt: what the pack left out and how to look for it; ``missed`` has at most a few rows a request."""
    ordered = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.col("path"), F.lit(" ("), F.col("reason"), F.lit(")")).alias("line"))))
    listed = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return missed.groupBy(request).agg(F.concat(F.lit("Not in this pack:\n"), listed, F.lit("\nAsk for a path by name, or search the corpus for it.")).alias("prompt"))
