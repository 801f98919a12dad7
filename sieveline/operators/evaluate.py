"""Evaluation of rankings and packs, exact order statistics, splits, bundle checks, ledgers and deltas."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import pieces, tidy
from .report import at_rank, upper_median_rank


def label_match(path: Column, start: Column, end: Column, symbol: Column, label: Column) -> Column:
    """Whether a chunk meets a label: same path, the label's lines inside the chunk's, and the symbol where the chunk has one."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    inside = F.coalesce(F.size(label["lines"]), F.lit(0)) < 2
    inside = inside | ((start <= F.get(label["lines"], 0)) & (end >= F.get(label["lines"], 1)))
    return F.coalesce(path == label["path"], F.lit(False)) & inside & (none(label["symbol"]) | none(symbol) | (symbol == label["symbol"]))


def spans(docs: DataFrame, key: str, text: str, wanted: list[str]) -> DataFrame:
    """key, g of every document that holds one of the ``wanted`` spans (words joined by a space, equally many each)."""
    n = len(wanted[0].split(" ")) if wanted else 1
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(g.split(" ", 1)[0] for g in wanted), frozenset(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole = shared.value
        for part in pieces(batches):
            rows, found = [], []
            for i, x in enumerate(part.column(1).to_pylist()):
                words = [w for w in (x or "").replace("\n", " ").split(" ") if w]
                own = {g for j, w in enumerate(words) if w in first and (g := " ".join(words[j : j + n])) in whole}
                rows += [i] * len(own)
                found += own
            yield pa.record_batch([part.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "g"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(tidy(run), f"`{key}` {kind}, g string")


def relevance_labels(chunks: DataFrame, labels: DataFrame, request: str) -> DataFrame:
    """request, key, relevant of every chunk that a label meets: an irrelevant label overrides required and helpful ones.

    Chunks of one place and symbol meet the same labels, so each distinct label meets each distinct place once.
    ``chunks`` has key, path, start_line, end_line and symbol; ``labels`` request, kind, path, symbol and lines."""
    shape = ["path", "start_line", "end_line", "symbol"]
    shapes = chunks.select(*shape).distinct()
    own = labels.groupBy(request, F.col("path").alias("_path"), F.col("symbol").alias("_symbol"), "lines").agg(F.min(F.when(F.col("kind") == "irrelevant", 0).otherwise(1)).alias("v"))
    label = F.struct(F.col("_path").alias("path"), F.col("_symbol").alias("symbol"), "lines")
    met = shapes.join(own, F.col("path") == F.col("_path")).where(label_match(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), label))
    met = met.groupBy(request, *[F.col(c).alias(f"_s{c}") for c in shape]).agg(F.min("v").alias("relevant"))
    both = chunks.join(met, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in shape]))
    return both.groupBy(request, "key").agg(F.min("relevant").alias("relevant"))


def ranking(ranked: DataFrame, relevant: DataFrame, request: str, key: str, k: int = 10) -> DataFrame:
    """request, recall, ndcg, mrr of the first k ranks; requests without a relevant row have recall and ndcg 0."""
    totals = relevant.groupBy(request).agg(F.count(F.lit(1)).alias("total"))
    hits = ranked.join(relevant.select(request, key, F.lit(1).alias("hit")), [request, key], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    gain = F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    got = hits.groupBy(request).agg(F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("found"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("total")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = got.join(totals, request, "left")
    none = F.col("total").isNull()
    return both.select(request, F.when(none, 0.0).otherwise(F.col("found") / F.col("total")).alias("recall"), F.when(none, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def required_recall(required: DataFrame, packed: DataFrame, request: str, key: str) -> DataFrame:
    """request, recall of required rows; requests without any are not listed and count as 1."""
    hit = packed.select(request, key).distinct().withColumn("hit", F.lit(1))
    return required.join(hit, [request, key], "left").groupBy(request).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def batch_totals(runs: DataFrame) -> DataFrame:
    """One row of sums over a batch, and the upper median of the reductions; ``runs`` has candidate_tokens and selected_tokens."""
    share = F.when(F.col("candidate_tokens") > 0, 100.0 * (F.col("candidate_tokens") - F.col("selected_tokens")) / F.col("candidate_tokens")).otherwise(0.0)
    rows = runs.select(F.lit(0).alias("all"), "candidate_tokens", "selected_tokens", share.alias("reduction_pct"))
    sums = rows.groupBy("all").agg(F.count(F.lit(1)).alias("tasks"), F.sum("candidate_tokens").alias("candidate_tokens"), F.sum("selected_tokens").alias("selected_tokens"))
    middle = at_rank(rows, "all", "reduction_pct", {"median_reduction_pct": upper_median_rank()})
    return sums.join(middle, "all", "left").drop("all")


def is_dev(key: Column) -> Column:
    """40 in 100 by a hash of the key, so that no stratum is sorted."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 8) < "66666666"


def verify_bundle(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, status: ok, changed, missing or unexpected."""
    m = manifest.select(F.col("path").alias("_p"), F.col("digest").alias("_d"))
    both = files.join(m, files["path"] == F.col("_p"), "full_outer")
    status = F.when(F.col("path").isNull(), "missing").when(F.col("_p").isNull(), "unexpected").when(F.col("digest") == F.col("_d"), "ok").otherwise("changed")
    return both.select(F.coalesce("path", "_p").alias("path"), status.alias("status"))


def ledger_daily(rows: DataFrame) -> DataFrame:
    day = F.to_date("ts").alias("day")
    return rows.groupBy(day).agg(F.count(F.lit(1)).alias("runs"), F.sum("candidate").alias("candidate"), F.sum("selected").alias("selected"), F.count_distinct("user").alias("users"))


def arm_deltas(arms: DataFrame, arm: str, value: str, reference: str) -> DataFrame:
    """Each arm's difference to the reference arm, whose rows are summed."""
    base = arms.where(F.col(arm) == reference).agg(F.sum(value).alias("_base"))  # one row
    return arms.crossJoin(F.broadcast(base)).select(arm, value, (F.col(value) - F.col("_base")).alias("delta"), (100.0 * (F.col(value) - F.col("_base")) / F.col("_base")).alias("delta_pct"))


def derived_cost(tokens: Column, usd_per_million: float) -> Column:
    return tokens * F.lit(usd_per_million) / F.lit(1_000_000.0)


def task_errors(task: Column, required: Column, budget: Column, difficulty: Column, repo_tokens: Column) -> Column:
    found = [F.when(F.coalesce(task, F.lit("")) == "", "task"), F.when(F.coalesce(F.size(required), F.lit(0)) == 0, "required_chunks"), F.when(F.coalesce(budget, F.lit(0)) <= 0, "token_budget"), F.when(budget >= repo_tokens, "budget_not_smaller"), F.when(~difficulty.isin("small", "typical", "difficult"), "difficulty")]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def rerank(scored: DataFrame, request: str, key: str) -> DataFrame:
    """request, key, rank by score; rows without a score come last."""
    w = Window.partitionBy(request).orderBy(F.desc_nulls_last("score"), F.asc(key))
    return scored.select(request, key, F.row_number().over(w).alias("rank"))


def label_rate(labels: DataFrame, packed: DataFrame, request: str) -> DataFrame:
    """request, rate: share of labels whose path is in the pack."""
    hit = packed.select(request, "path").distinct().withColumn("hit", F.lit(1))
    return labels.join(hit, [request, "path"], "left").groupBy(request).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("rate"))


def task_set_digest(tasks: DataFrame, column: str) -> DataFrame:
    """One digest of a set of tasks, whatever their order; tasks are a label file, not a corpus."""
    return tasks.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.sha2(column, 256)))), 256).alias("digest"))
