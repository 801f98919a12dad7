"""Accounting of claims and packs, summaries over tasks, usage of responses, and one-line reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fmt_tokens, token_count
from ..sources.store import cut


def citations(terms: DataFrame, packed_terms: DataFrame, request: str) -> DataFrame:
    """request, term, cited: in how many packed chunks each kept term occurs."""
    hit = packed_terms.groupBy(request, "term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(hit, [request, "term"], "left").select(request, "term", F.coalesce("n", F.lit(0)).alias("cited"))


def claim_relevance(matched: DataFrame, idf: DataFrame, request: str, key: str) -> DataFrame:
    """The summed idf of a claim's matched terms, by which claims are ordered."""
    return matched.join(idf, "term").groupBy(request, key).agg(F.sum("idf").alias("relevance"))


def overlap_class(symbol_hit: Column, path_hit: Column, test_pair: Column, named_path: Column) -> Column:
    return F.when(symbol_hit & path_hit, 0).when(test_pair | (named_path & path_hit), 1).when(symbol_hit, 2).otherwise(3)


def macro(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median (of an even number of values the mean of the two in the middle), least and number of values."""
    sums = rows.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.count(value).alias("n"))
    middle = at_rank(rows, by, value, {"low": F.floor((F.col("n") + 1) / 2), "high": upper_median_rank()})
    middle = middle.select(F.col(by).alias("_by"), ((F.col("low") + F.col("high")) / 2.0).alias("median"))
    return sums.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "mean", "median", "least", "n")


def upper_median_rank() -> Column:
    """1-based rank of the value at n // 2 of n sorted values."""
    return F.floor(F.col("n") / 2) + 1


def p95_rank() -> Column:
    """1-based rank of the 95th percentile over tasks, in a group of n."""
    return F.greatest(F.lit(1), F.floor(0.95 * F.col("n")))


def index_rank(percent: float) -> Column:
    """1-based rank of a percentile by its rounded index."""
    return F.bround(F.lit(percent / 100) * (F.col("n") - 1)) + 1


#: Places of a table of distinct values that are counted together.
BINS = 256


def at_rank(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at given ranks (of n values) of each group, from a histogram of its distinct values.

    Distinct values are sorted across partitions; each partition counts its own, and only partition totals are summed in
    order before, so neither a group's values nor its distinct values meet in one task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    hist = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    hist = cut(hist.repartitionByRange(min(parts, BINS), "_g", "_v").withColumn("_at", F.spark_partition_id()))
    total = hist.groupBy(F.col("_g").alias("_tg")).agg(F.sum("_c").alias("n"))
    held = hist.groupBy(F.col("_g").alias("_hg"), F.col("_at").alias("_ha")).agg(F.sum("_c").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy("_hg").orderBy("_ha").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("_hg", "_ha", F.coalesce(before, F.lit(0)).alias("_before"))
    both = hist.join(held, F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_at") == F.col("_ha")))
    both = both.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy("_g", "_at").orderBy("_v")))
    both = both.join(total, F.col("_g").eqNullSafe(F.col("_tg")))
    return both.groupBy(F.col("_g").alias(by)).agg(*[F.min(F.when(F.col("_upto") >= rank, F.col("_v"))).alias(name) for name, rank in ranks.items()])


def message_tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda s, m: s + token_count(m["text"]))


def usage(response: Column) -> dict[str, Column]:
    """Token counts of a response as JSON, null where it does not tell."""
    got = lambda p: F.get_json_object(response, p).cast("long")
    return {"input_tokens": F.coalesce(got("$.usage.input_tokens"), got("$.usage.prompt_tokens")), "output_tokens": F.coalesce(got("$.usage.output_tokens"), got("$.usage.completion_tokens")), "cached_tokens": F.coalesce(got("$.usage.cache_read_input_tokens"), got("$.usage.prompt_tokens_details.cached_tokens"))}


def fits_window(tokens: Column, window: Column) -> Column:
    return tokens < window


def footer(selected: Column, candidate: Column) -> Column:
    saved = F.when(candidate > 0, 100.0 * (candidate - selected) / candidate).otherwise(0.0)
    return F.format_string("%s of %s tokens (%.1f%% less)", fmt_tokens(selected), fmt_tokens(candidate), saved)


def arms(full: DataFrame, packed: DataFrame, request: str) -> DataFrame:
    """request, arm, tokens: everything against the pack."""
    return full.select(request, F.lit("full").alias("arm"), "tokens").unionByName(packed.select(request, F.lit("packed").alias("arm"), "tokens"))
