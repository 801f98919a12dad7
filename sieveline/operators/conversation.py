"""Conversation state: the objective, the last turns verbatim, earlier ones as excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import excerpt

RECENT, EXCERPT = 2, 300


def compact(turns: DataFrame, recent: int = RECENT, chars: int = EXCERPT) -> DataFrame:
    """conv_id, turns, objective, and the last turns; the rank limit is pushed below the shuffle by the planner."""
    total = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= recent)
    tail = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("recent"))
    return total.join(tail, "conv_id").select("conv_id", "turns", excerpt(F.coalesce("first", F.lit("")), chars).alias("objective"), "recent")


def earlier(turns: DataFrame, recent: int = RECENT, chars: int = EXCERPT) -> DataFrame:
    """conv_id, turn, role, excerpt of all but the last turns."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.select("conv_id", "turn", F.row_number().over(w).alias("back")).where(F.col("back") <= recent)
    return turns.join(last, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", "role", excerpt(F.col("text"), chars).alias("excerpt"))
