"""Tool output made short: terminal codes off, noise collapsed, repeats and passing tests out, failures with their context
kept, and the rest trimmed to a budget from the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, token_count
from . import post

KINDS = ("terminal", "build", "lint", "test")


def compress(outputs: DataFrame, key: str, content: str, kind: str = "terminal", budget: int = 2000, context: int = 3) -> DataFrame:
    """key, compressed, digest, tokens before and after, lines kept and removed; never longer than what came in."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind!r}")
    if budget < 1 or context < 0:
        raise ValueError("the budget is at least 1 and the context at least 0")
    rows = outputs.select(key, F.posexplode(lines(F.col(content))).alias("at", "raw")).withColumn("line", post.clean_line(F.col("raw")))
    rows = rows.withColumn("role", post.line_role(F.col("line"))).drop("raw")
    near = post.failure_windows(rows, key, "at", context)
    runs = post.collapse_runs(rows, key, "at").join(near.select(key, "at", "line", "near"), [key, "at"])
    marked = runs.withColumn("line", F.when((F.col("n") > 1), F.concat(F.lit("["), F.col("n"), F.lit(" "), F.col("role"), F.lit(" lines]"))).otherwise(F.col("line")))
    marked = marked.withColumn("role", F.when(F.col("n") > 1, "marker").otherwise(F.col("role")))
    if kind == "test":
        marked = marked.where((F.col("role") != "test_ok") | F.col("near"))
    kept = post.blank_runs(post.first_of_key(marked, key, "at", "line"), key, "at").withColumn("tokens", token_count(F.col("line")))
    fit = post.trim_to_budget(kept, key, "at", budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    short = fit.groupBy(key).agg(text.alias("short"), F.count(F.lit(1)).alias("lines_kept"))
    both = outputs.select(key, F.coalesce(content, F.lit("")).alias("_c")).join(short, key, "left").na.fill({"short": "", "lines_kept": 0})
    best = F.when(token_count(F.col("short")) < token_count(F.col("_c")), F.col("short")).otherwise(F.col("_c"))
    return both.select(key, best.alias("compressed"), F.sha2("_c", 256).alias("digest"), token_count(F.col("_c")).alias("tokens_before"), token_count(best).alias("tokens_after"), "lines_kept", (F.size(lines(F.col("_c"))) - F.col("lines_kept")).alias("lines_removed"))
