"""Index maintenance: incremental differences, upserts, symbol tables and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import cut


def incremental_diff(scan: DataFrame, stored: DataFrame, key: str = "path", content: str = "content_hash") -> DataFrame:
    """key and status of every path: new, changed, unchanged or stale."""
    old = stored.select(F.col(key).alias("_key"), F.col(content).alias("_hash"))
    both = scan.select(key, content).join(old, F.col(key) == F.col("_key"), "full_outer")
    status = F.when(F.col("_key").isNull(), "new").when(F.col(key).isNull(), "stale").when(F.col(content) == F.col("_hash"), "unchanged").otherwise("changed")
    return both.select(F.coalesce(key, "_key").alias(key), status.alias("status"))


def replace_paths(stored: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``stored`` whose path ``fresh`` does not replace, and all of ``fresh``."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def latest(rows: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate that combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def rollup_names(symbols: DataFrame, key: str, name: str) -> DataFrame:
    return symbols.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names"))


def enclosing(points: DataFrame, spans: DataFrame, key: str, width: int = 16) -> DataFrame:
    """Each point's last listed span that contains it: an equi-join on buckets of ``width`` lines, then a check."""
    near = points.withColumn("_b", F.floor(F.col("line") / width))
    wide = spans.select(F.col(key).alias("_k"), "name", "start", "end", "ord", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_s"))
    hit = near.join(wide, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_s")) & F.col("line").between(F.col("start"), F.col("end")))
    best = hit.groupBy(key, "line").agg(F.max_by("name", "ord").alias("symbol"))
    return points.join(best, [key, "line"], "left")


def top_level(spans: DataFrame, key: str) -> DataFrame:
    """Spans that no other, different span contains: none before them in (start, -end) order ends as late."""
    once = spans.select(key, "start", "end").distinct()
    before = Window.partitionBy(key).orderBy(F.asc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("_e", F.max("end").over(before)).where(F.col("_e").isNull() | (F.col("_e") < F.col("end"))).drop("_e")


def refresh_pinned(stored: DataFrame, current: DataFrame, pins: Column, key: str = "path", content: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Of the pinned paths: those whose content changed or is new, and those that are gone."""
    seen = incremental_diff(current.where(pins), stored.where(pins), key, content)
    return seen.where(F.col("status").isin("new", "changed")).select(key), seen.where(F.col("status") == "stale").select(key)


def forget(stored: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(paths.select(key).distinct(), key, "left_anti")


def in_order(rows: DataFrame, order: list[str], tokens: str) -> DataFrame:
    """``rows`` with position (from 1) and upto (tokens up to and with each): sorted across partitions, whose totals alone
    are summed in order."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = cut(rows.repartitionByRange(parts, *order).withColumn("_at", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(F.col("_at").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(tokens).alias("_t"))
    held = held.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_nb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_tb"))
    own = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(F.broadcast(held), F.col("_at") == F.col("_p"))  # a row a partition
    both = both.withColumns({"position": (F.col("_nb") + F.count(F.lit(1)).over(own)).cast("long"), "upto": (F.col("_tb") + F.sum(tokens).over(own)).cast("long")})
    return both.drop("_at", "_p", "_nb", "_tb")


def within(path: Column, root: str) -> Column:
    """Whether a normalised path is a folder's or inside it; no path with a .. component is."""
    root = root.rstrip("/")
    safe = ~F.array_contains(F.split(path, "/"), "..")
    return F.coalesce(safe & ((path == root) | path.startswith(root + "/")), F.lit(False))


def in_scope(path: Column, scope: list[str]) -> Column:
    """Whether a path starts with any prefix of the scope; an empty scope holds everything."""
    out = F.lit(not scope)
    for prefix in scope:
        out = out | path.startswith(prefix)
    return out


def meta(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    """key, value: an index's own settings."""
    return spark.createDataFrame(sorted(values.items()), "key string, value string")
