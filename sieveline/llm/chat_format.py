"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and the others
as named users; system messages stay system messages.  ``masks`` are the character spans [start, end) of the rendered
text that the loss counts: what the assistant says, and its closing mark.

A dialogue is one row a participant (part 0) unless it has more than ``part_chars`` characters.  Only then is it cut
between messages, by the characters before each, into parts whose renderings join to the whole one in order of ``part``;
such dialogues are sorted across partitions and their running sizes added up by partition, so no task gathers one whole.
Rows that repeat a turn with the same role and text are one message with a count of its copies.

Positions need no scan of a rendering: every message has its place with all speakers as users, and the k-th message of
the assistant starts earlier by k times what its name takes.

Defined results: a null text renders as empty; a null role is a participant named ``unknown``; a null turn sorts before
all others; messages of one turn are in the order of role, then text; a message longer than ``part_chars`` is not cut;
a conversation of system messages only gives no rows; an empty table gives an empty result; columns beyond conv_id, turn,
role and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HEAVY, cut, parts

PART = 1 << 20
OPEN, CLOSE, USER = "<|im_start|>", "<|im_end|>", "user name="
ORDER = ["turn", "role", "text"]


def _heads(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(role == "system", role).otherwise(F.concat(F.lit(USER), role)), F.lit("\n"))


def _in_parts(once: DataFrame, part_chars: int) -> DataFrame:
    """``once`` with the part of each message: its characters before, in whole ``part_chars``."""
    sizes = once.groupBy("conv_id").agg(F.sum("width").alias("chars"))
    long = cut(sizes.where(F.col("chars") > part_chars).select(F.col("conv_id").alias("own")))
    n = long.count()
    if not n:
        return once.withColumn("part", F.lit(0).cast("long"))
    long = F.broadcast(long) if n <= HEAVY else long
    short = once.join(long, F.col("conv_id").eqNullSafe(F.col("own")), "left_anti").withColumn("part", F.lit(0).cast("long"))
    tall = once.join(long, F.col("conv_id").eqNullSafe(F.col("own")), "left_semi").repartitionByRange(parts(once), "conv_id", *ORDER)
    tall = cut(tall.withColumn("at", F.spark_partition_id()))
    own = tall.groupBy(F.col("conv_id").alias("own"), F.col("at").alias("own_at")).agg(F.sum("width").alias("chars"))
    before = Window.partitionBy("own").orderBy("own_at").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0)))  # a row for each conversation and partition
    tall = tall.join(own, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("at") == F.col("own_at")))
    here = Window.partitionBy("conv_id", "at").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("before") + F.coalesce(F.sum("width").over(here), F.lit(0))
    return short.unionByName(tall.withColumn("part", F.floor(place / part_chars)).select(*once.columns, "part"))


def rotate(conversations: DataFrame, part_chars: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_messages, n_repeats, rendered and masks."""
    role = F.coalesce("role", F.lit("unknown"))
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    width = F.length(_heads(F.col("role"))) + F.length("text") + len(CLOSE) + 1
    once = said.groupBy("conv_id", *ORDER).agg(F.count(F.lit(1)).alias("n")).withColumn("width", width.cast("long"))
    pieces = _in_parts(once, part_chars)
    before = Window.partitionBy("conv_id", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("place", F.coalesce(F.sum("width").over(before), F.lit(0)))
    dialogues = pieces.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "place"))).alias("messages"), (F.sum("n") - F.count(F.lit(1))).alias("n_repeats"))
    cast = said.where(F.col("role") != "system").select(F.col("conv_id").alias("own"), F.col("role").alias("perspective")).distinct()
    views = dialogues.join(cast, F.col("conv_id").eqNullSafe(F.col("own")))

    assistant = f"{OPEN}assistant\n"
    shown = F.transform("messages", lambda m: F.concat(F.when(m["role"] == F.col("perspective"), F.lit(assistant)).otherwise(_heads(m["role"])), m["text"], F.lit(CLOSE + "\n")))
    shorter = F.length(_heads(F.col("perspective"))) - len(assistant)
    start = lambda m, k: (m["place"] - k * shorter + len(assistant)).cast("int")
    mine = F.filter("messages", lambda m: m["role"] == F.col("perspective"))
    masks = F.transform(mine, lambda m, k: F.struct(start(m, k).alias("start"), (start(m, k) + F.length(m["text"]) + len(CLOSE)).alias("end")))
    return views.select("conv_id", "perspective", "part", F.size("messages").alias("n_messages"), "n_repeats", F.array_join(shown, "").alias("rendered"), masks.alias("masks"))
