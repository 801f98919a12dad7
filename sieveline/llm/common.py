"""Shared pieces of the training-data operators: sessions, Arrow buffers and vectorised hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.batches import tidy, trim
from ..sources.store import cut, shared_folder

U64 = np.uint64
#: Odd multipliers of the 64-bit mixers; any odd values with scattered bits serve.
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the identifier written as text, modulo ``modulus``: the hold-out rule of the classifiers."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about ``most`` bytes each (a longer row stands alone)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * M2
    h = (h ^ (h >> U64(27))) * M3
    return h ^ (h >> U64(31))


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one little-endian integer; zeros follow the end."""
    n = len(buf)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = buf
    out = np.empty(n + 8, "<u8")
    for r in range(8):
        part = out[r::8]
        part[:] = padded[r : r + 8 * len(part)].view("<u8")
    return out[:n]


#: Masks that keep the first 0 to 8 bytes of a load.
KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=U64)


def span_hashes(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; ``words`` are the loads of the buffer."""
    h = mix(length.astype(U64) + M1)
    live, off = np.flatnonzero(length > 0), 0
    while len(live):
        left = np.minimum(length[live] - off, 8)
        h[live] = mix((h[live] ^ (words[start[live] + off] & KEEP[left])) * M1)
        off += 8
        live = live[length[live] > off]
    return h


def token_runs(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind within rows: starts, lengths, and the first run of each row (n + 1 values)."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[at] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    full = kind[start] != 0
    start, end = start[full], end[full]
    return start, end - start, np.searchsorted(start, at)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows that ``first`` (n + 1 values) bounds; empty rows give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[first[1:]] - total[first[:-1]]


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (null: empty) plus ``more``; other columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def carried(docs: DataFrame) -> tuple[list[Column], StructType]:
    """Columns that take whole rows of ``docs`` through a narrow pass (``row``: all but text; ``raw``: text, null or not),
    and their types; names inside ``row`` never clash with the pass's own."""
    rest = [c for c in docs.schema if c.name != "text"]
    row = F.struct(*[F.col(f"`{c.name}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    held = docs.select(row.alias("row"), F.col("text").alias("raw"))
    return [row.alias("row"), F.col("text").alias("raw")], held.schema


def restored(passed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that ``carried`` took along, with the columns of ``docs``."""
    return passed.select(*[F.col("raw").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def stored(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the folder that the cluster shares, and read again; ``held`` gets the path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, held: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in held:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()


def numbered(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) and a ``number`` that tells even equal rows apart; stored, so that it stays."""
    return stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number")))


def rows_of(rows: DataFrame, *more: Column) -> DataFrame:
    """number, doc_id and text (null: empty) of numbered rows, plus ``more``."""
    return rows.select("number", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), *more)


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, 0 for the first row in order: sorted across partitions, whose counts alone are summed."""
    df = cut(df.repartitionByRange(parts(df), *order).withColumn("_at", F.spark_partition_id()))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_at").orderBy(*order)) - 1
    return df.join(F.broadcast(counts), "_at").withColumn("place", (F.col("_before") + own).cast("long")).drop("_at", "_before")  # a row a partition


#: Narrow rows (links, states, sums) that one task takes.
NARROW = 1 << 16


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more tasks than they ask for: the driver keeps a record of
    every task, so a small table that is read again and again must not stay dealt over as many partitions as a shuffle has."""
    return df.coalesce(max(1, -(-rows // NARROW)))


#: A key with 1 / HEAVY of all rows or more is heavy, so at most HEAVY keys are.
HEAVY = 1000


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with ``right``, one row a key, whose column ``count`` says how many rows of ``left`` have the key.

    Heavy keys (HEAVY rows of ``right`` at most, as the counts sum to ``total``) are broadcast, so that their rows stay where
    they are; all others are few a key and meet in a shuffle.
    """
    heavy = F.col(count) * HEAVY >= F.lit(total)
    hot = right.where(heavy)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(~heavy), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


#: Numbers of rows that are broadcast to filter by: 16 MB of longs at most.
NAMED = 2_000_000


def among(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """The rows whose number is (``left_semi``) or is not (``left_anti``) in ``numbers``, a stored table.

    NAMED numbers at most are broadcast, so that rows stay where they are; more meet them in a shuffle.
    """
    return rows.join(F.broadcast(numbers) if numbers.count() <= NAMED else numbers, "number", how)


#: Rows of tables of patterns or sources that are broadcast whole.
FEW = 20_000


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, rows: int | None = None) -> DataFrame:
    """``join_heavy``, but ``right``, a stored table, is broadcast whole if it has FEW rows at most; without ``count``.

    ``rows`` says how many rows ``right`` has, where that is known."""
    if (right.count() if rows is None else rows) <= FEW:
        return left.join(F.broadcast(right.drop(count)), keys)
    return join_heavy(left, right, keys, count, total).drop(count)
