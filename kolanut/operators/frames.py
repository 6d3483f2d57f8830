"""Ordered work on groups that may hold a third of all rows, and other frame helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16
BROADCAST_ROWS = 1 << 18


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on costly computed columns.

    A plain filter is pushed below the projection that computes them, which computes them twice, once
    to test and once to keep. An explode of one or no element is not, so each is computed once.
    Filters on stored columns stay plain filters: they should be pushed, down to the scan.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_keep")).drop("_keep")


def settled(df: DataFrame) -> DataFrame:
    """A frame that is read several times, computed once: a reliable checkpoint where the cluster names a folder for them in
    ``spark.checkpoint.dir``, else kept in memory and on disk with its lineage."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()


def position_chunk(order: Column, rows: int = CHUNK) -> Column:
    """A coarser, still ordered version of an integer position."""
    return F.floor(order / F.lit(rows))


def _carry(df: DataFrame, keys: Sequence[str], chunk: Column, agg: Column, over) -> tuple[DataFrame, DataFrame]:
    """Rows tagged with their slot (key and chunk), and per slot what the earlier chunks leave behind.

    The slot is one struct, in which null keys are equal. The join to the carry and the local window
    both go by it, so the rows are exchanged once.
    """
    tagged = df.withColumn("_slot", F.struct(*keys, chunk.alias("_chunk")))
    parts = tagged.groupBy("_slot").agg(agg.alias("_part"))
    w = Window.partitionBy(*[F.col("_slot")[k] for k in keys]).orderBy(F.col("_slot")["_chunk"])
    return tagged, parts.select("_slot", over(w).alias("_carry"))


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                  chunk: Column, out: str = "before") -> DataFrame:
    """Exclusive running sum per key, in two levels.

    A plain window would put all rows of a key in one task. Here the big sort runs per (key, chunk),
    and only one row per (key, chunk) is summed per key. ``chunk`` must not decrease along ``order``.
    """
    tagged, carry = _carry(df.withColumn("_value", value.cast("bigint")), keys, chunk, F.sum("_value"),
                           lambda w: F.coalesce(F.sum("_part").over(_before(w)), F.lit(0)))
    local = Window.partitionBy("_slot").orderBy(*order)
    return (tagged.join(carry, "_slot")
            .withColumn(out, F.col("_carry") + F.coalesce(F.sum("_value").over(_before(local)), F.lit(0)))
            .drop("_slot", "_carry", "_value"))


def previous_value(df: DataFrame, keys: Sequence[str], order: str, value: str, chunk: Column, out: str) -> DataFrame:
    """The value of the row before, per key, and ``<out>_exists`` to tell a null from no row.

    The first row of a chunk takes the last one of the chunk before it.
    """
    last = F.max_by(F.struct(value), order)
    tagged, carry = _carry(df, keys, chunk, last, lambda w: F.lag("_part").over(w))
    local = Window.partitionBy("_slot").orderBy(order)
    return (tagged.join(carry, "_slot")
            .withColumn("_before", F.coalesce(F.lag(F.struct(value)).over(local), F.col("_carry")))
            .withColumn(out, F.col("_before")[value]).withColumn(f"{out}_exists", F.col("_before").isNotNull())
            .drop("_slot", "_carry", "_before"))


def lang_switches(df: DataFrame, conv: str, turn: str, lang: str, chunk: Column | None = None) -> DataFrame:
    """Adjacent turns of a conversation whose languages differ, counted per conversation.

    One pass: each (conversation, chunk) counts its own switches and keeps its first and last language; those rows, one per
    chunk, give the switches between chunks.
    """
    chunk = position_chunk(F.col(turn)) if chunk is None else chunk
    rows = df.select(conv, turn, F.struct(lang).alias("_lang"), F.struct(conv, chunk.alias("_chunk")).alias("_slot"))
    before = F.lag("_lang").over(Window.partitionBy("_slot").orderBy(turn))
    parts = rows.withColumn("_before", before).groupBy("_slot").agg(
        F.count(F.lit(1)).alias("_turns"), F.count_if(F.col("_before").isNotNull() & ~F.col("_lang").eqNullSafe(F.col("_before"))).alias("_moved"),
        F.min_by("_lang", turn).alias("_first"), F.max_by("_lang", turn).alias("_last"))
    across = F.lag("_last").over(Window.partitionBy("_slot." + conv).orderBy("_slot._chunk"))
    parts = parts.withColumn("_across", across)
    moved = (F.col("_across").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_across"))).cast("bigint")
    return parts.groupBy(F.col("_slot")[conv].alias(conv)).agg(
        F.sum("_turns").alias("turns"), F.sum(F.col("_moved") + moved).alias("switches"))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: Column | int, chunk: Column,
            rank: str = "rank", at_most: int | None = None) -> DataFrame:
    """The first k rows of every key, ranked chunk by chunk.

    Chunks that start past k are dropped by the join. At most k chunks of a key remain, as each holds
    a row; where the caller knows that bound over all keys (``at_most``) and it is small, the chunk
    list is broadcast and the dropped rows never leave their map task.
    """
    k = F.lit(k) if isinstance(k, int) else k
    tagged, carry = _carry(df, keys, chunk, F.count(F.lit(1)),
                           lambda w: F.coalesce(F.sum("_part").over(_before(w)), F.lit(0)))
    early = carry.select("*", *[F.col("_slot")[x].alias(x) for x in keys]).filter(F.col("_carry") < k).select("_slot", "_carry")
    if at_most is not None and at_most <= BROADCAST_ROWS:
        early = F.broadcast(early)
    local = Window.partitionBy("_slot").orderBy(*order)
    return (tagged.join(early, "_slot")
            .withColumn(rank, F.col("_carry") + F.row_number().over(local))
            .filter(F.col(rank) <= k)
            .drop("_slot", "_carry"))
