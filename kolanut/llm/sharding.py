"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in parts (a keyed hash of their key, their ties, and their number among the rows alike in both). How many rows of each part go to each shard is drawn exactly as a
uniform shuffle would have it: multivariate hypergeometric, part after part, from the places that the shards
have left. The matrix is drawn in two levels, over blocks of parts and then over the parts of each
block, so that each draw handles a bounded number of rows. Then the rows of a part are put in random order and dealt out
by their counts, exchanged, and put in random order again inside their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from kolanut.llm.shared import written

SHARDS = 24
SEED = 29
#: The rows that a part of either shuffle holds on average, and the blocks that parts are grouped in.
PART_ROWS = 1 << 16
BLOCKS = 64
#: Numbers of alike rows (24 bytes each) up to which the list is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def size_of(text: str | Column = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def checksum(text: str | Column = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def draw(seed: int, key: Column, purpose: str) -> Column:
    """64 bits from a digest of the key; the same for a key on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), F.lit(purpose)))
    return F.xxhash64(digest)


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], np.int64)


def split_counts(rows: np.ndarray, places: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A matrix with these row sums and column sums, drawn as a uniform shuffle draws it."""
    out = np.zeros((len(rows), len(places)), np.int64)
    left = places.astype(np.int64).copy()
    for i, n in enumerate(rows):
        rest = int(n)
        total = int(left.sum())
        for j in range(len(left)):  # a chain of plain hypergeometric draws, one per shard
            if rest == 0:
                break
            total -= int(left[j])
            got = rest if total == 0 else _hypergeometric(rng, int(left[j]), total, rest)
            out[i, j] = got
            rest -= got
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact draw at any size; the generator itself takes fewer than 10^9 of either kind."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    return _rejected(rng, good, bad, n)


def _grown(x: int, d: int) -> float:
    """log gamma(x + d) - log gamma(x), without the cancellation that two large logarithms suffer."""
    if min(x, x + d) < 1000:
        return math.lgamma(x + d) - math.lgamma(x)
    y = x + d
    return (y - 0.5) * math.log1p(d / x) + d * (math.log(x) - 1) + (1 / y - 1 / x) / 12 - (1 / y**3 - 1 / x**3) / 360


def _rejected(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw by rejection from a flat middle with exponential tails.

    The law is log-concave: with probability p at the mode, the one d places off is at most min(1, e^(1 - p |d|)) times p. Any smaller p
    bounds it too. At least 3/4 of the law lies within two deviations of the mean (Chebyshev), so the mode holds 3/4 over the
    number of places there, or more. Some eight tries give a draw, whatever the sizes.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    deviation = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))
    p = 0.75 / (4 * deviation + 1)
    flat = 1 / p + 0.5
    while True:
        x = rng.random() * (flat + 1 / p)
        x = x if x < flat else flat + rng.exponential(1 / p)
        d = math.floor(x + 0.5) * (1 if rng.random() < 0.5 else -1)
        if low <= mode + d <= high:
            fall = (_grown(mode + 1, d) + _grown(good - mode + 1, -d) + _grown(n - mode + 1, -d) + _grown(bad - n + mode + 1, d))
            if math.log(1 - rng.random()) + min(0.0, 1 - p * (x - 0.5)) <= -fall:
                return mode + d


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``block, part, shard, first, n``: which ranks of a part go to which shard, from ``block, part, n``.

    The block totals (at most ``BLOCKS`` rows) are drawn on the driver, the parts of a block in a task each.
    """
    totals = {r.block: r.n for r in counts.groupBy("block").agg(F.sum("n").alias("n")).collect()}
    blocks = sorted(totals)
    rows = np.array([totals[b] for b in blocks], np.int64)
    matrix = split_counts(rows, shard_sizes(int(rows.sum()), shards), np.random.Generator(np.random.PCG64([seed, 1])))
    places = {b: matrix[i].tolist() for i, b in enumerate(blocks)}

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        block = int(pdf.block.iloc[0])
        cut = split_counts(pdf.n.to_numpy(), np.array(places[block]), np.random.Generator(np.random.PCG64([seed, 2, block])))
        first = np.cumsum(cut, axis=1) - cut
        return pd.DataFrame({
            "block": block, "part": np.repeat(pdf.part.to_numpy(), shards), "shard": np.tile(np.arange(shards), len(pdf)),
            "first": first.ravel(), "n": cut.ravel()})

    return counts.groupBy("block").applyInPandas(of_block, "block int, part int, shard int, first bigint, n bigint")


def numbered(rows: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """``rows`` with ``_same`` (a hash of key and ties) and ``_nth``, the number of a row among those alike in it, from 0.

    Two levels: each partition numbers its own rows, and starts after the alike rows of the partitions before it. So alike rows stay
    where they are, however many they are, and which of them gets which number makes no difference.
    """
    told = [c for name in (key, *ties) for c in (F.col(name), F.col(name).isNull())]
    same = rows.withColumns({"_same": F.xxhash64(*told), "_chunk": F.spark_partition_id()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            names, at, many = np.unique(batch.column("_same").to_numpy(), return_inverse=True, return_counts=True)
            order = np.argsort(at, kind="stable")
            nth = np.empty(len(at), np.int64)
            nth[order] = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            before = np.array([met.get(x, 0) for x in names.tolist()], np.int64)
            met.update(zip(names.tolist(), (before + many).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth + before[at], pa.int64())], [*batch.schema.names, "_nth"])

    counts = same.groupBy(F.col("_same").alias("_s"), F.col("_chunk").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("_start", F.sum("_n").over(before)).filter("_start is not null").drop("_n"))
    sent = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    schema = StructType([*same.schema.fields]).add("_nth", LongType())
    return same.mapInArrow(count, schema).join(sent, (F.col("_same") == F.col("_s")) & (F.col("_chunk") == F.col("_c")), "left").withColumn(
        "_nth", F.col("_nth") + F.coalesce("_start", F.lit(0))).drop("_s", "_c", "_start", "_chunk")


def assign(rows: DataFrame, key: str, ties: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: shard sizes are at most one apart, every shuffle is equally likely.

    ``ties`` are columns that tell rows of one key apart; rows alike in all of them are interchangeable. A null key is a key.
    ``rows`` is read several times: pass a written frame, whose rows lie in the same partitions each time. Rows of one key are drawn
    one by one, like any others.
    """
    n = rows.count()
    parts = max(8, -(-n // (BLOCKS * PART_ROWS)))
    one = F.concat_ws(":", "_same", "_nth")
    placed = numbered(rows, key, ties).withColumn("_draw", draw(seed, one, "part"))
    placed = placed.withColumns({"_block": F.pmod(F.col("_draw"), F.lit(BLOCKS)).cast("int"),
                                 "_part": F.pmod(F.shiftright("_draw", 8), F.lit(parts)).cast("int")})
    counts = placed.groupBy(F.col("_block").alias("block"), F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    matrix = written(communication_matrix(counts, shards, seed))
    cuts = matrix.groupBy("block", "part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "first", "n"))), lambda x: x["first"] + x["n"]).alias("_ends"))
    local = Window.partitionBy("_block", "_part").orderBy(draw(seed, one, "rank"), "_same", "_nth")
    ranked = placed.withColumn("_rank", F.row_number().over(local) - 1)
    dealt = ranked.join(cuts, (ranked["_block"] == cuts["block"]) & (ranked["_part"] == cuts["part"])).drop("block", "part")
    shard = F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))).cast("int")
    # second shuffle: a place in the shard is a random chunk of it and the rank inside that chunk
    again = dealt.withColumn("shard", shard).withColumn("_again", draw(seed, one, "slot"))
    again = again.withColumn("_slot", F.struct("shard", F.pmod("_again", F.lit(max(64, -(-n // (shards * PART_ROWS))))).alias("chunk"))).drop("_ends", "_draw")
    sizes = again.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_slot.shard").orderBy("_slot.chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slot").orderBy("_again", "_same", "_nth")
    out = again.withColumn("_inside", F.row_number().over(inside) - 1).join(sizes, "_slot")
    return out.withColumn("slot", F.col("_before") + F.col("_inside")).drop(
        "_slot", "_again", "_inside", "_before", "_rank", "_block", "_part", "_same", "_nth")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: key, ``size``, ``text_crc32``, ``shard``, ``slot``. Null texts have size 8 and the empty checksum."""
    narrow = written(docs.select(F.col(key).alias("_key"), size_of(F.col(text)).alias("size"), checksum(F.col(text)).alias("text_crc32")))
    return assign(narrow, "_key", ["size", "text_crc32"], shards, seed).withColumnRenamed("_key", key)
