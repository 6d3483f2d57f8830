"""A sequence cut where its running total first reaches the cap, the count starting again behind each cut.

Where the next cut lies depends on the last one, so the cuts form a chain through the whole sequence. A block of the sequence
is therefore kept as its cut function: for every place the last cut may have, the last cut behind the block and the number of cuts
in it, found by pointers to the next cut and pointer doubling. The functions are constant over ranges of places and compose, so
they are folded pairwise into a tree, and the one chain that starts at 0 is followed down the tree: each block learns where it is
entered without waiting for the blocks before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolanut.operators.frames import settled

#: A block holds about this many shards, but at least and at most about so many rows.
BLOCK_SHARDS, LEAST_ROWS, MOST_ROWS = 4, 1 << 16, 1 << 20
_NODE = "_node BIGINT, upto ARRAY<BIGINT>, last ARRAY<BIGINT>, cuts ARRAY<BIGINT>, ends ARRAY<BIGINT>"
_SAME = -1
_FAR = -(1 << 62)


def cut_function(start: int, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upto, last, cuts) of a block that begins at ``start`` and whose rows end at ``ends`` (running totals).

    A last cut up to ``upto[i]``, and above ``upto[i - 1]``, leads to the last cut ``last[i]`` (``_SAME``: unchanged) after ``cuts[i]`` cuts.
    """
    n = len(ends)
    after = np.searchsorted(ends, ends + cap, side="left")
    reach, count = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
    while True:
        further = reach[reach]
        if (further == reach).all():
            break
        count, reach = count + count[reach], further
    # rows that can be the first cut: up to the first one that is reached from a cut at the very start
    first = min(n, int(np.searchsorted(ends, start + cap, side="left")) + 1)
    upto, last, cuts = np.minimum(ends[:first] - cap, start), ends[reach[:first]], count[:first] + 1
    if not n or ends[-1] - cap < start:
        upto, last, cuts = np.append(upto, start), np.append(last, _SAME), np.append(cuts, 0)
    return _merged(upto, last, cuts)


def _merged(upto: np.ndarray, last: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours that lead to the same place become one range; empty ranges go."""
    keep = np.append((np.diff(last) != 0) | (np.diff(cuts) != 0), True)
    upto, last, cuts = upto[keep], last[keep], cuts[keep]
    keep = np.diff(upto, prepend=_FAR) > 0
    return upto[keep], last[keep], cuts[keep]


def composed(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cut function of two neighbouring blocks."""
    (upto, last, cuts), (upto_b, last_b, cuts_b) = a, b
    moved = last != _SAME
    at = np.minimum(np.searchsorted(upto_b, last[moved], side="left"), len(upto_b) - 1)
    out = [(upto[moved], np.where(last_b[at] == _SAME, last[moved], last_b[at]), cuts[moved] + cuts_b[at])]
    if not moved.all():  # the last range: no cut in the first block, so the second one is entered with the same last cut
        floor, top = (upto[-2] if len(upto) > 1 else _FAR), upto[-1]
        lo, hi = int(np.searchsorted(upto_b, floor, side="right")), int(np.searchsorted(upto_b, top, side="left"))
        hi = min(hi, len(upto_b) - 1)
        out.append((np.minimum(upto_b[lo:hi + 1], top), last_b[lo:hi + 1], cuts_b[lo:hi + 1]))
    return _merged(*(np.concatenate(x) for x in zip(*out)))


def _row(node: int, function: tuple, ends: np.ndarray) -> pa.Table:
    arrays = [pa.array([node], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in (*function, ends))]
    return pa.Table.from_arrays(arrays, ["_node", "upto", "last", "cuts", "ends"])


def _leaf(cap: int):
    def made(table: pa.Table) -> pa.Table:
        before, size = (table.column(c).to_numpy() for c in ("before", "size"))
        ends = np.sort(before + size)
        return _row(table.column("_node")[0].as_py(), cut_function(int(before.min()), ends, cap), np.zeros(0, dtype=np.int64))
    return made


def _pair(table: pa.Table) -> pa.Table:
    rows = sorted(table.select(["_node", "upto", "last", "cuts"]).to_pylist(), key=lambda r: r["_node"])
    functions = [tuple(np.array(r[c], dtype=np.int64) for c in ("upto", "last", "cuts")) for r in rows]
    return _row(rows[0]["_node"] // 2, functions[0] if len(rows) == 1 else composed(*functions), np.zeros(0, dtype=np.int64))


def _inner(cap: int):
    def made(table: pa.Table) -> pa.Table:
        """The ends of a block's cuts, followed from the one cut before it."""
        before, size = (table.column(c).to_numpy() for c in ("before", "size"))
        ends, at = np.sort(before + size), table.column("entered")[0].as_py()
        found = []
        while (k := int(np.searchsorted(ends, at + cap, side="left"))) < len(ends):
            at = int(ends[k])
            found.append(at)
        arrays = [table.column("_node").slice(0, 1).combine_chunks(), table.column("shard").slice(0, 1).combine_chunks(), pa.array([found], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, ["_node", "first_shard", "cut_ends"])
    return made


def _entered(levels: list[DataFrame]) -> DataFrame:
    """``_node, entered, shard`` of every block: the last cut before it and the number of cuts so far, from the root down."""
    known = levels[-1].select("_node", F.lit(0).cast("bigint").alias("entered"), F.lit(0).cast("bigint").alias("shard"))
    for level in range(len(levels) - 2, -1, -1):
        nodes = levels[level]
        parents = known.withColumnRenamed("_node", "_up")
        met = nodes.withColumn("_up", F.floor(F.col("_node") / 2)).join(parents, "_up")
        at = F.array_position(F.transform("upto", lambda u: u >= F.col("entered")), True).cast("int")
        behind = F.element_at("last", at)
        met = met.withColumn("_behind", F.when(behind == _SAME, F.col("entered")).otherwise(behind)).withColumn("_passed", F.element_at("cuts", at))
        # the right one of a pair is entered with what the left one, if it has rows, does to the chain
        left = met.filter(F.col("_node") % 2 == 0)
        before = left.select(F.col("_up").alias("_of"), F.col("_behind").alias("_to"), (F.col("shard") + F.col("_passed")).alias("_shards"))
        right = met.filter(F.col("_node") % 2 == 1).join(before, F.col("_up") == F.col("_of"), "left")
        known = left.select("_node", "entered", "shard").unionByName(right.select(
            "_node", F.coalesce("_to", "entered").alias("entered"), F.coalesce("_shards", "shard").alias("shard")))
    return known


def exact_cuts(placed: DataFrame, size: str, cap: int, blocks: int | None = None) -> DataFrame:
    """``placed`` (with ``before``, the total of the rows before a row) with ``shard_id``.

    A shard closes with the row whose total behind the last cut reaches ``cap``; rows of no size behind it open the next one.
    Blocks are ranges of the running total, so they are even by construction; a row larger than a block leaves the next ones empty.
    Null sizes count as 0. Only running totals leave the rows; a block's cuts, a handful, come back to it.
    """
    if cap <= 0:
        raise ValueError("a shard holds at least one token")
    tokens = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    narrow = settled(placed.select(F.col("before"), tokens.alias("size")))
    total = narrow.agg(F.max(F.col("before") + F.col("size")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return placed.withColumn("shard_id", F.lit(0).cast("bigint"))
    if blocks is None:
        blocks = max(1, min(total["t"] // (BLOCK_SHARDS * cap), total["n"] // LEAST_ROWS), total["n"] // MOST_ROWS)
    width = max(1, -(-(total["t"] + 1) // blocks))
    node = F.floor(F.col("before") / F.lit(width))
    rows = narrow.withColumn("_node", node)
    level = settled(rows.groupBy("_node").applyInArrow(_leaf(cap), _NODE))
    levels, top = [level], blocks
    while top > 1:
        level = settled(level.groupBy(F.floor(F.col("_node") / 2).alias("_up")).applyInArrow(_pair, _NODE))
        levels.append(level)
        top = -(-top // 2)
    entered = _entered(levels).select(F.col("_node").alias("_block"), "entered", "shard")
    known = rows.join(entered, F.col("_node") == F.col("_block")).select("_node", "before", "size", "entered", "shard")
    cuts = settled(known.groupBy("_node").applyInArrow(_inner(cap), "_node BIGINT, first_shard BIGINT, cut_ends ARRAY<BIGINT>"))
    met = placed.withColumn("_node", node).join(cuts, "_node", "left")
    passed = F.size(F.filter("cut_ends", lambda e: e <= F.col("before")))
    return met.withColumn("shard_id", F.col("first_shard") + passed).drop("_node", "first_shard", "cut_ends")
