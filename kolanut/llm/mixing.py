"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, the source's target over its size. The documents
stand in a line, short ones first; the expected copies are summed along it, a random offset is added, and a
document is taken once for each whole number that the sum crosses in it. The error in words then stays
below the longest document of the source, whatever the number of documents.

A source may hold a third of all rows, so its line is summed in two levels: per slice of the line, and then
inside each slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolanut.llm.sharding import numbered
from kolanut.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: A size class spans about an eighth; it is split by draw in slices of this many rows on average.
SLICE_ROWS = 1 << 16
_STEPS = float(1 << 52)


def words(text: str | Column = "text") -> Column:
    """The number of words of the whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_draw(seed: int, key: Column, purpose: str | Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of a digest; the same for a key on every run."""
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), purpose))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_STEPS)


def targets(sizes: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of the sources (``source``, ``source_size``, ``target``) from one row per source with its size.

    Sources in code-point order, null last, take the weights in turn. Shares stop at ``most`` times the
    size, and what is over is shared again by weight. That sharing ends at one level: each source gets
    the level times its weight, or its limit where that is less. With the sources in order of limit over weight,
    the level is what the first ones at their limits leave, over the weights of the others. Rows here are
    sources, not documents.
    """
    held = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col(source).isNull(), F.col(source))) - 1)
    held = held.withColumns({
        "_w": F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("bigint"),
        "_limit": F.col("source_size") * most})
    held = held.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_limit") / F.col("_w"), "_n")))
    earlier = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = held.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0)))
                           .cast("double") / F.sum("_w").over(later).cast("double"))
    open_ = F.col("_level") * F.col("_w") < F.col("_limit")
    held = held.withColumn("_final", F.min(F.when(open_, F.struct("_rank", "_level"))).over(everything))
    limit = F.col("_limit").cast("double")
    target = F.when(F.col("_rank") < F.coalesce(F.col("_final._rank"), F.lit(1 << 62)), limit).otherwise(
        F.least(limit, F.col("_final._level") * F.col("_w")))
    return held.select(source, "source_size", target.alias("target"))


def _crossed(rate: Column, before: Column, offset: Column) -> Column:
    return F.floor(rate * (before + 1) + offset) - F.floor(rate * before + offset)


def with_copies(rows: DataFrame, size: str, source: str, unit: Column, weights: Sequence[int] = WEIGHTS, most: int = MOST,
                seed: int = SEED) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies`` (0 to ``most``).

    ``unit`` tells all rows apart, and gives their draws. Rows are ranked inside (source, size class, slice), with as many slices as the rows
    of a class ask for, and one row per slice carries what stands before it, with the source's figures; so neither a source nor a
    size with a third of all rows is one task's.
    """
    klass = F.floor(F.log(F.col(size).cast("double") + 1) * 8)
    lined = rows.withColumns({"_draw": unit_draw(seed, unit, "line"), "_class": F.struct(F.col(source).alias("s"), klass.alias("c"))})
    slices = lined.groupBy("_class").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).alias("_slices"))
    slices = slices.select(F.struct(F.col("_class.s").alias("s"), F.col("_class.c").alias("c")).alias("_class"), "_slices")
    lined = lined.join(slices, "_class").withColumn("_slot", F.struct(
        F.col("_class.s").alias("s"), F.col("_class.c").alias("c"), F.floor(F.col("_draw") * F.col("_slices")).alias("d"))).drop("_class", "_slices")
    parts = lined.groupBy("_slot").agg(F.count(F.lit(1)).alias("_rows"), F.sum(size).alias("_size"))
    parts = parts.withColumn("_of", F.struct(F.col("_slot.s").alias("s")))
    totals = parts.groupBy("_of").agg(F.sum("_size").alias("source_size"))
    goals = targets(totals.select(F.col("_of.s").alias("s"), "source_size"), "s", weights, most)
    goals = goals.select(F.struct("s").alias("_of"), "source_size", "target", unit_draw(seed, F.col("s"), "offset").alias("_offset"))
    chunks = Window.partitionBy("_of").orderBy("_slot.c", "_slot.d").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_slot", "_of", F.coalesce(F.sum("_rows").over(chunks), F.lit(0)).alias("_carry")).join(goals, "_of")
    parts = parts.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).drop("_of")
    local = Window.partitionBy("_slot").orderBy(size, "_draw", unit)
    out = lined.withColumn("_rank", F.row_number().over(local) - 1).join(parts, "_slot")
    before = F.col("_carry") + F.col("_rank")
    return out.withColumn("copies", _crossed(F.col("_rate"), before, F.col("_offset")).cast("int")).drop(
        "_slot", "_rank", "_carry", "_rate", "_offset", "_draw")


def _named(key: str, text: str, source: str) -> list[Column]:
    """128 bits that tell rows apart by key, text and source, nulls included."""
    told = [c for name in (key, text, source) for c in (F.col(name), F.col(name).isNull())]
    return [F.xxhash64(F.lit(i), *told).alias(name) for i, name in enumerate(("_a", "_b"))]


def _planned(docs: DataFrame, key: str, text: str, source: str, **how) -> DataFrame:
    """One row per row of ``docs``, without its text: ``_key, _source, size, _a, _b, _nth, source_size, target, copies``.

    Rows alike in key, text and source are numbered (``_nth``), so each has a draw and a place of its own, and the same places are given out
    however the rows are spread over partitions. The text is read once.
    """
    narrow = written(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), words(F.col(text)).alias("size"), *_named(key, text, source)))
    told = numbered(narrow, "_a", ["_b"]).drop("_same")
    return with_copies(told, "size", "_source", F.concat_ws(":", "_a", "_b", "_nth"), **how)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row per row of ``docs``: key, source, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    A null text has size 0; a source without words takes nothing; null sources are one source. Rows repeated under one key are each taken
    on their own, those alike in text too. Columns besides the three named ones are not read, so their names are free.
    """
    return _planned(docs, key, text, source, **how).select(
        F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with all their columns, whatever these are called.

    Which rows are taken is settled without their texts, and comes back to them by 128 bits of key, text and source. Rows alike in all
    three are interchangeable: they are numbered here as there, and only they pass through Python.
    """
    plan = written(_planned(docs, key, text, source, **how).select("_a", "_b", "_nth", "copies"))
    alike = written(plan.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_named(key, text, source))
    once = rows.join(plan.join(alike, ["_a", "_b"], "left_anti"), ["_a", "_b"]).select("_row", "copies")
    if not alike.isEmpty():
        repeated = numbered(written(rows.join(alike, ["_a", "_b"], "left_semi")), "_a", ["_b"])
        once = once.unionByName(repeated.join(plan, ["_a", "_b", "_nth"]).select("_row", "copies"))
    return once.filter("copies > 0").select("_row", F.explode(F.expr("array_repeat(1, copies)"))).select("_row.*")
