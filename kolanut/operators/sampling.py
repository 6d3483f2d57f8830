"""Shuffles, caps, holdouts and mixtures by keyed draw."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.draws import RANGE, draw
from kolanut.operators.frames import CHUNK, first_k, position_chunk, running_total, union_all
from kolanut.operators.joins import GuardError

DRAW_CHUNK = 1 << 16  # 65,536 chunks of the draw's range


def _draw_chunk() -> Column:
    return F.floor(F.col("_draw") / F.lit(DRAW_CHUNK))


def shuffle(df: DataFrame, key: str, seed: int = 18) -> DataFrame:
    """A global order by keyed draw; a range-partitioned sort."""
    return df.withColumn("_draw", draw(seed, F.col(key), "shuffle")).orderBy("_draw", key).drop("_draw")


def split_holdout(df: DataFrame, k: int, seed: int, prefix: tuple[str, str] | None = None, key: str = "id") -> DataFrame:
    """Flags the k rows with the smallest draws as ``held_out`` and renames their ids.

    Only the cut-off (draw, key) is computed, from counts per draw bucket and the few rows of the
    first buckets; the rows themselves are not shuffled.
    """
    drawn = df.withColumn("_draw", draw(seed, F.col(key), "holdout"))
    narrow = drawn.select("_draw", F.col(key).alias("_key"))
    upto = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    buckets = narrow.groupBy(_draw_chunk().alias("_chunk")).agg(F.count(F.lit(1)).alias("n"))
    last = (buckets.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
            .filter(F.col("before") < k).agg(F.max("_chunk").alias("c")))
    cut = (narrow.filter(_draw_chunk() <= last.scalar()).orderBy("_draw", "_key").limit(k)
           .agg(F.max(F.struct("_draw", "_key")).alias("cut")))
    held = F.coalesce(F.struct(F.col("_draw"), F.col(key).alias("_key")) <= cut.scalar(), F.lit(False))
    out = drawn.withColumn("held_out", held).drop("_draw")
    if prefix is None:
        return out
    old, new = prefix
    return out.withColumn(key, F.when(F.col("held_out"), F.replace(F.col(key), F.lit(old), F.lit(new))).otherwise(F.col(key)))


def cap_per_group(df: DataFrame, keys: Sequence[str], order: str, n: int, chunk: Column | None = None) -> DataFrame:
    """The first n rows of each group in input order (``order`` is an integer position)."""
    return first_k(df, keys, [order], n, position_chunk(F.col(order)) if chunk is None else chunk).drop("rank")


def exhibit(df: DataFrame, key: str, order: str, k: Mapping[str, int] = t.SHOW, default: int = 1,
            chunk: Column | None = None) -> DataFrame:
    """The first few rows per type, two for patches."""
    wanted = F.lit(default)
    for kind, n in k.items():
        wanted = F.when(F.col(key) == kind, n).otherwise(wanted)
    return first_k(df, [key], [order], wanted, position_chunk(F.col(order)) if chunk is None else chunk)


def stratified_sample(df: DataFrame, limit: int, key: str = "id", shots: str = "shots", seed: int = 7) -> DataFrame:
    """A third of the limit from sequences, the rest from singles, by keyed draw.

    Fewer sequences leave their places to singles; fewer singles leave places empty.
    """
    drawn = (df.withColumn("_draw", draw(seed, F.col(key), "sample"))
             .withColumn("_shots", F.coalesce(F.nullif(F.col(shots), F.lit(0)), F.lit(1)))
             .filter(F.col("_shots") >= 1).withColumn("is_seq", F.col("_shots") > 1).drop("_shots"))
    share = max(1, limit // 3)
    sequences = drawn.agg(F.count_if("is_seq").alias("n")).scalar()
    quota = F.when(F.col("is_seq"), F.lit(share)).otherwise(F.lit(limit))
    picked = first_k(drawn, ["is_seq"], ["_draw", key], quota, _draw_chunk(), at_most=2 * limit)
    want_seq = F.least(sequences, F.lit(share))
    return picked.filter(F.col("is_seq") | (F.col("rank") <= limit - want_seq)).drop("_draw", "rank")


def copies_of(kind: Column, factors: Mapping[str, int] = t.DUP, default: int = 1) -> Column:
    """How often a row of a type stands in the corpus."""
    factor = F.lit(default)
    for name, n in factors.items():
        factor = F.when(kind == name, n).otherwise(factor)
    return factor


def upsample(df: DataFrame, factors: Mapping[str, int] = t.DUP, key: str = "type", default: int = 1) -> DataFrame:
    """T4: each row as often as its type's factor; ``copy`` numbers the copies."""
    factor = copies_of(F.col(key), factors, default)
    return df.withColumn("copy", F.explode(F.slice(
        F.array(*[F.lit(i) for i in range(1, max([default, *factors.values()]) + 1)]), F.lit(1), factor)))


def _held(sources: Mapping[str, DataFrame], size: str, required: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Total size and rows of every source, one pair per source; a required one without any size stops the build."""
    sums = union_all([df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("have"), F.count(F.lit(1)).alias("rows"))
                      .select(F.lit(name).alias("source"), "have", "rows") for name, df in sources.items()])
    have = {r["source"]: (r["have"], r["rows"]) for r in sums.collect()}
    empty = [s for s in required if not have.get(s, (0, 0))[0]]
    if empty:
        raise GuardError(f"required sources are missing or empty: {empty}")
    return have


def mix(sources: Mapping[str, DataFrame], weights: Mapping[str, int], size: str, key: str,
        budget: int | None = None, required: Sequence[str] | None = None, seed: int = 18) -> DataFrame:
    """T5: a union in which every source holds its weight's share of the ``size`` total.

    Rows are kept by keyed draw, so the shares hold up to the draw's spread. Without a budget the
    largest one every source can fill is used. A required source with no rows stops the build.
    """
    total = sum(weights.values())
    have = {s: n for s, (n, _) in _held(sources, size, list(weights) if required is None else required).items()}
    if budget is None:
        budget = min(have[s] * total // w for s, w in weights.items())
    parts = []
    for name, df in sources.items():
        rate = min(1.0, budget * weights[name] / total / have[name]) if have[name] else 0.0
        parts.append(df.withColumn("source", F.lit(name)).filter(
            draw(seed, F.concat_ws(":", F.lit(name), F.col(key).cast("string")), "mix") < rate * RANGE))
    return union_all(parts)


def interleave(sources: Mapping[str, DataFrame], weights: Mapping[str, int], size: str, key: str,
               budget: int | None = None, required: Sequence[str] | None = None, seed: int = 18) -> DataFrame:
    """T5: the mixture as a sequence, ``position`` from 0: every beginning of it holds the weights, within one row of each source.

    A source's rows stand in keyed order, and a row's time is the size of the rows before it in its source, over the source's weight;
    rows go by their times. So when the sequence has come to a time, each source has given out that time's weight in size, but for
    the row that it is in. Times are whole numbers (multiples of one over the weights' least common multiple).

    The sequence ends where the first source does, or with ``budget`` in size; a source without a weight takes no part, and
    weights are positive. Null sizes count as 0, and given columns ``source``, ``position``, ``_time``, ``_draw`` and ``_size`` are replaced. Sums along a source and along the sequence are taken in two levels, so a source with nearly all rows is spread.
    """
    if min(weights.values()) <= 0:
        raise ValueError(f"weights are positive: {dict(weights)}")
    have = _held({s: df for s, df in sources.items() if s in weights}, size, list(weights) if required is None else required)
    have = {s: x for s, x in have.items() if x[0]}
    unit = math.lcm(*[weights[s] for s in have])
    end = min((have[s][0] * (unit // weights[s]) for s in have), default=0)
    if budget is not None:
        end = min(end, -(-budget * unit // sum(weights[s] for s in have)))
    lined = [running_total(
        sources[s].withColumns({"source": F.lit(s), "_size": F.coalesce(F.col(size), F.lit(0)).cast("bigint"),
                                "_draw": draw(seed, F.concat_ws(":", F.lit(s), F.col(key).cast("string")), "line")}),
        [], ["_draw", key, "_size", size], F.col("_size"), _draw_chunk(), "_time").withColumn("_time", F.col("_time") * (unit // weights[s])) for s in have]
    if not lined:
        some = next(iter(sources.values()))
        return some.withColumns({"source": F.lit(""), "position": F.lit(0).cast("bigint")}).limit(0)
    rows = union_all(lined).filter(F.col("_time") < end)
    step = max(1, end * CHUNK // max(1, sum(n for _, n in have.values())))
    # a row of no size shares its time with the row behind it: the order goes on by source and place in the line
    return running_total(rows, [], ["_time", "source", "_draw", key, "_size", size], F.lit(1), F.floor(F.col("_time") / F.lit(step)), "position").drop(
        "_time", "_draw", "_size")
