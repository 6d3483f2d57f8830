"""Records meet the seeds, cases meet completions, guards stop bad inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from kolanut.operators.frames import position_chunk, running_total

#: A block of the holdout's Bloom filter, the bits set for a key, and the keys up to which the filter (2 bytes each) is broadcast.
BLOOM_BITS, BLOOM_PROBES, BLOOM_KEYS = 1 << 15, 4, 1 << 25


class GuardError(RuntimeError):
    """An input that must not reach training or scoring."""


def last_wave(seeds: DataFrame) -> DataFrame:
    """One seed per id; the last wave, and in it the last row, wins."""
    cols = [c for c in seeds.columns if c not in ("id", "_wave", "_file", "_pos")]
    order = F.struct(*[c for c in ("_wave", "_file", "_pos") if c in seeds.columns])
    best = seeds.groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("s"))
    return best.select("id", "s.*")


def first_copy(records: DataFrame) -> DataFrame:
    """One row per id, the first in input order, with ``copies`` and its place in ``_order``.

    An aggregate, not a window: copies of a hot id collapse inside each map task, so no task ever
    holds them all, and the result is already partitioned by id for the join.
    """
    cols = [c for c in records.columns if c not in ("id", "_wave", "_file", "_pos", "_corrupt")]
    order = F.struct(*[c for c in ("_wave", "_file", "_pos") if c in records.columns])
    bad = F.col("_corrupt").isNotNull() if "_corrupt" in records.columns else F.lit(False)
    rows = records.select("id", F.when(~bad, F.struct(*cols)).alias("r"), F.when(~bad, order).alias("o"), bad.alias("bad"))
    best = rows.groupBy("id").agg(
        F.min_by("r", "o").alias("r"), F.min("o").alias("_order"), F.count_if(~F.col("bad")).alias("copies"),
        F.count_if("bad").alias("unparseable"))
    return best.select("id", "r.*", "_order", "copies", "unparseable")


def attach_menu(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each id once, with its seed's menu; the seed's ``current`` wins over the record's.

    ``status`` is ``ok`` or ``no_seed``; ``copies`` and ``unparseable`` carry the loss counts.
    """
    side = last_wave(seeds).select(
        "id", F.col("menu").alias("_menu"), F.col("current").alias("_seed_current"), F.lit(True).alias("_seeded"))
    joined = first_copy(records).join(side, "id", "left")
    current = F.coalesce("_seed_current", F.col("input")["current"])
    return (
        joined.withColumn("status", F.when(F.col("_seeded"), "ok").otherwise("no_seed"))
        .withColumn("input", F.when(
            F.col("input").isNotNull() | F.col("_seed_current").isNotNull(),
            _with_current(joined, current)))
        .withColumn("menu", F.col("_menu"))
        .withColumn("lang", F.coalesce("lang", F.lit("eng")))
        .drop("_menu", "_seed_current", "_seeded")
    )


def _with_current(df: DataFrame, current: Column) -> Column:
    """``input`` with all its fields, its pending call replaced."""
    fields = [f.name for f in df.schema["input"].dataType.fields if f.name != "current"]
    return F.struct(*[F.col("input")[f].alias(f) for f in fields], current.alias("current"))


def joined(df: DataFrame) -> DataFrame:
    """The records that found their seed."""
    return df.filter(F.col("status") == "ok").drop("status", "copies", "unparseable")


def join_report(df: DataFrame) -> DataFrame:
    """Written, unmatched, duplicate and unparseable rows in one pass."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return df.agg(
        F.count_if(ok & (F.col("copies") > 0)).alias("written"),
        total(F.when(~ok, F.col("copies"))).alias("no_seed"),
        total(F.when(ok, F.greatest(F.col("copies") - 1, F.lit(0)))).alias("duplicates"),
        total(F.col("unparseable")).alias("unparseable"),
    )


def group_counts(df: DataFrame) -> DataFrame:
    """Written records per (type, lang), sorted."""
    return df.filter(F.col("status") == "ok").groupBy("type", "lang").agg(
        F.count(F.lit(1)).alias("n")).orderBy("type", "lang")


def with_completions(cases: DataFrame, completions: DataFrame, keys: Sequence[str] = ("suite", "case_id")) -> DataFrame:
    """Completions joined to their case by explicit keys."""
    return completions.join(cases, list(keys), "inner")


def zip_completions(cases: DataFrame, completions: DataFrame, case_order: str, completion_order: str) -> DataFrame:
    """The n-th completion goes with the n-th case, for completions written without a key.

    Both orders are unique integer positions, with gaps or not. Rows are numbered chunk by chunk and meet by number; a number that
    only one side has (inputs of unequal length) raises where ``place`` is read. Columns of both sides stay, and must differ by name.
    """
    def numbered(df: DataFrame, order: str, side: str) -> DataFrame:
        rows = running_total(df, [], [order], F.lit(1), position_chunk(F.col(order)), "_place")
        return rows.withColumn(side, F.lit(True))

    clash = set(cases.columns) & set(completions.columns)
    if clash:
        raise GuardError(f"columns on both sides: {sorted(clash)}")
    both = numbered(cases, case_order, "_case").join(numbered(completions, completion_order, "_completion"), "_place", "full")
    whole = F.coalesce(F.col("_case") & F.col("_completion"), F.lit(False))
    uneven = F.raise_error(F.concat(F.lit("cases and completions differ in number from row "), F.col("_place").cast("string")))
    checked = both.withColumn("place", F.when(whole, F.col("_place")).otherwise(uneven.cast("bigint")))
    return checked.select("place", *cases.columns, *completions.columns)


def _probes(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key in a Bloom filter, and its bits there, numbered from 0."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    return block, [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOOM_BITS)) for i in range(BLOOM_PROBES)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """A Bloom filter as a table: ``_block`` and its bitmap of ``BLOOM_BITS`` bits."""
    block, bits = _probes(F.col(key), blocks)
    return keys.select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit")).groupBy("_block").agg(
        F.bitmap_construct_agg("_bit").alias("_bits"))


def maybe_in(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter, all that are in it among them; nothing but the filter is moved."""
    block, bits = _probes(F.col(key), blocks)
    met = df.withColumn("_block", block).join(F.broadcast(bloom), "_block")
    for bit in bits:
        byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = met.filter(F.bit_get(byte, (bit % 8).cast("int")) == 1)
    return met.drop("_block", "_bits")


def leaked(df: DataFrame, holdout: DataFrame, key: str = "id") -> DataFrame:
    """Held-out keys that occur in the training input, with how often.

    Training keys are tried against a Bloom filter of the holdout where they are read (16 bits a held-out key, in tables of 4 KB that
    are broadcast up to ``BLOOM_KEYS`` keys), so only held-out keys and some few others are exchanged; those are joined exactly. A larger
    holdout is joined without the filter. Counted before the join, so copies of one key meet the holdout as one row. Null keys are
    in no holdout.
    """
    held = holdout.select(key).filter(F.col(key).isNotNull())
    rows, n = df.select(key), held.count()
    alike = df.schema[key].dataType == holdout.schema[key].dataType and not isinstance(df.schema[key].dataType, FractionalType)
    if alike and n <= BLOOM_KEYS:  # equal keys have equal hashes only in one type
        blocks = max(1, -(-n * 16 // BLOOM_BITS))
        rows = maybe_in(rows, key, bloom_filter(held, key, blocks), blocks)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(held.distinct(), key, "left_semi")


def assert_no_leak(df: DataFrame, holdout: DataFrame, key: str = "id") -> None:
    found = [r[key] for r in leaked(df, holdout, key).limit(5).collect()]
    if found:
        raise GuardError(f"held-out keys in the training input: {found}")


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys that do not occur: languages without a rule, models without output."""
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def assert_covered(expected: DataFrame, present: DataFrame, key: str) -> None:
    found = [r[key] for r in missing(expected, present, key).limit(5).collect()]
    if found:
        raise GuardError(f"no {key} for: {found}")
