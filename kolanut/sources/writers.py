"""Partitioned sinks. The commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.operators.packing import assign_shards, manifest, with_counts


def write_staged(df: DataFrame, root: str) -> None:
    """Records by (type, lang), with all the fields they have.

    About sixty groups, some with a third of all rows: the rebalance hint gathers each group and
    splits the large ones into files of the advisory size.
    """
    (df.select(*[c for c in df.columns if c not in ("type", "lang")], "type", "lang")
     .hint("rebalance", "type", "lang").write.mode("overwrite").partitionBy("type", "lang").json(root))


def write_clean(df: DataFrame, path: str, source: str | None = None) -> None:
    """Kept records. The target must not be the folder they were read from."""
    if source is not None and f"{path.rstrip('/')}/".startswith(f"{source.rstrip('/')}/"):
        raise ValueError("write the kept records outside the folder they are read from")
    df.write.mode("overwrite").json(path)


def write_shards(df: DataFrame, root: str, cap: int = t.SHARD_TOKENS, key: str = "example_id", seed: int = 18) -> DataFrame:
    """Encoded examples as Parquet, one folder per shard, and the manifest beside them."""
    placed = assign_shards(with_counts(df), "n_tokens", key, cap, seed)
    # ranges of the order: as many tasks as shards of a task's size, each shard in order however many tasks write it
    tasks = max(1, placed.agg(F.max("shard_id").alias("s")).first().s or 0) + 1
    (placed.repartitionByRange(tasks, "shard_id", "shard_order").sortWithinPartitions("shard_id", "shard_order", key)
     .write.mode("overwrite").partitionBy("shard_id").parquet(f"{root}/shards"))
    written = df.sparkSession.read.schema(placed.schema).parquet(f"{root}/shards")
    index = manifest(written)
    index.write.mode("overwrite").parquet(f"{root}/manifest")
    return df.sparkSession.read.parquet(f"{root}/manifest")


def write_split(df: DataFrame, train: str, hold: str, flag: str = "held_out") -> None:
    """Training and held-out rows to separate places."""
    df.filter(~F.col(flag)).drop(flag).write.mode("overwrite").parquet(train)
    df.filter(F.col(flag)).drop(flag).write.mode("overwrite").parquet(hold)


def write_report(scored: DataFrame, summary: DataFrame, root: str) -> None:
    """Scored rows and their summary."""
    scored.write.mode("overwrite").parquet(f"{root}/rows")
    summary.write.mode("overwrite").json(f"{root}/summary")
