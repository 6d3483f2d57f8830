"""The corpus pipeline: each stage calls one operator and is written and reread before the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``; the last adds ``shard`` and
``slot``. Empty tables pass through; rows without a doc_id cannot be linked or reported by key, and are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolanut.llm import decontamination, jaccard, language, mixing, sharding
from kolanut.llm.shared import as_table, written

#: Near-duplicates: five words and a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Ids (8 bytes each) up to which a list is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the kernel model of op10 finds, taught by the labelled rows; texts unlike every learned language, or without
    letters, are in none and go. If nothing is labelled, all rows stay."""
    found = language.train_known(docs, language.remainder(F.col("doc_id"), 4) != 2)
    if found is None:
        return docs
    model, known = found
    return language.predict(docs, model, known=known).filter(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def _sent(ids: DataFrame) -> DataFrame:
    """A list of ids, broadcast if it is counted to be small, so that the texts stay where they are."""
    ids = written(ids.distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest doc_id and then the smallest hash of its text.

    Groups are of rows, not of ids: other texts under the doc_id of a copy stay. Rows are told apart by 64 bits of doc_id and text.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text", F.col("text").isNull()))
    named = docs.withColumn("_row", row)
    groups = jaccard.join_components(named, key="_row", words=NEAR_WORDS, percent=NEAR_PERCENT).filter("_row is not null")
    classes = groups.groupBy("_row").agg(F.first("component_id").alias("_component"), F.count(F.lit(1)).alias("_n"))
    ids = named.filter("_row is not null").groupBy(F.col("_row").alias("_id")).agg(F.min("doc_id").alias("doc_id"))
    placed = written(classes.join(ids, F.col("_row") == F.col("_id")).drop("_id"))
    first = placed.groupBy("_component").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_first")).select("_first")
    copies = written(placed.join(first, F.col("_row") == F.col("_first"), "left_anti").select(F.col("_row").alias("_id")))
    repeated = written(placed.filter("_n > 1").select(F.col("_row").alias("_id")))
    kept = named.join(_sent(copies.unionByName(repeated)), F.col("_row") == F.col("_id"), "left_anti")
    if repeated.isEmpty():
        return kept.drop("_row")
    alike = named.join(_sent(repeated.join(copies, "_id", "left_anti")), F.col("_row") == F.col("_id"), "left_semi")
    return kept.unionByName(alike.dropDuplicates(["_row"])).drop("_row")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)
    return docs.join(_sent(found.select(F.col("doc_id").alias("_id"))), F.col("doc_id") == F.col("_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``, uniformly shuffled into shards of equal row counts."""
    return sharding.assign(docs, "doc_id", ["text"]).select(*docs.columns, "shard", "slot")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_leaks),
    ("mixture", mix_sources),
    ("shards", deal_shards),
]

#: Language identification is a fitted model, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return docs
