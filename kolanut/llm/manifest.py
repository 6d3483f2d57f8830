"""Merkle manifest of a dataset: nested intervals label the nodes, joins by level attach their ancestors.

Rows are leaves, ranked within their group. A node of level k covers an interval of leaf ranks ``[lo, hi)`` that begins at a
multiple of ``FAN ** k``, so the intervals of one group are nested and one node of a level covers a given rank. A node meets its
parent in the bucket (group, ``lo`` divided by the parent level's width) and by containment of the intervals; its siblings are what
the parent's interval holds besides its own. Parents are attached from the root down, so that no bucket holds more than ``FAN``
rows, however large the group. The roots of the groups are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolanut.llm.shared import written

FAN = 16
#: Rows up to which the list of runs (one row per range partition and group in it) is broadcast; a longer one is joined by a shuffle.
BROADCAST_RUNS = 1 << 16


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as leaf input: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    told = value.cast("string")
    return F.when(told.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def fold(of: Column, steps: Column) -> Column:
    """The root that a leaf digest leads to when its siblings are put around it, step by step."""
    return F.aggregate(steps, of, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(steps: Column) -> Column:
    """The hex digests of all siblings, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), "")


def _step(kids: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval holds besides ``[lo, hi)``, before it and behind it."""
    def joined(wanted) -> Column:
        return F.array_join(F.transform(F.filter(kids, wanted), lambda kid: kid["digest"]), "")
    return F.struct(joined(lambda kid: kid["hi"] <= lo).alias("left"), joined(lambda kid: kid["lo"] >= hi).alias("right"))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (``_group``, ...) with ``lo`` (rank within the group, from 0) and ``n`` (the group's rows).

    Rows are sorted over range partitions, so a large group is dealt over many tasks; alike rows are told apart by their
    place in the input. Only one row per partition and group is summed up within a group.
    """
    keys = [F.col("_group").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_place").asc()]
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.drop("_place").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(part.alias("_run_part"), F.col("_group").alias("_run_group")).agg(
        F.min("_at").alias("_run_at"), F.count(F.lit(1)).alias("_run_n"))
    all_runs = Window.partitionBy("_run_group")
    runs = written(runs.select("*", F.sum("_run_n").over(all_runs).alias("n"), F.coalesce(
        F.sum("_run_n").over(all_runs.orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    sent = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    joined = placed.join(sent, (part == F.col("_run_part")) & F.col("_group").eqNullSafe(F.col("_run_group")))
    return joined.withColumn("lo", F.col("_at") - F.col("_run_at") + F.col("_before")).drop(
        "_at", "_run_part", "_run_group", "_run_at", "_run_n", "_before")


def _levels(ranked: DataFrame, payload: str) -> list[DataFrame]:
    """Nodes of the levels 1, 2, ...: ``_group, n, lo, hi, digest, kids``. A group goes no higher than its root.

    Kids of level 1 also carry ``payload``. A group of one row has no node above it: its level-1 row has the leaf's own digest.
    """
    levels, nodes = [], ranked.withColumn("hi", F.col("lo") + 1)
    most = nodes.agg(F.max("n")).first()[0] or 0
    width = 1
    while not levels or width < most:
        kid = F.struct("lo", "hi", "digest", *([] if levels else [payload]))
        grown = nodes.filter(F.col("n") > width) if levels else nodes
        width *= FAN
        above = grown.groupBy("_group", F.floor(F.col("lo") / width).alias("_bucket")).agg(
            F.first("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(kid)).alias("kids"))
        joined = digest(F.array_join(F.transform("kids", lambda k: k["digest"]), ""))
        levels.append(written(above.drop("_bucket").withColumn(
            "digest", F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(joined))))
        nodes = levels[-1].drop("kids")
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """``_group, digest`` of the nodes that cover their whole group."""
    whole = [nodes.filter(F.col("hi") - F.col("lo") == F.col("n")).select("_group", "digest") for nodes in levels]
    out = whole[0]
    for frame in whole[1:]:
        out = out.unionByName(frame)
    return out


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Level 1 with ``steps`` and what ``tops`` (``_top_group``, ``steps``, ...) says of the group.

    From the highest level down, a node takes the steps of its parent (or, a root, of its group) behind its own one.
    """
    told = [c for c in tops.columns if c != "_top_group"]
    known = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        root = F.col("hi") - F.col("lo") == F.col("n")
        held = nodes.filter(root).join(tops, F.col("_group").eqNullSafe(F.col("_top_group"))).drop("_top_group")
        if known is not None:
            width = FAN ** (level + 1)
            parents = known.select(F.col("_group").alias("_up_group"), F.floor(F.col("lo") / width).alias("_up_bucket"), F.col("lo").alias("_up_lo"),
                                   F.col("hi").alias("_up_hi"), F.col("kids").alias("_up_kids"), *told)
            inner = nodes.filter(~root).withColumn("_bucket", F.floor(F.col("lo") / width))
            inner = inner.join(parents, F.col("_group").eqNullSafe(F.col("_up_group")) & (F.col("_bucket") == F.col("_up_bucket"))
                               & (F.col("_up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_up_hi")))
            own = F.array(_step(F.col("_up_kids"), F.col("lo"), F.col("hi")))
            held = held.unionByName(inner.withColumn("steps", F.concat(own, "steps")).select(held.columns))
        known = held
    return known


def _leaf_paths(paths: DataFrame, payload: str, told: list[str]) -> DataFrame:
    """One row per leaf: its digest, payload and steps."""
    out = paths.select("n", "kids", "steps", *told, F.explode("kids").alias("_kid"))
    own = F.array(_step(F.col("kids"), F.col("_kid.lo"), F.col("_kid.hi")))
    steps = F.when(F.col("n") == 1, F.col("steps")).otherwise(F.concat(own, "steps"))
    return out.select(F.col(f"_kid.{payload}").alias(payload), F.col("_kid.digest").alias("digest"), steps.alias("steps"), *told)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", leaf_of: Column | None = None,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """``key, group, leaf, subroot, root, steps`` and the ``carry`` columns, one row per row of ``docs``.

    ``leaf_of`` is the leaf digest (by default of all columns of documents); ``steps`` is the proof: an array of (left, right), the hex
    digests beside the node on each level from the leaf to the root. Leaves of a group ascend by key (null first), then by
    digest; rows alike in both have equal leaves, each with its own place. Groups ascend bytewise, the null group first. A group of one row is
    its own subroot, a single group's subroot is the root; an empty table has no rows and no root. Other columns of ``docs`` are not
    read, so their names cannot clash. Texts are hashed where they are read; only digests, keys and the carried columns are shuffled.
    """
    if leaf_of is None:
        leaf_of = leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    carry = carry or {}
    held = F.struct(F.col(key).alias("_key"), *(value.alias(f"_carried_{i}") for i, value in enumerate(carry.values())))
    rows = docs.select(F.col(group).alias("_group"), held.alias("_row"), leaf_of.alias("digest"))
    levels = _levels(_ranked(rows.withColumn("_key", F.col("_row._key")), ["_key", "digest"]).drop("_key"), "_row")

    subroots = _roots(levels).select(F.lit(0).alias("_group"), F.col("_group").alias("_name"), "digest")
    top_levels = _levels(_ranked(subroots, ["_name"]), "_name")
    no_steps = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    top = _roots(top_levels).select(F.col("_group").alias("_top_group"), F.col("digest").alias("root"), no_steps.alias("steps"))
    named = _leaf_paths(_paths(top_levels, top), "_name", ["root"])
    tops = written(named.select(F.col("_name").alias("_top_group"), "steps", F.col("digest").alias("subroot"), "root"))

    paths = _paths(levels, tops)
    out = _leaf_paths(paths.select("*", F.col("_group").alias("_name")), "_row", ["_name", "subroot", "root"])
    return out.select(F.col("_row._key").alias(key), F.col("_name").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "steps",
                      *(F.col(f"_row._carried_{i}").alias(name) for i, name in enumerate(carry)))
