"""Quotation linking: replies find the messages they quote, and threads become conversations without quotes.

A line's quote level is the number of ``>`` signs before it. Quoted lines are normalised (case, white space) and hashed, and meet
the newest earlier message of the thread that has the same line as its own text. The message that the lowest quote level
that meets any agrees with most is the parent. Built-in DataFrame functions only.

A thread may hold a third of all rows, and a line may be in all its messages: searches for "the newest earlier" and places in
a conversation are taken per chunk of positions first, and only one row per chunk is carried along a thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolanut.llm.shared import written
from kolanut.operators.frames import position_chunk, running_total

_PREFIX = r"^( ?>)+"
_ATTRIBUTION = r"^On .+ wrote:[ \t\r]*$"
MAX_ROUNDS = 60
PREVIOUS, ROOT = "previous", "root"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 0), " ", ""))


def normalised(line: Column) -> Column:
    content = F.regexp_replace(line, _PREFIX, "")
    return F.trim(F.lower(F.regexp_replace(content, r"[ \t\r]+", " ")))


def own_lines(lines: Column) -> Column:
    """The lines that are not quoted, without the line that announces a quotation."""
    return F.filter(lines, lambda x, i: (level(x) == 0) & ~(
        x.rlike(_ATTRIBUTION) & (level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)))


def _newest_earlier(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """``quoted`` rows (thread, hash, at, level) with ``parent``: the largest ``at`` of ``own`` below theirs, if any."""
    slot = F.struct("thread", "hash", position_chunk(F.col("at")).alias("chunk")).alias("slot")
    used = own.join(quoted.select("thread", "hash").distinct(), ["thread", "hash"], "left_semi")
    rows = used.select(slot, "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level")).unionByName(
        quoted.select(slot, "at", F.lit(0).alias("kind"), "level"))
    mine = F.when(F.col("kind") == 1, F.col("at"))
    parts = rows.groupBy("slot").agg(F.max(mine).alias("last"))
    earlier = Window.partitionBy("slot.thread", "slot.hash").orderBy("slot.chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("slot", F.max("last").over(earlier).alias("carry"))
    local = Window.partitionBy("slot").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("near", F.last(mine, ignorenulls=True).over(local)).filter("kind = 0")
    return seen.join(parts, "slot").select("slot.thread", "at", "level", F.coalesce("near", "carry").alias("parent")).filter("parent is not null")


def _roots(parents: DataFrame) -> DataFrame:
    """``thread, at, root, depth`` of the messages that have a parent, by doubling the steps to the root.

    A message whose root has no parent is settled and not joined again; the others go on by what their root knows.
    """
    every = written(parents.select("thread", "at", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    open_, settled = every, every.limit(0)
    for _ in range(MAX_ROUNDS):
        further = every.select(F.col("thread").alias("_t"), F.col("at").alias("_a"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        met = written(open_.join(further, (F.col("thread") == F.col("_t")) & (F.col("root") == F.col("_a")), "left").select(
            "thread", "at", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            F.col("_r").isNotNull().alias("_open")))
        open_ = met.filter("_open").drop("_open")
        settled = settled.unionByName(met.filter("not _open").drop("_open"))
        if open_.isEmpty():
            return settled
        every = settled.unionByName(open_)
    raise RuntimeError(f"reply chains are not settled after {MAX_ROUNDS} rounds")


def link_quotes(messages: DataFrame, thread: str = "conv_id", at: str = "turn", text: str = "text", unquoted: str = PREVIOUS) -> DataFrame:
    """All columns of ``messages`` but the text, with ``parent_<at>``, ``root_<at>``, ``depth``, ``position``, ``linked`` and ``body``.

    ``body`` is the text without quoted lines, announcing lines and outer white space. ``linked`` says how the parent was found:
    ``quote``, or ``previous`` for a message without a quote that leads anywhere, which answers the message before it
    (``unquoted="root"`` starts a conversation there instead). A root with all that answer it, directly or not, is a conversation; ``position``
    counts from 0 by depth and then by place, so that every message comes behind its parent.

    Rows without a thread or place stand alone (depth 0, position 0). Rows repeated under one thread and place are one message for linking, and
    share parent, root and depth. Null texts have an empty body and can be parents only as the message before.
    """
    kept = [c for c in messages.columns if c != text]
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    parsed = messages.select(*[F.col(c) for c in kept], F.col(thread).alias("_thread"), F.col(at).cast("bigint").alias("_at"), lines.alias("_lines"))
    parsed = parsed.withColumn("_own", own_lines(F.col("_lines")))
    placed = parsed.filter("_thread is not null and _at is not null")
    names = [F.col("_thread").alias("thread"), F.col("_at").alias("at")]

    own = placed.select(*names, F.explode("_own").alias("line")).select("thread", "at", normalised(F.col("line")).alias("line"))
    own = own.filter("line <> ''").select("thread", F.md5("line").alias("hash"), "at").distinct()
    quoted = placed.select(*names, F.explode(F.filter("_lines", lambda x: level(x) > 0)).alias("line"))
    quoted = quoted.select("thread", "at", level(F.col("line")).alias("level"), normalised(F.col("line")).alias("line")).filter("line <> ''")
    quoted = quoted.select("thread", F.md5("line").alias("hash"), "at", "level").distinct()
    votes = _newest_earlier(own, quoted).groupBy("thread", "at", "level", "parent").agg(F.count(F.lit(1)).alias("votes"))
    parents = votes.groupBy("thread", "at").agg(F.min_by("parent", F.struct("level", -F.col("votes"), -F.col("parent"))).alias("parent"))
    parents = parents.withColumn("linked", F.lit("quote"))

    if unquoted == PREVIOUS:
        spots = placed.select(*names).distinct().withColumn("slot", F.struct("thread", position_chunk(F.col("at")).alias("chunk")))
        ends = spots.groupBy("slot").agg(F.max("at").alias("last"))
        earlier = Window.partitionBy("slot.thread").orderBy("slot.chunk")
        ends = ends.select("slot", F.lag("last").over(earlier).alias("carry"))
        before = F.coalesce(F.lag("at").over(Window.partitionBy("slot").orderBy("at")), F.col("carry"))
        previous = spots.join(ends, "slot").select("thread", "at", before.alias("before"))
        parents = previous.join(parents, ["thread", "at"], "left").select(
            "thread", "at", F.coalesce("parent", "before").alias("parent"),
            F.coalesce("linked", F.when(F.col("before").isNotNull(), F.lit(PREVIOUS))).alias("linked")).filter("parent is not null")
    parents = written(parents)
    tree = parents.join(_roots(parents), ["thread", "at"]).select(
        F.col("thread").alias("_t"), F.col("at").alias("_a"), "parent", "linked", "root", "depth")

    body = F.regexp_replace(F.array_join("_own", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    out = parsed.join(tree, (F.col("_thread") == F.col("_t")) & (F.col("_at") == F.col("_a")), "left").select(
        *kept, "_thread", "_at", F.col("parent").alias(f"parent_{at}"),
        F.when(F.col("_thread").isNotNull(), F.coalesce("root", "_at")).alias(f"root_{at}"),
        F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"), "linked", body.alias("body"))
    whole = F.col("_thread").isNotNull() & F.col("_at").isNotNull()
    ordered = running_total(out.filter(whole), ["_thread", f"root_{at}"], ["depth", "_at", "body"], F.lit(1),
                            F.struct("depth", position_chunk(F.col("_at")).alias("chunk")), "position")
    return ordered.unionByName(out.filter(~whole).withColumn("position", F.lit(0).cast("bigint"))).drop("_thread", "_at")
