"""W5 over a table of turns: the prompt of a turn is everything said before it.

Prompts of one conversation are prefixes of one text, so they are cut in runs of turns. A run's own text travels to the later runs of its
conversation, ahead of their turns, and a task that reads a run in order keeps the text so far and gives out a prompt where one is asked.
No row holds more than one prompt, and no conversation is gathered in a row.

Prompts together grow with the square of a conversation, whatever makes them. ``digest=True`` gives their lengths and MD5 sums instead,
for comparing corpora of long conversations: the sum's state is carried on, so each run is read once and nothing else is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.operators.frames import position_chunk

#: Turns of a run, and the characters after which a task hands on the prompts that it has made.
RUN = 512
HANDED = 1 << 24
_FIRST = -(1 << 62)


def said(role: str | Column = "role", text: str | Column = "text", said_chars: int | None = None) -> Column:
    """What a turn adds to the prompts after it: a question opens the assistant, anything else opens the user.

    A null text is empty; ``said_chars`` cuts what is not a question.
    """
    role, text = (F.col(c) if isinstance(c, str) else c for c in (role, text))
    body = F.coalesce(text, F.lit(""))
    other = body if said_chars is None else F.left(body, F.lit(said_chars))
    return F.when(role == "user", F.concat(F.lit("\n"), body, F.lit("\n" + t.ASSISTANT))).otherwise(
        F.concat(F.lit("\n"), other, F.lit(t.USER)))


class _Text:
    """The prompt so far, as text."""

    def __init__(self, head: str):
        self.text, self.new = head, []

    def add(self, part: str) -> None:
        self.new.append(part)

    def out(self) -> tuple:
        self.text, self.new = "".join([self.text, *self.new]), []
        return (self.text,)


class _Digest:
    """The prompt so far, as length and state of its sum."""

    def __init__(self, head: str):
        self.n, self.sum = 0, hashlib.md5()
        self.add(head)

    def add(self, part: str) -> None:
        self.n += len(part)
        self.sum.update(part.encode())

    def out(self) -> tuple:
        return self.n, self.sum.hexdigest()


def _read_runs(head: str, kind: type, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, so_far, done, size = None, None, [], 0
        for batch in batches:
            for conv, chunk, turn, asks, part in zip(*(batch.column(c).to_pylist() for c in ("_conv", "_chunk", "_turn", "_asks", "_part")), strict=True):
                if (conv, chunk) != run:
                    run, so_far = (conv, chunk), kind(head)
                so_far.add(part)
                if asks:
                    done.append((conv, turn, *so_far.out()))
                    size += len(done[-1][2]) if kind is _Text else 1
                if size >= HANDED:
                    yield _batch(done, schema)
                    done, size = [], 0
            if done:
                yield _batch(done, schema)
                done, size = [], 0
    return read


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def turn_history(turns: DataFrame, conv: str, turn: str, part: Column, asks: Column, head: str = "", digest: bool = False,
                 run: int = RUN) -> DataFrame:
    """``conv, turn, prompt`` of each turn that ``asks``: ``head`` and the parts of all turns up to it, in the order of ``turn``.

    ``conv`` is a whole number, ``turn`` an integer position, with gaps or not; ``part`` is the text a turn adds. Turns without a position
    come first, turns alike in it go by their parts; null conversations are one conversation, a null part is empty, and a null
    ``asks`` asks nothing. With ``digest`` the columns are ``conv, turn, n_chars, md5``. Other columns are not read.
    """
    rows = turns.select(F.col(conv).cast("bigint").alias("_conv"), F.col(turn).cast("bigint").alias("_turn"),
                        F.coalesce(part, F.lit("")).alias("_part"), F.coalesce(asks, F.lit(False)).alias("_asks"))
    rows = rows.withColumn("_at", F.coalesce("_turn", F.lit(_FIRST))).withColumn("_chunk", position_chunk(F.col("_at"), run))
    # only conversations of several runs send texts ahead
    runs = rows.select("_conv", "_chunk").distinct().groupBy(F.struct("_conv").alias("_of")).agg(F.collect_list("_chunk").alias("_runs"))
    runs = runs.filter(F.size("_runs") > 1)
    long = rows.withColumn("_of", F.struct("_conv")).join(runs, "_of", "left_semi")
    texts = long.groupBy("_of", "_chunk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]), "").alias("_part"))
    ahead = texts.join(runs, "_of").select(F.col("_of._conv").alias("_conv"), F.explode(F.filter("_runs", lambda c: c > F.col("_chunk"))).alias("_to"),
                                           F.col("_chunk").alias("_at"), "_part")
    ahead = ahead.select("_conv", F.col("_to").alias("_chunk"), F.lit(0).alias("_kind"), "_at", "_part",
                         F.lit(None).cast("bigint").alias("_turn"), F.lit(False).alias("_asks"))
    both = ahead.unionByName(rows.withColumn("_kind", F.lit(1)))
    placed = both.repartition("_conv", "_chunk").sortWithinPartitions("_conv", "_chunk", "_kind", "_at", "_part").drop("_kind", "_at")
    made = (("n_chars", pa.int64(), "BIGINT"), ("md5", pa.string(), "STRING")) if digest else (("prompt", pa.string(), "STRING"),)
    schema = pa.schema([("_conv", pa.int64()), ("_turn", pa.int64()), *((n, kind) for n, kind, _ in made)])
    out = placed.mapInArrow(_read_runs(head, _Digest if digest else _Text, schema),
                            "_conv BIGINT, _turn BIGINT, " + ", ".join(f"{n} {kind}" for n, _, kind in made))
    return out.withColumnsRenamed({"_conv": conv, "_turn": turn})
