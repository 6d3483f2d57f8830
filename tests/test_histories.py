"""Prompts over a table of turns against a plain walk."""

import hashlib
import random

from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.operators import histories

TURNS = "conv BIGINT, turn BIGINT, role STRING, text STRING"


def walk(rows, head):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, part(r)))
        so_far = head
        for r in mine:
            so_far += part(r)
            if r[2] == "user":
                out.setdefault((conv, r[1]), []).append(so_far)
    return {k: sorted(v) for k, v in out.items()}


def part(r):
    return f"\n{r[3] or ''}\n{t.ASSISTANT}" if r[2] == "user" else f"\n{r[3] or ''}{t.USER}"


def found(df, value):
    out = {}
    for r in df.collect():
        out.setdefault((r["conv"], r["turn"]), []).append(r[value])
    return {k: sorted(v) for k, v in out.items()}


def odd_turns(rng):
    rows = [(c, i, rng.choice(["user", "assistant", "system", None]), rng.choice(["", "é 漢 😀", "a\nb", None, "x" * rng.randint(1, 90)]))
            for c in range(6) for i in sorted(rng.sample(range(-5, 60), rng.randint(1, 40)))]
    rows += [(None, i, "user", f"n{i}") for i in range(9)]  # null conversations are one
    rows += [(7, None, "user", "no place"), (7, 3, "user", "b"), (7, 3, "user", "a"), (7, 3, "user", "a"), (7, 9, "assistant", "z")]
    return rows


def test_prompts_under_many_cuts(spark):
    rows = odd_turns(random.Random(3))
    want = walk(rows, "<head>")
    df = spark.createDataFrame(rows, TURNS).withColumns({"_conv": F.lit(1), "prompt": F.lit("x"), "_part": F.lit("y")})
    for run, parts in ((1, 1), (4, 7), (7, 3), (512, 4)):
        args = (df.repartition(parts), "conv", "turn", histories.said(), F.col("role") == "user", "<head>")
        assert found(histories.turn_history(*args, run=run), "prompt") == want
        sums = {k: sorted(hashlib.md5(p.encode()).hexdigest() for p in v) for k, v in want.items()}
        assert found(histories.turn_history(*args, digest=True, run=run), "md5") == sums


def test_cut_answers_and_no_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "abcdef"), (1, 1, "user", "abcdef")], TURNS)
    got = histories.turn_history(df, "conv", "turn", histories.said(said_chars=2), F.col("role") == "user")
    assert got.first()["prompt"] == f"\nab{t.USER}\nabcdef\n{t.ASSISTANT}"
    empty = histories.turn_history(df.limit(0), "conv", "turn", histories.said(), F.lit(True))
    assert empty.columns == ["conv", "turn", "prompt"] and empty.count() == 0


def test_a_prompt_is_handed_on_when_it_is_large():
    """A task holds the prompts of at most one batch, whatever its run gives out."""
    import pyarrow as pa
    schema = pa.schema([("_conv", pa.int64()), ("_turn", pa.int64()), ("prompt", pa.string())])
    n, step = 400, 1 << 18
    batch = pa.RecordBatch.from_pydict({"_conv": [1] * n, "_chunk": [0] * n, "_turn": list(range(n)), "_asks": [i % 4 == 3 for i in range(n)],
                                        "_part": ["x" * step] * n})
    sizes = [b.nbytes for b in histories._read_runs("", histories._Text, schema)(iter([batch]))]
    assert len(sizes) > n // 8 and max(sizes) < histories.HANDED + n * step + (1 << 20)


def test_a_conversation_of_a_hundred_thousand_turns(spark):
    """All its prompts together hold some 37 GB; their sums take one pass that holds none of them."""
    n = 100_000
    df = spark.range(n).select(F.lit(5).cast("bigint").alias("conv"), F.col("id").alias("turn"),
                               F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), (F.col("id") % 10).cast("string").alias("text"))
    got = histories.turn_history(df, "conv", "turn", histories.said(), F.col("role") == "user", digest=True, run=4096)
    rows = {r["turn"]: (r["n_chars"], r["md5"]) for r in got.collect()}
    state, length = hashlib.md5(), 0
    assert len(rows) == n // 2
    for i in range(n):
        p = part((5, i, "assistant" if i % 2 else "user", str(i % 10)))
        length += len(p)
        state.update(p.encode())
        if i % 2 == 0:
            assert rows[i] == (length, state.copy().hexdigest())
