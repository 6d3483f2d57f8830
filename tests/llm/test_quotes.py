import random

import pytest

from kolanut.llm import quotes
from kolanut.operators import frames

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def by_turn(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


def test_nested_quotes_find_their_messages(spark):
    rows = [
        (1, 0, "a", "Shall we meet?\nMonday or Tuesday?\n\nBye"),
        (1, 1, "b", "On Mon, A wrote:\n> Shall  we MEET?\n> Monday or Tuesday?\nTuesday."),
        (1, 2, "c", ">> Monday or Tuesday?\n> Tuesday.\n\nFine with me."),
        (1, 3, "d", "> Monday or Tuesday?\nI prefer Monday."),
        (1, 4, "e", "> > Tuesday.\n> unknown words\nDeeper quote only."),
        (1, 5, "f", "> never said\nnew subject"),
        (2, 0, "a", "> Shall we meet?\nother thread"),
    ]
    got = by_turn(quotes.link_quotes(spark.createDataFrame(rows, SCHEMA), unquoted=quotes.ROOT))
    assert [got[1, t].parent_turn for t in range(6)] == [None, 0, 1, 0, 1, None]
    assert [got[1, t].depth for t in range(6)] == [0, 1, 2, 1, 2, 0]
    assert [got[1, t].root_turn for t in range(6)] == [0, 0, 0, 0, 0, 5]
    assert [got[1, t].position for t in range(6)] == [0, 1, 3, 2, 4, 0]
    assert [got[1, t].body for t in range(6)] == ["Shall we meet?\nMonday or Tuesday?\n\nBye", "Tuesday.", "Fine with me.", "I prefer Monday.",
                                                  "Deeper quote only.", "new subject"]
    assert got[2, 0].parent_turn is None
    linked = by_turn(quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)))
    assert linked[1, 5].parent_turn == 4 and linked[1, 5].linked == "previous" and linked[1, 1].linked == "quote"


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_long_threads_match_brute_force(spark, monkeypatch, chunk):
    """Any chunk length gives the newest earlier message with the line, also for a line that all messages hold."""
    monkeypatch.setattr(frames, "CHUNK", chunk)
    monkeypatch.setattr(quotes, "position_chunk", lambda order: frames.position_chunk(order, chunk))
    rng = random.Random(chunk)
    rows, own = [], []
    for t in range(120):
        mine = [f"line {rng.randint(0, 25)}", "thanks"]
        quoted = rng.sample(["thanks", "hm", *{x for o in own for x in o}], 1) if t % 4 else []
        rows.append((7, t * 2, "r", "\n".join([f"> {q}" for q in quoted] + mine)))
        want = [i for i, o in enumerate(own) if quoted and quoted[0] in o]
        own.append(mine)
        rows[-1] += ((want[-1] * 2 if want else None),)
    got = by_turn(quotes.link_quotes(spark.createDataFrame([r[:4] for r in rows], SCHEMA).repartition(4), unquoted=quotes.ROOT))
    assert [got[7, r[1]].parent_turn for r in rows] == [r[4] for r in rows]
    for (c, t), r in got.items():
        assert r.parent_turn is None or (got[c, r.parent_turn].depth == r.depth - 1 and got[c, r.parent_turn].position < r.position)
    for root in {r.root_turn for r in got.values()}:
        places = sorted(r.position for r in got.values() if r.root_turn == root)
        assert places == list(range(len(places)))


def test_rows_of_every_kind(spark):
    rows = [(1, 0, "a", None), (1, 1, "b", ""), (1, 1, "b", ""), (1, 2, "c", ">\n>>\n> \n"), (None, 5, "d", "> x\ny"), (2, None, "e", "z"),
            (3, 0, "f", "w " * 100_000), (3, 1, "g", "> " + "w " * 100_000 + "\nlong")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth_", "2 AS body_", "3 AS level")
    got = quotes.link_quotes(df).collect()
    assert len(got) == len(rows)
    alone = [r for r in got if r.conv_id is None or r.turn is None]
    assert [(r.parent_turn, r.depth, r.position) for r in alone] == [(None, 0, 0)] * 2
    twice = [(r.parent_turn, r.depth) for r in got if (r.conv_id, r.turn) == (1, 1)]
    assert twice == [(0, 1)] * 2
    assert by_turn(quotes.link_quotes(df))[3, 1].body == "long"
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = quotes.link_quotes(spark.createDataFrame([(1, 0, "a", "x")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
