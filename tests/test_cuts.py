"""Shard cuts against a plain walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kolanut.operators import cuts


def walk(sizes, cap):
    """Shard of every row: a shard closes with the row that brings it to the cap."""
    out, held, shard = [], 0, 0
    for n in sizes:
        out.append(shard)
        held += n or 0
        if held >= cap:
            held, shard = 0, shard + 1
    return out


def _sizes(rng, n):
    return [rng.choice([0, 1, 1, 2, 5, 9, 30, rng.randint(1, 200)]) for _ in range(n)]


def test_cut_functions_compose():
    """Any split of a sequence into blocks leads from 0 to the same last cut as the whole."""
    rng = random.Random(4)
    for _ in range(300):
        sizes, cap = _sizes(rng, rng.randint(1, 60)), rng.choice([1, 7, 40, 300])
        ends = np.cumsum(sizes).astype(np.int64)
        whole = cuts.cut_function(0, ends, cap)
        k = rng.randint(1, len(sizes))
        parts = [(0, ends[:k]), (int(ends[k - 1]), ends[k:])]
        both = cuts.composed(*(cuts.cut_function(start, e, cap) for start, e in parts)) if len(ends) > k else whole
        at = lambda f: (int(f[1][np.searchsorted(f[0], 0)]), int(f[2][np.searchsorted(f[0], 0)]))
        assert at(both) == at(whole)
        assert at(whole)[1] == len([1 for a, b in zip(walk(sizes, cap), walk(sizes, cap)[1:]) if a != b]) + (
            sum(n for n, s in zip(sizes, walk(sizes, cap)) if s == walk(sizes, cap)[-1]) >= cap)


def test_a_function_holds_for_every_entry():
    """For all places that the last cut may have, not only for the chain from 0."""
    rng = random.Random(6)
    for _ in range(60):
        cap, start = rng.choice([3, 25, 120]), 1000
        ends = start + np.cumsum(_sizes(rng, 40)).astype(np.int64)
        upto, last, count = cuts.cut_function(start, ends, cap)
        for entered in range(start - cap + 1, start + 1):
            at, n = entered, 0
            for e in ends:
                if e - at >= cap:
                    at, n = int(e), n + 1
            i = int(np.searchsorted(upto, entered))
            assert (entered if last[i] == cuts._SAME else last[i], count[i]) == (at, n)


@pytest.mark.parametrize("blocks", [None, 2, 7])
def test_cuts_match_a_walk(spark, blocks):
    rng = random.Random(blocks or 0)
    sizes = [*_sizes(rng, 400), None, 5000, 0, 0, *_sizes(rng, 200), 9]
    before = [0, *np.cumsum([n or 0 for n in sizes]).tolist()][:-1]
    df = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(zip(sizes, before))], "id int, n int, before bigint").repartition(5)
    for cap in (60, 900):
        got = {r.id: r.shard_id for r in cuts.exact_cuts(df, "n", cap, blocks).collect()}
        want = walk(sizes, cap)
        # rows of no size right behind a cut share its running total and open the next shard
        assert [got[i] for i in range(len(sizes))] == want, cap


def test_smallest_and_largest_caps(spark):
    sizes = _sizes(random.Random(1), 100)
    before = [0, *np.cumsum(sizes).tolist()][:-1]
    df = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(zip(sizes, before))], "id int, n int, before bigint")
    for cap in (1, 10**9):
        got = {r.id: r.shard_id for r in cuts.exact_cuts(df, "n", cap).collect()}
        assert [got[i] for i in range(len(sizes))] == walk(sizes, cap)


def test_empty_and_faulty(spark):
    df = spark.range(0).select("id", F.col("id").alias("n"), F.col("id").alias("before"))
    assert cuts.exact_cuts(df, "n", 5).columns == ["id", "n", "before", "shard_id"]
    with pytest.raises(ValueError):
        cuts.exact_cuts(df, "n", 0)
