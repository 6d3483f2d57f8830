import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from frames import documents, odd_rows, prose

from kolanut.llm import sharding


def test_counts_are_exact_and_hypergeometric():
    rng = np.random.Generator(np.random.PCG64(5))
    rows, places = np.array([7, 0, 12, 1]), np.array([8, 6, 6])
    total = np.zeros((4, 3))
    for _ in range(4000):
        m = sharding.split_counts(rows, places, rng)
        assert m.sum(1).tolist() == rows.tolist() and m.sum(0).tolist() == places.tolist()
        total += m
    assert np.abs(total / 4000 - np.outer(rows, places) / 20).max() < 0.12


def test_large_draws_stay_in_range():
    rng = np.random.Generator(np.random.PCG64(6))
    for _ in range(200):
        got = sharding._hypergeometric(rng, 3 * 10**9, 10**9, 2 * 10**9)
        assert 10**9 <= got <= 2 * 10**9


def test_shards_hold_every_row_once(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 5)) for i in range(1000)] + [(d, t) for d, t, *_ in odd_rows(rng)] + [(5000, "same")] * 300
    got = sharding.shard_documents(documents(spark, rows)).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = sharding.shard_documents(documents(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_the_shuffle_is_uniform(spark):
    """Neighbours in key order fall into one shard as often as chance has it."""
    got = sorted(sharding.shard_documents(documents(spark, [(i, "t") for i in range(6000)])).collect(), key=lambda r: r.doc_id)
    same = sum(a.shard == b.shard for a, b in zip(got, got[1:], strict=False))
    assert abs(same - 6000 / 24) < 70
    rank = np.corrcoef([r.doc_id for r in got], [r.slot for r in got])[0, 1]
    assert abs(rank) < 0.06


def test_copies_share_a_shard_as_often_as_chance(spark):
    """Alike rows, rows of one key with other texts, and rows without a key are dealt one by one."""
    rows = [(i, "same") for i in range(3000) for _ in range(2)] + [(i, t) for i in range(3000, 6000) for t in ("one", "another")]
    rows += [(None, "no key")] * 6000
    got = sharding.shard_documents(documents(spark, rows)).collect()
    where = {}
    for r in got:
        where.setdefault(r.doc_id, []).append((r.shard, r.slot))
    for keys in (range(3000), range(3000, 6000)):
        assert abs(sum(len({s for s, _ in where[i]}) == 1 for i in keys) - 3000 / 24) < 50
        assert sum(abs(a[1] - b[1]) < 5 for a, b in (where[i] for i in keys)) < 80  # not neighbours in their shards either
    counts = Counter(s for s, _ in where[None])
    assert len(counts) == 24 and max(abs(n - 250) for n in counts.values()) < 80


def test_alike_rows_are_numbered_over_partitions(spark):
    docs = documents(spark, [(1, "a")] * 50 + [(1, "b")] * 20 + [(None, None)] * 30).repartition(4).localCheckpoint()
    got = sharding.numbered(docs, "doc_id", ["text"]).collect()
    for key, text, n in ((1, "a", 50), (1, "b", 20), (None, None, 30)):
        assert sorted(r._nth for r in got if (r.doc_id, r.text) == (key, text)) == list(range(n))


def test_empty_and_clashing_columns(spark):
    docs = documents(spark, [(1, "a")]).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS _rank")
    assert [(r.size, r.slot) for r in sharding.shard_documents(docs).collect()] == [(9, 0)]
    assert sharding.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("good,bad,n", [(30, 50, 20), (5, 3, 6), (1, 40, 7), (400, 300, 350), (12, 2000, 900)])
def test_rejection_draws_the_exact_law(good, bad, n):
    """Against the law from binomial coefficients, by a chi-square over the places that expect five draws or more."""
    rng, draws = np.random.Generator(np.random.PCG64(3)), 20_000
    got = np.bincount([sharding._rejected(rng, good, bad, n) for _ in range(draws)], minlength=good + 2)
    law = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if 0 <= n - k <= bad else 0.0 for k in range(good + 1)]
    often = [k for k in range(good + 1) if law[k] * draws >= 5]
    assert not [k for k in range(good + 1) if law[k] == 0 and got[k]]
    assert sum((got[k] - law[k] * draws) ** 2 / (law[k] * draws) for k in often) < len(often) + 4.5 * math.sqrt(2 * len(often))


@pytest.mark.parametrize("total", [10**10, 10**13])
def test_draws_beyond_the_generator(total):
    """Mean, deviation and tails at sizes that the generator refuses; matrices keep their sums."""
    rng = np.random.Generator(np.random.PCG64(4))
    good, n = total // 24, total // 64
    got = np.array([sharding._hypergeometric(rng, good, total - good, n) for _ in range(4000)], float)
    p = good / total
    deviation = math.sqrt(n * p * (1 - p) * (total - n) / (total - 1))
    z = (got - n * p) / deviation
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06 and abs((np.abs(z) > 1.96).mean() - 0.05) < 0.015
    assert [sharding._hypergeometric(rng, 0, total, n), sharding._hypergeometric(rng, total, 0, n), sharding._hypergeometric(rng, good, total - good, 0)] == [0, n, 0]
    rows = np.full(8, total // 8)
    cut = sharding.split_counts(rows, sharding.shard_sizes(int(rows.sum()), 24), rng)
    assert (cut.sum(axis=1) == rows).all() and (cut.sum(axis=0) == sharding.shard_sizes(int(rows.sum()), 24)).all() and (cut >= 0).all()


def test_large_terms_keep_their_digits():
    """Growth of the log gamma function at 10^13 against the sum of logarithms."""
    for x, d in ((10**13, 400), (10**13, -400), (5000, 37), (1500, -400)):
        terms = math.fsum(math.log(x + i) for i in range(d)) if d > 0 else -math.fsum(math.log(x - i) for i in range(1, -d + 1))
        assert abs(sharding._grown(x, d) - terms) < 1e-8
