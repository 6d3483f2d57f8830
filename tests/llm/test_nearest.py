import math
import random

import pytest
from pyspark.sql import functions as F

from kolanut.llm import nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=10):
    """All in double precision, component after component."""
    import struct
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append([f32(x) for x in v])
    out = []
    for q in ok:
        if q % 20 == 0:
            best = {}
            for a in ok[q]:
                for c, many in ok.items():
                    for b in many:
                        if c != q and len(a) == len(b):
                            s = 0.0
                            for x, y in zip(a, b, strict=True):
                                s += (x - y) * (x - y)
                            best[c] = min(best.get(c, math.inf), math.sqrt(s))
            out += [(q, r + 1, c, d) for r, (d, c) in enumerate(sorted((d, c) for c, d in best.items())[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,columns,scale", [(1024, 4, 1.0), (16, 3, 1000.0), (64, 2, 1e-4)])
def test_matches_brute_force(spark, block, columns, scale):
    rng = random.Random(block)
    centres = [[rng.gauss(0, scale) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, scale / 10) for c in rng.choice(centres)], 1) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(30)] + [(20, rows[1][1], 2)]  # ties, a repeated key
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [1.0, None] * 4, 1), (2004, [float("inf")] * 8, 1),
             (2005, [], 1), (None, [1.0] * 8, 1), (2020, [1.0, 2.0], 1), (2021, [1.0, 2.5], 1), (2040, [scale * 1e6] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, block=block, columns=columns)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("block", [1024, 16])
def test_a_key_repeated_more_than_k_times_is_one_neighbour(spark, block):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 1) for i in range(60)]
    for d in range(25):  # two keys, 25 rows each, all nearer to the queries than any other
        rows += [(q + at, [x + rng.gauss(0, 1e-3) for x in rows[q][1]], 1) for q in (0, 20) for at in (101, 102)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, block=block, columns=2)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_hold():
    import numpy as np
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=(200, 64)) * rng.uniform(0.01, 50, (200, 1))
    codes, scales, errors = nearest.quantised(x)
    near = codes * scales[:, None]
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rough = np.sqrt(((near[:, None] - near[None]) ** 2).sum(2))
    assert (np.abs(true - rough) <= errors[:, None] + errors[None] + 1e-9).all()


def test_empty_few_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA).selectExpr("*", "1 AS id", "2 AS score", "3 AS query_id")
    assert [tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1.0)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
