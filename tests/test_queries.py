"""Every registered query against its SQL twin, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from kolanut.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE  # the library's own; tests/llm has the others


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


# the only single-partition steps: aggregates of one row, top-k, and windows over bucket sums
BOUNDED = {"holdout_split", "shuffle_positions", "pack_shards", "shard_manifest", "shard_index", "stratified_sample",
           "keep_rate", "join_counters", "sentence_count", "corpus_stats", "quality_gate", "build_vocab", "encode_mask",
           "weighted_draw", "weighted_draw_wide", "pair_draw", "video_jobs", "video_sequences", "distinct_menus", "cases_by_place", "mixture_order"}
BANNED = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct",
          "BroadcastNestedLoopJoin")


def _check_plan(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [bad for bad in BANNED if bad in plan] == []
    assert name in BOUNDED or "Exchange SinglePartition" not in plan


def _cell(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    _check_plan(name, df)
    cols = sorted(df.columns)
    rows = _sorted([tuple(_cell(r[c]) for c in cols) for r in df.collect()])
    assert name in ORACLE, "every query has a SQL twin"
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == _sorted([tuple(_cell(r[i]) for i in at) for r in want.fetchall()])


def test_entry_registers_them_all():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
