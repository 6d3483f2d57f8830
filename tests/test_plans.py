"""What the physical plans must not hold."""

import re

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(QUERIES["missing_keys"](spark, SF))
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderstatus,F\)", plan)
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan
    plan = _plan(QUERIES["holdout_guard"](spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint>" in plan


def test_record_join_shuffles_records_once(spark):
    """Dedupe and join share one exchange of the records."""
    plan = _plan(QUERIES["record_seed_join"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(id#\d+, ", plan)) <= 2


def test_rendered_text_is_computed_once(spark):
    """Dropping unrenderable records must not push the rendering below itself."""
    from kolanut.operators.rendering import render, renderable
    from kolanut.plans.base import records
    df = renderable(render(records(spark, SF, ("toolrefuse",))))
    assert _plan(df).count("(USER2|USER|CALL") == 1


def test_the_large_side_meets_the_bloom_filter_before_any_exchange(spark):
    """Order lines are filtered where they are read; what is exchanged are the counts of the survivors."""
    df = QUERIES["holdout_guard"](spark, SF)
    lines = _plan(df).splitlines()
    scan = next(i for i, x in enumerate(lines) if "l_partkey" in x and "Scan parquet" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    joined = next(i for i, x in enumerate(above) if "BroadcastHashJoin" in x and "_block" in x)
    assert not [x for x in above[:joined] if "Exchange" in x]
    assert [x for x in above[joined:] if "Exchange hashpartitioning" in x]
