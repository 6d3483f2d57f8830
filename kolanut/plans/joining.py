"""Records as order lines (an order has many, so ids repeat), seeds as orders."""

from pyspark.sql import functions as F

from kolanut.operators.joins import (
    attach_menu, first_copy, group_counts, join_report, joined, last_wave, leaked, missing, with_completions, zip_completions,
)
from kolanut.plans.base import table, texts

# One order of all lines that both engines share: the numbers of a line tell it apart.
_POS = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_quantity", "l_discount")
_CURRENT = "'{\"name\":\"pay\",\"arguments\":{\"amount\":' || CAST(o_custkey AS VARCHAR) || '}}'"
_OUTPUT = "'line ' || CAST(l_linenumber AS VARCHAR) || ' part ' || CAST(l_partkey AS VARCHAR)"


def _spark(sql):
    return sql.replace("VARCHAR", "STRING")


def _records(spark, sf):
    li = texts(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return li.select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("type"),
        F.when(F.col("l_linestatus") == "F", "pcm").alias("lang"), F.expr(_spark(_OUTPUT)).alias("output"),
        F.struct(F.lit(None).cast("string").alias("target"), F.concat(F.lit("old "), F.col("l_partkey").cast("string")).alias("current"),
                 F.lit(None).cast("string").alias("brief"), F.lit(None).cast("int").alias("shots")).alias("input"),
        F.when(F.col("l_discount") == 0.1, "cut").alias("_corrupt"), F.struct(*_POS).alias("_pos"))


def _seeds(spark, sf):
    """Two waves: finished and open orders, then the urgent ones once more."""
    o = table(spark, sf, "orders")
    menu = F.expr("array(named_struct('name', o_orderpriority, 'description', 'Order', 'arguments', map('amount', 'number')))")

    def wave(df, n, current):
        return df.select(F.col("o_orderkey").cast("string").alias("id"), menu.alias("menu"), current.alias("current"),
                         F.lit(n).alias("_wave"), F.col("o_orderkey").alias("_pos"))

    first = wave(o.filter("o_orderstatus IN ('F', 'O')"), 0, F.when(F.col("o_orderstatus") == "F", F.expr(_spark(_CURRENT))))
    again = wave(o.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"), 1, F.lit('{"name":"again","arguments":{}}'))
    return first.unionByName(again)


def last_wave_wins(spark, sf):
    return last_wave(_seeds(spark, sf)).select("id", F.col("menu")[0]["name"].alias("tool"), "current")


def first_wins_dedupe(spark, sf):
    return first_copy(_records(spark, sf)).select("id", "output", "copies", "unparseable")


def record_seed_join(spark, sf):
    r = joined(attach_menu(_records(spark, sf), _seeds(spark, sf)))
    return r.select("id", "type", "lang", "output", F.col("menu")[0]["name"].alias("tool"),
                    F.col("input")["current"].alias("current"))


def join_counters(spark, sf):
    return join_report(attach_menu(_records(spark, sf), _seeds(spark, sf)))


def join_groups(spark, sf):
    return group_counts(attach_menu(_records(spark, sf), _seeds(spark, sf)))


def cases_completions(spark, sf):
    """Cases are orders, completions the lines written for them."""
    cases = table(spark, sf, "orders").select(F.lit("A").alias("suite"), F.col("o_orderkey").alias("case_id"),
                                              F.col("o_orderpriority").alias("expect"))
    comps = table(spark, sf, "lineitem").select(F.lit("A").alias("suite"), F.col("l_orderkey").alias("case_id"),
                                                F.col("l_returnflag").alias("model"))
    return with_completions(cases, comps).groupBy("model", "expect").agg(F.count(F.lit(1)).alias("n"))


def cases_by_place(spark, sf):
    """Cases are the orders that have lines, completions their lines' sums, which meet by place alone."""
    li = table(spark, sf, "lineitem")
    cases = table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderpriority")
    sums = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.max("l_partkey").alias("part"))
    return zip_completions(cases, sums, "o_orderkey", "l_orderkey").select("place", "o_orderkey", "o_orderpriority", "lines", "part")


def holdout_guard(spark, sf):
    """Parts of one brand are held out; which of them do the order lines use, and how often."""
    hold = table(spark, sf, "part").filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("id"))
    return leaked(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")), hold)


def missing_keys(spark, sf):
    """Customers without a finished order, the guard's left anti join at full size."""
    have = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), have, "id")


QUERIES = {f.__name__: f for f in (
    last_wave_wins, first_wins_dedupe, record_seed_join, join_counters, join_groups, cases_completions, cases_by_place,
    holdout_guard, missing_keys)}

_CTE = f"""WITH rec AS (
  SELECT *, CAST(l_orderkey AS VARCHAR) AS id, {_OUTPUT} AS output, l_discount = 0.1 AS bad,
    row_number() OVER (PARTITION BY l_orderkey, l_discount = 0.1 ORDER BY {', '.join(_POS)}) AS rn,
    count(*) OVER (PARTITION BY l_orderkey, l_discount = 0.1) AS c FROM lineitem),
ids AS (SELECT id, coalesce(max(c) FILTER (NOT bad), 0) AS copies, coalesce(max(c) FILTER (bad), 0) AS unparseable FROM rec GROUP BY id),
best AS (SELECT ids.*, r.l_returnflag AS type, CASE WHEN r.l_linestatus = 'F' THEN 'pcm' END AS lang, r.output, r.l_partkey
  FROM ids LEFT JOIN rec r ON r.id = ids.id AND r.rn = 1 AND NOT r.bad),
seeds AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS tool,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN '{{"name":"again","arguments":{{}}}}'
    WHEN o_orderstatus = 'F' THEN {_CURRENT} END AS current FROM orders WHERE o_orderstatus IN ('F', 'O')),
att AS (SELECT best.*, s.tool, s.current AS seed_current, s.id IS NOT NULL AS ok FROM best LEFT JOIN seeds s USING (id))"""
ORACLE = {
    "last_wave_wins": f"{_CTE} SELECT id, tool, current FROM seeds",
    "first_wins_dedupe": f"{_CTE} SELECT id, output, copies, unparseable FROM best",
    "record_seed_join": f"""{_CTE} SELECT id, type, coalesce(lang, 'eng') AS lang, output, tool,
        coalesce(seed_current, 'old ' || CAST(l_partkey AS VARCHAR)) AS current FROM att WHERE ok""",
    "join_counters": f"""{_CTE} SELECT count(*) FILTER (ok AND copies > 0) AS written,
        CAST(coalesce(sum(copies) FILTER (NOT ok), 0) AS BIGINT) AS no_seed,
        CAST(coalesce(sum(greatest(copies - 1, 0)) FILTER (ok), 0) AS BIGINT) AS duplicates,
        CAST(sum(unparseable) AS BIGINT) AS unparseable FROM att""",
    "join_groups": f"{_CTE} SELECT type, coalesce(lang, 'eng') AS lang, count(*) AS n FROM att WHERE ok GROUP BY 1, 2",
    "cases_completions": """SELECT l_returnflag AS model, o_orderpriority AS expect, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "cases_by_place": """WITH a AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders
          WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
        b AS (SELECT count(*) AS lines, max(l_partkey) AS part, row_number() OVER (ORDER BY l_orderkey) - 1 AS place FROM lineitem GROUP BY l_orderkey)
        SELECT place, o_orderkey, o_orderpriority, lines, part FROM a JOIN b USING (place)""",
    "holdout_guard": """SELECT l_partkey AS id, count(*) AS n FROM lineitem
        WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') GROUP BY 1""",
    "missing_keys": """SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
}
