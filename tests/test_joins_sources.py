"""Reading, joining and writing on files with planted faults."""

import json

import pytest
from pyspark.sql import functions as F

from fixtures import CURRENT, MENU, frame, rec
from kolanut.operators import joins
from kolanut.operators.aggregates import corpus_stats, pass_all, report_table, summary
from kolanut.sources import readers, writers

TOOLS = [dict(zip(("name", "description", "arguments"), x)) for x in MENU]


def seed(id, **kw):
    return {"id": id, "type": "toolcall_api", "lang": "pcm", "menu": TOOLS, "menu_id": "m"} | kw


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "wave1.json").write_text(json.dumps([seed("a"), seed("b"), seed("p", current=json.loads(CURRENT))]))
    (tmp_path / "wave2.json").write_text(json.dumps([seed("b", target="bal"), seed("b", target="last")]))
    rows = [
        {"id": "a", "type": "toolcall_api", "lang": "yor", "output": "first"},
        {"id": "zz", "type": "toolcall_api", "output": "no seed"},
        {"id": "a", "type": "toolcall_api", "lang": "yor", "output": "second"},
        {"id": "b", "type": "toolact", "output": "no lang"},
        {"id": "p", "type": "toolpatch", "lang": "pcm", "output": "x", "input": {"target": "t", "current": {"name": "cut"}}},
    ]
    lines = [json.dumps(r) for r in rows]
    (tmp_path / "r1.jsonl").write_text("\n".join(lines[:3]) + "\n\n   \n" + "\n".join(lines[3:]) + '\n{"id": "a", "typ')
    (tmp_path / "r2.jsonl").write_text(json.dumps({"id": "a", "type": "toolcall_api", "lang": "yor", "output": "third"}) + "\n"
                                       + json.dumps({"type": "toolact", "output": "no id"}) + "\n")
    return tmp_path


def attach(spark, corpus):
    records = readers.read_records(spark, [f"{corpus}/r1.jsonl", f"{corpus}/r2.jsonl"])
    return joins.attach_menu(records, readers.read_seeds(spark, [f"{corpus}/wave1.json", f"{corpus}/wave2.json"]))


def test_last_wave_and_last_row_win(spark, corpus):
    seeds = joins.last_wave(readers.read_seeds(spark, [f"{corpus}/wave1.json", f"{corpus}/wave2.json"]))
    assert {r["id"]: r["target"] for r in seeds.collect()} == {"a": None, "b": "last", "p": None}


def test_join_and_counters(spark, corpus):
    df = attach(spark, corpus)
    got = {r["id"]: r for r in joins.joined(df).collect()}
    assert set(got) == {"a", "b", "p"}
    assert got["a"]["output"] == "first" and got["b"]["lang"] == "eng"
    assert json.loads(got["p"]["input"]["current"]) == json.loads(CURRENT) and got["p"]["input"]["target"] == "t"
    assert [t["name"] for t in got["a"]["menu"]] == ["send_money", "bal"]
    assert joins.join_report(df).first().asDict() == {"written": 3, "no_seed": 2, "duplicates": 2, "unparseable": 1}
    assert [tuple(r) for r in joins.group_counts(df).collect()] == [("toolact", "eng", 1), ("toolcall_api", "yor", 1), ("toolpatch", "pcm", 1)]


def test_staged_clean_and_tree(spark, corpus):
    kept = joins.joined(attach(spark, corpus))
    writers.write_staged(kept, f"{corpus}/staged")
    back = readers.read_staged(spark, f"{corpus}/staged")
    assert {(r["id"], r["type"], r["lang"]) for r in back.collect()} == {
        ("a", "toolcall_api", "yor"), ("b", "toolact", "eng"), ("p", "toolpatch", "pcm")}
    plan = back.filter("type = 'toolact'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan
    writers.write_staged(kept, f"{corpus}/staged")  # a second run changes nothing
    back = readers.read_staged(spark, f"{corpus}/staged")
    assert back.count() == 3
    with pytest.raises(ValueError):
        writers.write_clean(back, f"{corpus}/staged/clean", f"{corpus}/staged")
    writers.write_clean(back, f"{corpus}/clean", f"{corpus}/staged")
    sub = corpus / "tree" / "x"
    sub.mkdir(parents=True)
    (sub / "a.jsonl").write_text('{"id":"q","type":"toolact","output":"o"}\n')
    (sub / "skip.txt").write_text("{}")
    assert [r["id"] for r in readers.read_tree(spark, f"{corpus}/tree").collect()] == ["q"]


def test_menu_cases_mixture_grammar_scripts(spark, tmp_path):
    (tmp_path / "menu.json").write_text(json.dumps({"tools": [
        {"name": "bal", "description": "d", "arguments": {}, "_http": "GET /b", "aliases": ["x"]}]}))
    menu = readers.read_menu(spark, f"{tmp_path}/menu.json")
    assert menu.columns == ["name", "description", "arguments", "_http"] and menu.first()["name"] == "bal"
    (tmp_path / "cases.json").write_text(json.dumps({"jobs": [{"lang": "l", "question": "q", "expect": "e"}] * 2}))
    assert [r["case_id"] for r in readers.read_cases(spark, f"{tmp_path}/cases.json").collect()] == [0, 1]
    (tmp_path / "mix.json").write_text(json.dumps({"sources": {"a": {"weight": 70, "path": "p", "required": True}}}))
    assert readers.read_mixture(spark, f"{tmp_path}/mix.json").first()["weight"] == 70
    (tmp_path / "g.json").write_text(json.dumps({"vocab": {"shot": {"pan": 3}}, "pairs": {"a|b": 2}}))
    assert {tuple(r) for r in readers.read_grammar(spark, f"{tmp_path}/g.json").collect()} == {("shot", "pan", 3), ("pair", "a|b", 2)}
    spark.createDataFrame([(i, f"s{i}") for i in (3, 1, 2)], "script_id BIGINT, script STRING").write.parquet(f"{tmp_path}/scripts")
    assert sorted(r["script_id"] for r in readers.read_scripts(spark, f"{tmp_path}/scripts", 2).collect()) == [1, 2]


def test_report_and_split_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", True, True, 1), ("m", False, True, 2), ("n", True, None, 2)], "model STRING, a BOOLEAN, b BOOLEAN, k INT")
    s = summary(df, ("a", "b"))
    writers.write_report(df, s, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/summary").count() == 2
    assert {r["model"]: (r["a"], r["b"]) for r in s.collect()} == {"m": (50.0, 100.0), "n": (100.0, 0.0)}
    p = pass_all(df, ("a", "b"), (), F.col("k") > 1, "a").first()
    assert (p["n"], round(p["all_pass"], 6), p["n_subset"], p["subset_pass"]) == (3, 33.333333, 2, 50.0)
    long = spark.createDataFrame([("m", "x", True), ("m", "x", False), ("m", "y", True)], "model STRING, check STRING, passed BOOLEAN")
    assert report_table(long, ("x", "y", "z")).first().asDict() == {"model": "m", "x": 50.0, "y": 100.0, "z": 0.0}
    held = df.withColumn("held_out", F.col("k") == 1)
    writers.write_split(held, f"{tmp_path}/train", f"{tmp_path}/hold")
    assert (spark.read.parquet(f"{tmp_path}/train").count(), spark.read.parquet(f"{tmp_path}/hold").count()) == (2, 1)


def test_guards(spark):
    train = spark.createDataFrame([("t6-sd-1",), ("t7-hold-2",), ("t7-hold-2",)], "id STRING")
    hold = spark.createDataFrame([("t7-hold-2",), ("t6-hold-9",)], "id STRING")
    with pytest.raises(joins.GuardError, match="t7-hold-2"):
        joins.assert_no_leak(train, hold)
    assert joins.leaked(train, hold).first()["n"] == 2
    joins.assert_no_leak(train.filter("id = 't6-sd-1'"), hold)
    with pytest.raises(joins.GuardError):
        joins.assert_covered(hold, train, "id")
    joins.assert_covered(train, train, "id")


def test_dedupe_survives_a_hot_id(spark):
    rows = [rec("hot" if i % 3 else f"r{i}", "toolact", f"out {i}") for i in range(300)]
    df = frame(spark, rows).withColumn("_pos", F.regexp_extract("output", r"(\d+)", 1).cast("int"))
    got = {r["id"]: (r["output"], r["copies"]) for r in joins.first_copy(df.repartition(16)).collect()}
    assert got["hot"] == ("out 1", 200) and len(got) == 101


def test_corpus_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "n_tokens INT, n_trained INT")
    assert corpus_stats(empty).first()["examples"] == 0


def test_values_of_another_type_are_read(spark, tmp_path):
    """Only text that is not JSON is corrupt; what is not declared is carried along."""
    lines = ['{"id":"a","type":"seedance","output":"o","input":{"shots":"2","mood":"calm"},"degenerate":0,"score":0.5}',
             '{"id":"b","type":"seedance","output":"o","input":{"shots":2.0},"empty":1}', '{"id":"c","input":{"shots":3},"empty":true}',
             '{"id":"d","input":"text","degenerate":"false"}', '{"id":"e"', "", "  "]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    got = {r["id"]: r for r in readers.read_records(spark, [f"{tmp_path}/r.jsonl"]).collect()}
    assert [got[i]["input"]["shots"] for i in "abc"] == [2, 2, 3]
    assert [(got[i]["degenerate"], got[i]["empty"]) for i in "abcd"] == [(False, None), (None, True), (None, True), (False, None)]
    assert got["a"]["_rest"]["score"] == "0.5" and json.loads(got["a"]["_rest"]["input"])["mood"] == "calm"
    assert [r["_corrupt"] is not None for i, r in got.items()].count(True) == 1 and got.get(None, got.get("e"))["_corrupt"] == '{"id":"e"'
    records = readers.read_records(spark, [f"{tmp_path}/r.jsonl"])
    seeds = spark.createDataFrame([("a", 0)], "id STRING, w INT").select("id", F.lit(None).cast(readers.schemas.MENU).alias("menu"),
                                                                        F.lit(None).cast("string").alias("current"))
    kept = joins.first_copy(records)
    assert {r["id"]: r["_rest"] for r in kept.collect()}["a"]["score"] == "0.5" and seeds.count() == 1


@pytest.mark.parametrize("parts", (1, 5))
def test_completions_meet_cases_by_place(spark, parts):
    at = lambda i: i * 40_000 - 100_000  # several chunks, gaps, negative positions
    cases = spark.createDataFrame([(at(i), f"c{i}") for i in range(9)], "pos LONG, ask STRING").repartition(parts)
    said = spark.createDataFrame([(i, None if i == 4 else f"s{i}") for i in range(9)], "line LONG, said STRING").repartition(parts)
    got = joins.zip_completions(cases, said, "pos", "line").orderBy("place").collect()
    assert [(r.place, r.ask, r.said) for r in got] == [(i, f"c{i}", None if i == 4 else f"s{i}") for i in range(9)]
    assert joins.zip_completions(cases.limit(0), said.limit(0), "pos", "line").count() == 0


def test_unequal_lengths_raise(spark):
    cases = spark.range(5).select(F.col("id").alias("pos"))
    for n in (4, 6):
        with pytest.raises(Exception, match="differ in number"):
            joins.zip_completions(cases, spark.range(n).select(F.col("id").alias("line")), "pos", "line").collect()
    with pytest.raises(joins.GuardError):
        joins.zip_completions(cases, cases, "pos", "pos")


@pytest.mark.parametrize("kind", ["string", "bigint", "int", "double", "date"])
def test_leaks_through_the_bloom_filter(spark, kind):
    """Every held-out key that occurs is found, with its count; null keys and other types included."""
    as_kind = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c.cast("int")) if kind == "date" else c.cast(kind)
    train = spark.range(6000).select(as_kind(F.col("id") % 1500).alias("id")).unionAll(spark.range(3).select(F.lit(None).cast(kind).alias("id")))
    hold = spark.range(1400, 9000).select(as_kind(F.col("id")).alias("id")).unionAll(spark.range(2).select(F.lit(None).cast(kind).alias("id")))
    found = joins.leaked(train, hold)
    assert {r["n"] for r in found.collect()} == {4} and found.count() == 100
    assert joins.leaked(train, hold.limit(0)).count() == 0 and joins.leaked(train.limit(0), hold).count() == 0
    if kind == "int":
        assert joins.leaked(train, hold.select(F.col("id").cast("bigint").alias("id"))).count() == 100


def test_the_bloom_filter_lets_few_others_through(spark):
    held = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("id"))
    blocks = -(-50_000 * 16 // joins.BLOOM_BITS)
    bloom = joins.bloom_filter(held, "id", blocks)
    assert joins.maybe_in(held, "id", bloom, blocks).count() == 50_000
    others = spark.range(50_000, 250_000).select(F.concat(F.lit("k"), "id").alias("id"))
    assert joins.maybe_in(others, "id", bloom, blocks).count() < 2000
