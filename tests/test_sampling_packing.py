"""Keyed draws, ordered windows, sampling and packing against brute force, under several partitionings."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.draws import choice, draw, scaled, weighted_of, wide_draw
from kolanut.operators import packing, sampling, seeding
from kolanut.operators.frames import first_k, keep_rows, lang_switches, position_chunk, previous_value, running_total
from kolanut.operators.joins import GuardError
from kolanut.plans.packing import QUERIES
from kolanut.sources import writers


def h(seed, key, why):
    return int(hashlib.md5(f"{seed}:{key}:{why}".encode()).hexdigest()[:8], 16)


def test_draw_is_keyed(spark):
    df = spark.range(50).withColumn("d", draw(3, F.col("id"), "x")).withColumn("c", choice(F.col("d"), ("a", "b", "b")))
    for n in (1, 7):
        assert {r["id"]: (r["d"], r["c"]) for r in df.repartition(n).collect()} == {
            i: (h(3, i, "x"), ("a", "b", "b")[h(3, i, "x") % 3]) for i in range(50)}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of all rows and another has no key."""
    rows = [(("hot", None, f"g{i % 40}")[0 if i % 3 == 0 else 1 if i % 31 == 0 else 2], i, (i * 7919) % 13, "ab"[(i // 5) % 2] if i % 4 else None)
            for i in range(3000)]
    return spark.createDataFrame(rows, "g STRING, pos BIGINT, v INT, lang STRING"), pd.DataFrame(rows, columns=["g", "pos", "v", "lang"])


@pytest.mark.parametrize("chunk", [1, 17, 100000])
@pytest.mark.parametrize("parts", [1, 4, 64])
def test_running_total(skewed, chunk, parts):
    df, pdf = skewed
    got = {r["pos"]: r["before"] for r in running_total(df.repartition(parts), ["g"], ["pos"], F.col("v"), position_chunk(F.col("pos"), chunk)).collect()}
    before = pdf.sort_values("pos").groupby("g", dropna=False)["v"].cumsum() - pdf["v"]
    assert got == dict(zip(pdf["pos"], before))


@pytest.mark.parametrize("chunk", [1, 17, 100000])
def test_previous_value_and_switches(skewed, chunk):
    df, pdf = skewed
    rows = previous_value(df, ["g"], "pos", "lang", position_chunk(F.col("pos"), chunk), "prev").collect()
    grouped = pdf.sort_values("pos").groupby("g", dropna=False)
    prev, first = grouped["lang"].shift(), grouped.cumcount() == 0
    want = {p: (None if pd.isna(x) else x, not f) for p, x, f in zip(pdf["pos"], prev, first)}
    assert {r["pos"]: (r["prev"], r["prev_exists"]) for r in rows} == want
    n = sum(ex and want[p][0] != (None if pd.isna(l) else l) for p, l, ex in zip(pdf["pos"], pdf["lang"], ~first))
    assert lang_switches(df, "g", "pos", "lang", position_chunk(F.col("pos"), chunk)).agg(F.sum("switches")).first()[0] == n


@pytest.mark.parametrize("chunk", [1, 17, 100000])
def test_first_k(skewed, chunk):
    df, pdf = skewed
    got = {r["pos"] for r in first_k(df, ["g"], ["pos"], 9, position_chunk(F.col("pos"), chunk)).collect()}
    assert got == set(pdf.sort_values("pos").groupby("g", dropna=False).head(9)["pos"])


def test_exhibit_shows_two_patches(spark):
    df = spark.createDataFrame([(k, i) for i in range(5) for k in ("toolpatch", "toolact")], "type STRING, pos BIGINT")
    assert sorted((r["type"], r["pos"]) for r in sampling.exhibit(df, "type", "pos").collect()) == [("toolact", 0), ("toolpatch", 0), ("toolpatch", 1)]


def test_keep_rows_equals_filter(skewed):
    df, _ = skewed
    assert keep_rows(df, F.col("v") > 6).exceptAll(df.filter("v > 6")).isEmpty()
    assert keep_rows(df, F.col("lang") == "a").count() == df.filter("lang = 'a'").count()


@pytest.mark.parametrize("k", [0, 1, 7, 500])
def test_holdout(spark, k):
    df = spark.range(200).select(F.format_string("t6-sd-%05d", "id").alias("id"))
    rows = sampling.split_holdout(df.repartition(9), k, 5, ("t6-sd-", "t6-hold-")).collect()
    want = sorted((f"t6-sd-{i:05d}" for i in range(200)), key=lambda x: (h(5, x, "holdout"), x))[:k]
    assert {r["id"] for r in rows if r["held_out"]} == {x.replace("-sd-", "-hold-") for x in want} and len(rows) == 200


def test_holdout_split_to_disk(spark, tmp_path):
    df = sampling.split_holdout(spark.range(50).select(F.col("id").cast("string").alias("id")), 5, 1)
    writers.write_split(df, f"{tmp_path}/a", f"{tmp_path}/b")
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ab")
    assert (a.count(), b.count(), a.join(b, "id").count()) == (45, 5, 0)


@pytest.mark.parametrize("n_seq,limit,want", [(100, 30, (10, 20)), (4, 30, (4, 26)), (0, 30, (0, 30)), (100, 1000, (100, 60)), (100, 2, (1, 1))])
def test_stratified(spark, n_seq, limit, want):
    df = spark.range(n_seq + 60).select("id", F.when(F.col("id") < n_seq, 3).otherwise(F.when(F.col("id") % 2 == 0, 1)).alias("shots"))
    got = sampling.stratified_sample(df, limit)
    assert (got.filter("is_seq").count(), got.filter("NOT is_seq").count()) == want


def test_upsample(spark):
    df = spark.createDataFrame([("toolact",), ("toolrefuse",), ("other",)], "type STRING")
    assert {r["type"]: r["count"] for r in sampling.upsample(df).groupBy("type").count().collect()} == {"toolact": 3, "toolrefuse": 1, "other": 1}


def test_mixture_share_and_guard(spark):
    a = spark.range(4000).select("id", F.lit(10).alias("n"))
    b = spark.range(9000).select("id", F.lit(5).alias("n"))
    mixed = sampling.mix({"tools": a, "replay": b}, t.MIX_WEIGHTS, "n", "id").groupBy("source").agg(F.sum("n").alias("n"))
    n = {r["source"]: r["n"] for r in mixed.collect()}
    assert n["tools"] == 40000 and abs(n["replay"] / sum(n.values()) - 0.3) < 0.02
    with pytest.raises(GuardError, match="replay"):
        sampling.mix({"tools": a, "replay": b.filter("id < 0")}, t.MIX_WEIGHTS, "n", "id")


def _check_order(got, weights, have, budget=None):
    """Each beginning holds the weights but for the row that each source is in, and the sequence ends where it should."""
    assert [r["position"] for r in got] == list(range(len(got)))
    taken, whole = dict.fromkeys(weights, 0), sum(weights.values())
    for r in got:
        for s, w in weights.items():  # time that each source has come to: none is a row behind or ahead of the time of this row
            assert taken[s] * weights[r["source"]] <= taken[r["source"]] * w + 50 * whole * weights[r["source"]]
            assert (taken[s] + 50) * weights[r["source"]] >= taken[r["source"]] * w
        taken[r["source"]] += r["n"] or 0
    end = min(have[s] / w for s, w in weights.items()) if budget is None else budget / whole
    assert all(end * w <= taken[s] + 1 and taken[s] <= end * w + 50 for s, w in weights.items())


def test_interleaved_mixture(spark):
    """Sources with rows of 0 to 50, null sizes, null and repeated keys, under several partitionings."""
    a = spark.range(4000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 900).alias("id"), F.when(F.col("id") % 9 > 0, F.col("id") % 51).alias("n"), F.lit("x").alias("_time"))
    b = spark.range(900).select("id", F.lit(7).cast("bigint").alias("n"), F.lit("y").alias("position"))
    c = spark.range(700).select("id", (F.col("id") % 13).alias("n"))
    weights, sources = {"a": 5, "b": 2, "c": 1}, {"a": a, "b": b, "c": c, "unweighted": c}
    have = {s: sources[s].agg(F.sum("n")).first()[0] for s in weights}
    runs = []
    for parts in (1, 6):
        df = sampling.interleave({s: x.repartition(parts) for s, x in sources.items()}, weights, "n", "id")
        runs.append([(r["position"], r["source"], r["id"], r["n"]) for r in df.orderBy("position").collect()])
        _check_order(df.orderBy("position").collect(), weights, have)
    assert runs[0] == runs[1]
    cut = sampling.interleave(sources, weights, "n", "id", budget=4000).orderBy("position").collect()
    _check_order(cut, weights, have, 4000)
    assert [(r["position"], r["source"], r["id"], r["n"]) for r in cut] == runs[0][:len(cut)]
    with pytest.raises(GuardError, match="b"):
        sampling.interleave({"a": a, "b": b.limit(0), "c": c}, weights, "n", "id")
    with pytest.raises(ValueError, match="positive"):
        sampling.interleave(sources, {"a": 1, "b": 0}, "n", "id")
    none = sampling.interleave({"a": a.limit(0)}, {"a": 1}, "n", "id", required=())
    assert none.count() == 0 and {"source", "position"} <= set(none.columns)


def _examples(spark):
    segs = [[("<reserved_0>\nabc 12", False), ("<reserved_3>{\"é\"}", True)], [("zz", False)], [("abc abc", True)]]
    return packing.with_pieces(spark.createDataFrame(list(enumerate(segs)), "example_id INT, segments ARRAY<STRUCT<text: STRING, train: BOOLEAN>>"))


def test_pieces_and_mask(spark):
    r = {x["example_id"]: x for x in _examples(spark).collect()}
    assert r[0]["pieces"] == ["<reserved_0>", "\n", "abc", " ", "12", "<reserved_3>", "{", '"', "é", '"', "}"]
    assert list(r[0]["mask"]) == [0] * 5 + [1] * 6
    for marker in (t.USER, t.ASSISTANT, t.TOOLS, t.TOOL_CALL, t.TOOL_RESULT):
        assert spark.range(1).select(packing.pieces(F.lit(marker)).alias("p")).first()["p"] == [marker]
    assert {x["example_id"] for x in packing.drop_untrained(_examples(spark)).collect()} == {0, 2}


def test_encode(spark):
    ex = _examples(spark)
    vocab = packing.build_vocab(ex, packing.FIRST_ID + 3)
    ids = {r["piece"]: r["id"] for r in vocab.collect()}
    marks = {m: packing.MARKER_ID + i for i, m in enumerate(packing.MARKERS)}
    assert ids == {"abc": packing.FIRST_ID, " ": packing.FIRST_ID + 1, '"': packing.FIRST_ID + 2, **marks}
    with pytest.raises(ValueError):
        packing.build_vocab(ex, packing.FIRST_ID)
    got = {r["example_id"]: r for r in packing.with_counts(packing.encode(ex, vocab)).collect()}
    assert got[2]["ids"] == [ids["abc"], ids[" "], ids["abc"], t.EOS_ID] and list(got[2]["mask"]) == [1, 1, 1, 1]
    z = packing.BYTE_ID + ord("z")
    assert got[1]["ids"] == [z, z, t.EOS_ID] and (got[1]["n_tokens"], got[1]["n_trained"]) == (3, 1)
    # the digits and the accented letter take a token a byte
    assert got[0]["ids"][2] == ids["abc"] and got[0]["n_tokens"] == 14 and got[0]["n_trained"] == 8
    assert all(len(r["ids"]) == len(r["mask"]) for r in got.values())


def test_encoding_loses_nothing(spark):
    """Any text comes back from its ids, also with a vocabulary that holds next to nothing."""
    texts = ["<reserved_0>pay 1234567890 to ẹkọ 中文 <reserved_3>{\"a\": 5000}", "", "\u0000\n\t 😀"]
    df = spark.createDataFrame([(i, [(x, True)]) for i, x in enumerate(texts)], "example_id INT, segments ARRAY<STRUCT<text: STRING, train: BOOLEAN>>")
    ex = packing.with_pieces(df)
    vocab = packing.build_vocab(ex, packing.FIRST_ID + 2)
    back = packing.decode(packing.encode(ex, vocab), vocab)
    assert {r["example_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_encode_with_a_tokenizer(spark):
    """Character pairs merge across the edge, so the second segment's prefix is unstable."""
    def tokenizer(texts):
        return [[sum(map(ord, x[i:i + 2])) for i in range(0, len(x), 2)] for x in texts]
    df = spark.createDataFrame([(1, [("abc", False), ("d", True)]), (2, [("ab", False), ("cd", True)])],
                               "example_id INT, segments ARRAY<STRUCT<text: STRING, train: BOOLEAN>>")
    got = {r["example_id"]: (r["ids"], list(r["mask"])) for r in packing.encode_with(df, tokenizer).collect()}
    assert got[1] == ([195, 99, 100, 2], [0, 0, 1, 1]) and got[2] == ([195, 199, 2], [0, 1, 1])


def test_encode_works_in_steps(spark, monkeypatch):
    """One large batch is encoded a bounded number of pieces at once, with the same ids; a larger example is by itself."""
    monkeypatch.setattr(packing, "STEP_PIECES", 20)
    met = []
    index_in = packing.pc.index_in
    monkeypatch.setattr(packing.pc, "index_in", lambda flat, **more: met.append(len(flat)) or index_in(flat, **more))
    rows = [(i, [f"p{j}" for j in range(n)], [j % 2 for j in range(n)]) for i, n in enumerate([0, 7, 7, 7, 50, 0, 20, 1, 19, 1, 0])]
    batch = packing.pa.RecordBatch.from_arrays([packing.pa.array([r[0] for r in rows]), packing.pa.array([r[1] for r in rows]),
                                                packing.pa.array([r[2] for r in rows], packing.pa.list_(packing.pa.int8()))], ["example_id", "pieces", "mask"])

    class Frame:
        schema = spark.createDataFrame([], "example_id BIGINT").schema

        def select(self, *names):
            return self

        def mapInArrow(self, coded, told):
            return list(coded(iter([batch])))

    vocab = spark.createDataFrame([("p1", 900), ("p2", 901)], "piece STRING, id INT")
    got = [r for out in packing.encode(Frame(), vocab) for r in out.to_pylist()]
    ids = {"p1": [900], "p2": [901]}
    spell = lambda p: ids.get(p, [packing.BYTE_ID + b for b in p.encode()])
    want = [{"example_id": i, "ids": [x for p in ps for x in spell(p)] + [t.EOS_ID], "mask": [m for p, m in zip(ps, ms) for _ in spell(p)] + [1]} for i, ps, ms in rows]
    assert got == want
    assert max(m for m in met if m != 50) <= 20 and len(met) > 4


@pytest.mark.parametrize("query", ["encode_mask", "quality_gate"])
def test_encoding_keeps_no_examples(spark, tmp_path, query):
    """The examples are many times the tables, so none are kept in the executors' memory or on their disks."""
    spark.range(40).selectExpr("id AS event_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'{\"k\": 1}' AS props",
                               "id AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(20).selectExpr("id div 4 AS conv_id", "id % 4 AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
                               "concat('said ', id) AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert QUERIES[query](spark, str(tmp_path)).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_shards(spark, tmp_path):
    df = spark.range(500).select("id", ((F.col("id") * 37) % 50 + 1).cast("int").alias("n"))
    for parts in (1, 64):
        got = {r["id"]: r["shard_id"] for r in packing.assign_shards(df.repartition(parts), "n", "id", 1000).collect()}
        held, shard, want = 0, 0, {}
        for i in sorted(range(500), key=lambda i: (h(18, i, "shuffle"), i)):
            want[i] = shard
            held += i * 37 % 50 + 1
            if held >= 1000:
                held, shard = 0, shard + 1
        assert got == want
    coded = spark.range(300).select(F.col("id").alias("example_id"), F.array_repeat(F.lit(7), 9).alias("ids"),
                                    F.array_repeat(F.lit(1).cast("tinyint"), 9).alias("mask"))
    index = writers.write_shards(coded, f"{tmp_path}/s", cap=500)
    rows = index.collect()
    assert sum(r["n_tokens"] for r in rows) == 2700 and all(r["n_tokens"] <= 500 + 9 for r in rows)
    writers.write_shards(coded, f"{tmp_path}/s", cap=500)
    assert spark.read.parquet(f"{tmp_path}/s/shards").count() == 300


GRAMMAR = {"shot": {"wide shot": 9, "insert": 1}, "move": {"pan": 1, "tilt": 1}, "angle": {}, "time": {"day": 1}}


def test_video_jobs(spark):
    g = seeding.grammar_table(spark, GRAMMAR, {"wide shot|pan": 1})
    rows = seeding.video_jobs(spark, 2000, g, wave=2).collect()
    for r in rows:
        names = [x["name"] for x in r["menu"]]
        assert names.count(t.VIDEO_TOOL) == 1 and 4 <= len(names) <= 6 and len(set(names)) == len(names)
        assert r["angle"] == t.EMPTY_GRAMMAR_TERM and r["time"] == "day"
        assert (r["shot2"] is None) == (r["shots"] == 1) and r["shot2"] != r["shot"] and r["move2"] != r["move"]
        assert r["brief"] in (t.SEQUENCE_BRIEFS if r["shots"] > 1 else t.SINGLE_BRIEFS)
    wide = sum(r["shot"] == "wide shot" for r in rows) / 2000
    assert abs(wide - (0.72 + 0.28 * 0.9)) < 0.03
    multi = sum(r["shots"] > 1 for r in rows) / 2000
    assert abs(multi - 0.62 * 4 / 6) < 0.04


def test_empty_grammar_falls_back(spark):
    g = spark.createDataFrame([], "grp STRING, term STRING, n BIGINT")
    r = seeding.video_jobs(spark, 3, g).first()
    assert (r["shot"], r["move"], r["angle"]) == (t.EMPTY_GRAMMAR_TERM,) * 3


def test_tool_jobs(spark):
    jobs = seeding.tool_jobs(spark, 60).collect()
    assert len(jobs) == 240 and len({j["id"] for j in jobs}) == 240
    styles = {x: names for x, names in t.STYLES.items()}
    for j in jobs:
        names = [x["name"] for x in j["menu"]]
        assert len(set(names)) == 6 and set(names) <= set(styles[j["style"]])
        assert j["type"] not in ("toolcall_api", "tooldisambig") or j["target"] in names
        assert j["type"] != "toolpatch" or any(f'"name":"{n}"' in j["current"] for n in names)
        for tool in j["menu"]:
            assert all((k in t.NUMERIC_ARGS) == (v == "number") for k, v in tool["arguments"].items())
    assert {j["mode"] for j in jobs if j["type"] == "toolrefuse"} == set(t.MODES)


def test_sessions_switch_after_the_first_turn(spark):
    rows = seeding.session_jobs(seeding.spine(spark, 400, "t3-sess"), 1).collect()
    for r in rows:
        langs = r["langs"]
        assert 4 <= len(langs) <= 7 and langs[0] in t.NG and r["lang"] == langs[0]
        moves = sum(a != b for a, b in zip(langs, langs[1:]))
        assert 1 <= moves <= 2
    assert any(len(set(r["langs"])) == 3 for r in rows)


def test_act_jobs_without_a_weighted_concept(spark):
    jobs = seeding.act_jobs(seeding.spine(spark, 500, "t4-act"), 1)
    assert seeding.drop_untargeted(jobs).count() + jobs.filter("target IS NULL").count() == 500


def test_balance_tops_up(spark):
    have = seeding.refuse_jobs(seeding.spine(spark, 5, "t2-ref"), 1)
    out = seeding.balance(have, {"toolrefuse": 8, "toolpatch": 3})
    assert {r["type"]: r["count"] for r in out.groupBy("type").count().collect()} == {"toolrefuse": 8, "toolpatch": 3}


def test_weighted_choice_wide_equals_its_weights(spark):
    weights = spark.range(3000).select(F.col("id").cast("string").alias("term"), F.when(F.col("id") == 7, 3000).otherwise(1).cast("bigint").alias("n"))
    rows = spark.range(4000).select("id")
    got = seeding.weighted_choice(rows, weights, "term", wide_draw(1, F.col("id"), "w"))
    assert got.count() == 4000 and abs(got.filter("term = '7'").count() / 4000 - 0.5) < 0.03


def test_inline_and_joined_draws_agree(spark):
    """Zero weights and order of rows change nothing, and totals past 2^32 draw evenly."""
    big = 5_000_000_000
    rows = [(f"t{i}", big if i < 2 else 0) for i in range(1500)]
    weights = spark.createDataFrame(rows, "term STRING, n BIGINT").repartition(3)
    ids = spark.range(2000).select("id", wide_draw(3, F.col("id"), "w").alias("d"))
    joined = {r["id"]: r["term"] for r in seeding.weighted_choice(ids, weights, "term", F.col("d")).collect()}
    held = ids.withColumn("w", seeding.inline(weights)).select("id", weighted_of(F.col("d"), F.col("w")).alias("term"))
    assert joined == {r["id"]: r["term"] for r in held.collect()}
    assert abs(sum(x == "t0" for x in joined.values()) / 2000 - 0.5) < 0.04


def test_no_positive_weight_gives_the_default(spark):
    weights = spark.createDataFrame([("a", 0), ("b", -1)], "term STRING, n BIGINT")
    got = seeding.weighted_choice(spark.range(5), weights, "term", wide_draw(3, F.col("id"), "w"), "none")
    assert [r["term"] for r in got.collect()] == ["none"] * 5


def test_scaled_is_exact(spark):
    values = [0, 1, (1 << 60) - 1, 123456789012345678]
    totals = [1, 7, (1 << 33) + 5, (1 << 62) - 1]
    df = spark.createDataFrame([(v, n) for v in values for n in totals], "d BIGINT, n BIGINT").withColumn("u", scaled(F.col("d"), F.col("n")))
    assert all(r["u"] == r["d"] * r["n"] >> 60 for r in df.collect())
