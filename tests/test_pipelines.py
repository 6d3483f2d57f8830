"""Both runs end to end on files."""

import json

import pytest
from pyspark.sql import functions as F

from fixtures import ACT, CURRENT, GOOD_CALL, MENU, PROSE, call, frame, patch, rec, session
from kolanut import tables as t
from kolanut.operators.joins import GuardError
from kolanut.operators.pipelines import build_corpus, probe_report, video_cases, video_report
from kolanut.operators.scoring import score_abstain, score_ask, score_video
from kolanut.sources import readers

TOOLS = [dict(zip(("name", "description", "arguments"), x)) for x in MENU]
OUTPUTS = {
    "a1": ("toolcall_api", "USER: pay\nCALL: " + GOOD_CALL + '\nRESULT: {"status": "ok"}\nANSWER: done'),
    "a2": ("toolact", call(answer="really?")),
    "p1": ("toolpatch", patch('{"op":"patch","set":{"amount":1}}')),
    "r1": ("toolrefuse", 'USER: hi\nDECISION: {"call":null,"reason":"no_tool"}\nANSWER: hello'),
    "d1": ("tooldisambig", f"ASK: b?\nUSER2: c\nCALL: {GOOD_CALL}"),
    "s1": ("toolsession", session(ACT, PROSE, ACT)),
}


@pytest.fixture
def files(tmp_path):
    seeds = [{"id": i, "menu": TOOLS, "menu_id": i, **({"current": json.loads(CURRENT)} if i == "p1" else {})} for i in OUTPUTS]
    (tmp_path / "seeds.json").write_text(json.dumps(seeds))
    lines = [json.dumps({"id": i, "type": k, "lang": "pcm", "output": o}) for i, (k, o) in OUTPUTS.items()]
    flagged = json.dumps({"id": "x9", "type": "toolact", "output": "", "empty": True})
    (tmp_path / "out.jsonl").write_text("\n".join([*lines, lines[0], flagged]) + "\n{cut")
    return tmp_path


def test_build_corpus(spark, files):
    records, seeds = readers.read_records(spark, [f"{files}/out.jsonl"]), readers.read_seeds(spark, [f"{files}/seeds.json"])
    holdout = spark.createDataFrame([("t7-hold-1",)], "id STRING")
    got = build_corpus(records, seeds, f"{files}/run", holdout, vocab_size=300, cap=50, gate=False)
    assert got["join"].first().asDict() == {"written": 6, "no_seed": 1, "duplicates": 1, "unparseable": 1}
    assert {(r["type"], r["reason"]): r["n"] for r in got["rejects"].collect()} == {
        ("toolcall_api", None): 1, ("toolact", "asked_instead_of_acting"): 1, ("toolpatch", None): 1,
        ("toolrefuse", None): 1, ("tooldisambig", None): 1, ("toolsession", None): 1}
    # valid but without a user turn: reported as unrenderable, not lost
    assert {r["type"]: (r["kept"], r["unrenderable"]) for r in got["rendered"].collect()}["tooldisambig"] == (0, 1)
    coded = spark.read.parquet(f"{files}/run/encoded")
    assert sorted(r["id"] for r in coded.collect()) == ["a1", "p1", "r1", "s1"]  # encoded once, copied after
    copies = {i: t.DUP[OUTPUTS[i][0]] for i in ("a1", "p1", "r1", "s1")}
    assert coded.filter(F.element_at("ids", -1) != t.EOS_ID).isEmpty() and coded.filter(F.size("ids") != F.size("mask")).isEmpty()
    assert sum(r["n_tokens"] for r in got["manifest"].collect()) == sum(len(r["ids"]) * copies[r["id"]] for r in coded.collect())
    assert got["stats"].first()["examples"] == sum(copies.values())
    gate = got["gate"].first()
    assert gate["vocab_ok"] and gate["eos_ok"] and got["capped"].agg(F.sum("dropped")).first()[0] == 0
    with pytest.raises(GuardError, match="no renderable"):
        build_corpus(records, seeds, f"{files}/run2", vocab_size=300, cap=50, gate=False, max_per_type=0)
    with pytest.raises(GuardError):
        build_corpus(records, seeds, f"{files}/run3", spark.createDataFrame([("p1",)], "id STRING"))


def test_probe_report(spark):
    df = spark.createDataFrame([("m", "Hello."), ("m", '{"name":"x"}'), ("n", "Which?")], "model STRING, text STRING")
    rows = probe_report({"abstain": score_abstain(df), "ask": score_ask(df)}).collect()
    assert {r["model"]: (r["nocall_abstained"], r["disambig_asked"]) for r in rows} == {"m": (50.0, 0.0), "n": (100.0, 100.0)}


def test_video_run(spark):
    def brief(i, prefix, lang="yor", output="USER: make it\nCALL: x", shots=None, menu=MENU):
        return rec(f"{prefix}{i:03d}", "seedance", output, lang=lang, shots=shots, brief="a TikTok", menu=menu)
    rows = ([brief(i, "t6-hold-") for i in range(20)] + [brief(i, "t7-hold-", "eng", shots=3) for i in range(20)]
            + [brief(1, "t6-sd-"), brief(90, "t7-hold-", output="CALL: x"), brief(91, "t7-hold-", menu=None)])
    records = frame(spark, rows)
    holdout = records.select("id").filter("id LIKE '%hold%'")
    cases = video_cases(records, holdout, 12)
    assert cases.count() == 12 and cases.filter("is_seq").count() == 4
    with pytest.raises(GuardError, match="xx"):
        video_cases(frame(spark, rows + [brief(5, "t8-hold-", "xx")]), frame(spark, rows + [brief(5, "t8-hold-", "xx")]).select("id"))
    text = json.dumps({"name": "seedance_generate", "arguments": {
        "prompt": "Shot 1: a wide shot. Shot 2: a close-up. The camera uses a tilt. The image is warm.", "duration": 9, "aspect_ratio": "9:16"}})
    done = cases.select(F.lit("m").alias("model"), F.lit(text).alias("text"), F.lit("ọjọ́").alias("answer"), "lang", "brief", "shots")
    r = video_report(score_video(done)).first()
    assert (r["n"], r["sequences"], r["sequence_shots"], r["tool"]) == (12, 4, 100.0, 100.0)
    assert round(r["shots"], 3) == 33.333 and round(r["language"], 3) == 66.667 and r["postable"] == 0.0
