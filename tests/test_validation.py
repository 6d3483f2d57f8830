"""One row per reason and one clean row per type."""

import pytest
from pyspark.sql import functions as F

from fixtures import ACT, CURRENT, GOOD_CALL, PROSE, VIDEO_MENU, call, frame, patch, rec, session, video
from kolanut.operators.validation import drop_flagged, keep_rate, kept, reject_report, validate


def v(output, reason, **kw):
    kw.setdefault("menu", VIDEO_MENU)
    return (rec("x", "seedance", output, **kw), reason)


CASES = {
    "api ok": (rec("x", "toolcall_api", call(), target="send_money"), None),
    "api no target": (rec("x", "toolcall_api", call()), None),
    "api fenced": (rec("x", "toolcall_api", call("```json " + GOOD_CALL + "```")), None),
    "api no answer": (rec("x", "toolcall_api", "USER: a\nCALL: " + GOOD_CALL), "missing_block"),
    "api no user": (rec("x", "toolcall_api", "CALL: " + GOOD_CALL + "\nANSWER: b"), "missing_block"),
    "api cut": (rec("x", "toolcall_api", call('{"name":"send_money"')), "no_call"),
    "api no name": (rec("x", "toolcall_api", call('{"arguments":{}}')), "no_call"),
    "api wrong": (rec("x", "toolcall_api", call(), target="bal"), "wrong_tool_name"),
    "api extra": (rec("x", "toolcall_api", call('{"name":"send_money","arguments":{"fee":1}}')), "undeclared_args"),
    "api unknown tool": (rec("x", "toolcall_api", call('{"name":"nope","arguments":{"a":1}}')), "undeclared_args"),
    "api unknown tool, no args": (rec("x", "toolcall_api", call('{"name":"nope"}')), None),
    "api no menu": (rec("x", "toolcall_api", call('{"name":"nope","arguments":{"a":1}}'), menu=None), None),
    "api args not an object": (rec("x", "toolcall_api", call('{"name":"send_money","arguments":[1]}')), None),
    "act ok": (rec("x", "toolact", call()), None),
    "act asks": (rec("x", "toolact", call(answer="which one?")), "asked_instead_of_acting"),
    "act no block": (rec("x", "toolact", "USER: a"), "missing_block"),
    "act no call": (rec("x", "toolact", call("none")), "no_call"),
    "act wrong": (rec("x", "toolact", call(), target="bal"), "wrong_tool_name"),
    "act extra": (rec("x", "toolact", call('{"name":"bal","arguments":{"amount":1}}')), "undeclared_args"),
    "patch ok": (rec("x", "toolpatch", patch('{"op":"patch","set":{"amount":6000}}'), current=CURRENT), None),
    "patch unset": (rec("x", "toolpatch", patch('{"op":"patch","unset":["payee"]}'), current=CURRENT), None),
    "patch cancel": (rec("x", "toolpatch", patch('{"op":"cancel"}'), current=CURRENT), None),
    "patch op": (rec("x", "toolpatch", patch('{"op":"edit"}'), current=CURRENT), "bad_op"),
    "patch none": (rec("x", "toolpatch", patch("nothing"), current=CURRENT), "bad_op"),
    "patch empty": (rec("x", "toolpatch", patch('{"op":"patch","set":{},"unset":[]}'), current=CURRENT), "empty_patch"),
    "patch set not an object": (rec("x", "toolpatch", patch('{"op":"patch","set":[]}'), current=CURRENT), "empty_patch"),
    "patch restates": (rec("x", "toolpatch", patch('{"op":"patch","set":{"amount":5000}}'), current=CURRENT), "restates_unchanged"),
    "patch restates as text": (rec("x", "toolpatch", patch('{"op":"patch","set":{"amount":"5000"}}'), current=CURRENT), "restates_unchanged"),
    "patch other form": (rec("x", "toolpatch", patch('{"op":"patch","set":{"amount":5000.0}}'), current=CURRENT), None),
    "patch wide": (rec("x", "toolpatch", patch('{"op":"patch","set":{"a":1,"b":2,"c":3,"d":4}}'), current=CURRENT), "patch_too_wide"),
    "patch without current": (rec("x", "toolpatch", patch('{"op":"patch","set":{"amount":5000}}')), None),
    "refuse ok": (rec("x", "toolrefuse", 'DECISION: {"call":null,"reason":"no_tool"}\nANSWER: no'), None),
    "refuse calls": (rec("x", "toolrefuse", 'DECISION: {"call":{"name":"bal"},"reason":"no_tool"}\nANSWER: no'), "emitted_a_call"),
    "refuse empty": (rec("x", "toolrefuse", "DECISION: {}\nANSWER: no"), "emitted_a_call"),
    "refuse mode name": (rec("x", "toolrefuse", 'DECISION: {"call":null,"reason":"benign_answer"}\nANSWER: no'), "bad_reason"),
    "refuse silent": (rec("x", "toolrefuse", 'DECISION: {"reason":"unsafe"}'), "no_answer"),
    "disambig ok": (rec("x", "tooldisambig", f"USER: a\nASK: which?\nUSER2: b\nCALL: {GOOD_CALL}"), None),
    "disambig no ask": (rec("x", "tooldisambig", f"USER: a\nUSER2: b\nCALL: {GOOD_CALL}"), "missing_turn"),
    "disambig two": (rec("x", "tooldisambig", f"ASK: a? b?\nUSER2: b\nCALL: {GOOD_CALL}"), "not_one_question"),
    "disambig none": (rec("x", "tooldisambig", f"ASK: tell me\nUSER2: b\nCALL: {GOOD_CALL}"), "not_one_question"),
    "disambig no call": (rec("x", "tooldisambig", "ASK: a?\nUSER2: b\nCALL: -"), "no_call"),
    "disambig extra": (rec("x", "tooldisambig", 'ASK: a?\nUSER2: b\nCALL: {"name":"bal","arguments":{"z":1}}'), "undeclared_args"),
    "video ok": v(video(), None),
    "video no block": v("USER: a", "missing_block"),
    "video no call": v(call("x"), "no_call"),
    "video other tool": v(call(), "wrong_tool_name"),
    "video extra": v(video(fps="24"), "undeclared_args"),
    "video short": v(video(prompt='"The camera uses a pan."'), "prompt_too_short"),
    "video clause": v(video(prompt='"' + "a long caption without any direction at all, over and over again" + '"'), "no_camera_clause"),
    "video 15.0": v(video(duration="15.0"), "bad_duration"),
    "video text": v(video(duration='"15"'), "bad_duration"),
    "video true": v(video(duration="true"), "bad_duration"),
    "video 3": v(video(duration="3"), "bad_duration"),
    "video 31": v(video(duration="31"), "bad_duration"),
    "video 30": v(video(duration="30"), None),
    "video ratio": v(video(aspect_ratio='"2:1"'), "bad_aspect_ratio"),
    "session ok": (rec("x", "toolsession", session(ACT, PROSE, ACT)), None),
    "session short": (rec("x", "toolsession", session(ACT, PROSE)), "too_few_turns"),
    "session no answer": (rec("x", "toolsession", session({"USER": "a", "ACT": GOOD_CALL}, PROSE, ACT)), "missing_block"),
    "session idle": (rec("x", "toolsession", session(PROSE, ACT, ACT)), "opens_without_acting"),
    "session N/A counts as acting": (rec("x", "toolsession", session(ACT | {"ACT": "N/A"}, PROSE, ACT)), None),
    "session all act": (rec("x", "toolsession", session(ACT, ACT, ACT)), "no_prose_turn"),
    "other": (rec("x", "chat", "USER: a"), "unknown_type"),
}


@pytest.fixture(scope="module")
def reasons(spark):
    rows = [(name, *row[1:]) for name, (row, _) in CASES.items()]
    return {r["id"]: r["reason"] for r in validate(frame(spark, rows)).select("id", "reason").collect()}


@pytest.mark.parametrize("name", CASES)
def test_reason(reasons, name):
    assert reasons[name] == CASES[name][1]


def test_reports_add_up(spark):
    df = validate(frame(spark, [(name, *row[1:]) for name, (row, _) in CASES.items()]))
    report = reject_report(df).collect()
    assert sum(r["n"] for r in report) == len(CASES)
    ok = sum(reason is None for _, reason in CASES.values())
    assert kept(df).count() == ok
    rate = keep_rate(df).first()
    assert (rate["kept"], rate["total"]) == (ok, len(CASES)) and abs(rate["kept_pct"] - 100.0 * ok / len(CASES)) < 1e-9


def test_same_reasons_under_any_partitioning(spark):
    df = frame(spark, [(name, *row[1:]) for name, (row, _) in CASES.items()])
    got = [sorted((r["id"], r["reason"]) for r in validate(df.repartition(n)).select("id", F.coalesce("reason", F.lit("")).alias("reason")).collect())
           for n in (1, 4, 64)]
    assert got[0] == got[1] == got[2]


def test_flagged_rows_are_left_out(spark):
    rows = [rec("a", "toolact", ""), rec("b", "toolact", "", degenerate=True), rec("c", "toolact", "", empty=True), rec("d", "toolact", "", empty=False)]
    assert {r["id"] for r in drop_flagged(frame(spark, rows)).collect()} == {"a", "d"}
