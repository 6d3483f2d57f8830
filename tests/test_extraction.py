"""Planted cases for the text and JSON expressions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.json import (
    call_amount, compact_json, first_json, json_literals, same_literal,
)
from kolanut.functions.lang import alias_lang, detect_lang
from kolanut.functions.text import (
    beats, blocks, is_noneish, sentences, tag_terms, tagged_spans, terms_in, turns, wanted_ratio,
)


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "s STRING").select(expr(F.col("s")).alias("x")).first()["x"]


def many(spark, texts, expr):
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, s STRING").select("i", expr(F.col("s")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("text,want", [
    ("note\nUSER: hi  \n there \nUSER2 : x\r\nANSWER:\n\n  foo \nUSER: again", {"USER": "again", "USER2": "x", "ANSWER": "foo"}),
    ("USER: a  \n b", {"USER": "a\n b"}),
    ("  CALL : {x} USER: y", {"CALL": "{x}", "USER": "y"}),
    ("user: a\nUSERS: b", {}), ("", {}), (None, {}),
    ("USER:\nRESULT: ", {"USER": "", "RESULT": ""}),
])
def test_blocks(spark, text, want):
    assert one(spark, text, blocks) == want


def test_video_labels_leave_the_others_in_place(spark):
    got = one(spark, "USER: a\nASK: b?\nANSWER: c", lambda c: blocks(c, t.VIDEO_LABELS))
    assert got == {"USER": "a\nASK: b?", "ANSWER": "c"}


def test_turns_are_sorted_and_repeats_win(spark):
    text = "T10_USER: j\nT2_USER: b\nT1_USER: a\nmore\nT1_ACT: NONE\nT1_USER: a2\nT2_ANSWER: q\n tail"
    got = one(spark, text, turns)
    assert [(x.n, x.user, x.act, x.answer) for x in got] == [(1, "a2", "NONE", None), (2, "b", None, "q\n tail"), (10, "j", None, None)]
    lines = one(spark, text, lambda c: turns(c, multiline=False))
    assert lines[1].answer == "q"


def test_first_json(spark):
    texts = ['x {"a":1,"b":"y","a":2} tail', '{"a":1', "no", '{bad} {"a":1}', None, '{"a":{"b":[1, 2]}}', "{}", "{'a':1}", '{"a":null}']
    got = many(spark, texts, first_json)
    assert got == [{"a": "2", "b": "y"}, None, None, None, None, {"a": '{"b":[1,2]}'}, {}, None, {"a": None}]


def test_first_json_stops_at_a_marker(spark):
    got = many(spark, ['{"a":1}<reserved_5>{"b":2}', '<reserved_1>{"a":1}', '<|assistant|>x {"a":1}', '<reserved_3>{"a":1}'],
               lambda c: first_json(c, t.PROBE_STOPS))
    assert got == [{"a": "1"}, None, None, {"a": "1"}]


def test_compact_json_writes_numbers_and_escapes_in_their_usual_form(spark):
    texts = ['{"a":1e-05}', '{"a":1E+22,"b":1e16}', '{"a":123456789.125,"b":-0.00001234}', '{"a":"\\u001f \\u000B x \\\\u001F 1.0E-5"}',
             '{"a":[1e-05,{"b":1e16,"c":"1.0E22"}],"d":12345678.0}', '{"a":1e15,"b":9.999e-5,"c":0.0001,"d":1e100,"e":-1e-10,"f":1e8}',
             '{"k\\u001F":1,"x":"E5","y":"\\u00e9\\"q"}', '{"n":1.50,"m":1e2,"o":10000000.5,"z":12345678901234567890}',
             '{"a":"' + "x\\n" * 20_000 + '","b":1e-7}']
    want = [json.dumps(json.loads(x), separators=(",", ":"), ensure_ascii=False) for x in texts]
    assert many(spark, texts, compact_json) == want


def test_compact_json_keeps_literals_and_order(spark):
    texts = ['{ "b" : 1.0, "a": "5", "c": 5, "d": null, "e": [1, "x"], "f": {"k": true} , "g":1e5}',
             '{"a":"q\\"uo\\nte","é":"ñ"}', '{"a":1,"b":2,"a":3}', '{"a":NaN}', "nothing", '{"n":{"x":1,"x":2},"s":"t"}']
    assert many(spark, texts, compact_json) == [
        '{"b":1.0,"a":"5","c":5,"d":null,"e":[1,"x"],"f":{"k":true},"g":100000.0}',
        '{"a":"q\\"uo\\nte","é":"ñ"}', '{"a":3,"b":2}', '{"a":NaN}', None, '{"n":{"x":1,"x":2},"s":"t"}']


@pytest.mark.parametrize("a,b,want", [
    ("250000", "250000.0", True), ('"250000"', "250000", False), ("null", "null", True), ("true", "true", True),
    ('"x"', '"x"', True), ("1", "2", False), (None, "1", False)])
def test_same_literal(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING")
    assert df.select(same_literal(F.col("a"), F.col("b")).alias("x")).first()["x"] is want


def test_call_amount_takes_the_last(spark):
    texts = ['{"amount":"3000","n":5}', '{"n":150,"k":99}', '{"TotalAmount":7,"big":101.5}', '{"s":"500"}']
    got = many(spark, texts, lambda c: call_amount(json_literals(c)))
    assert got == ['"3000"', "150", "101.5", None]


def test_noneish_wide_and_narrow(spark):
    texts = [None, "", " none ", "NULL", "n/a", "-", "no"]
    assert many(spark, texts, is_noneish) == [True, True, True, True, True, True, False]
    assert many(spark, texts, lambda c: is_noneish(c, t.NONE_WORDS_NARROW)) == [True, True, True, True, False, False, False]


@pytest.mark.parametrize("text,want", [
    ("Mo ń ṣe fídíò", "yor"), ("ọ dị mma", "ibo"), ("ọjọ", "yor"), ("ṅ", "ibo"), ("ƙasa", "hau"),
    ("I dey work on dat video for your website", "pcm"), ("muna yin bidiyo", "hau"), ("yes o my friend", "pcm"),
    ("we are making your video now", "en"), ("Siyakwenza yakho futhi", "zul"), ("turimo gukora videwo yawe", "kin"),
    ("tichagadzira vhidhiyo yenyu", "sna"), ("tunatengeneza video yako", "swh"), ("", None), (None, None), ("xyzzy", None),
    # a tie goes to the first rule, and a run of one word counts every other time
    ("se sosai", "yor"), ("ku ku ku se se", "hau"), ("ku ku se", "yor"), ("Na, na", "hau"),
])
def test_language_rules(spark, text, want):
    assert one(spark, text, detect_lang) == want


def _count_rule(text):
    padded = f" {re.sub(r'[^a-z0-9]', ' ', text.lower())} "
    hits = {lang: sum(len(padded.split(f" {w} ")) - 1 for w in words) for lang, words in t.VIDEO_WORDS.items()}
    top = max(hits.values())
    return next(lang for lang in hits if hits[lang] == top) if top else None


def test_word_counts_match_brute_force(spark):
    words = sorted({w for ws in t.VIDEO_WORDS.values() for w in ws} - set(t.PIDGIN_STRONG) - set(t.HAUSA_STRONG))
    texts = [" ".join(words[(i * 7 + j * (1 + i % 5) // (1 + i % 3)) % len(words)] + (", " if (i + j) % 11 == 0 else "")
                      for j in range(3 + i % 17)) for i in range(150)]
    assert many(spark, texts, detect_lang) == [_count_rule(x) for x in texts]


def test_language_alias(spark):
    assert many(spark, ["eng", "en", "yor", None], alias_lang) == ["en", "en", "yor", None]


def test_scene_spans_and_sentences(spark):
    text = "<scene_description>A day. B! \n</scene_description> x <scene_description>open?  end\n"
    spans = one(spark, text, tagged_spans)
    assert spans == ["A day. B! \n", "open?  end"]
    assert many(spark, ["A day. B! \n", "one", "", "a. b"], sentences) == [["A day.", "B!", ""], ["one"], [""], ["a.", "b"]]


def test_dictionary_default_and_anchored(spark):
    shot, time = t.DICTIONARY["shot"], t.DICTIONARY["time"]
    assert one(spark, "they execute forms", lambda c: tag_terms(c, shot)) == ["extreme close-up", "medium shot"]
    assert one(spark, "they execute forms", lambda c: tag_terms(c, shot, anchored=True)) == []
    assert one(spark, "ECU. Close-up; CLOSE UP", lambda c: tag_terms(c, shot, anchored=True)) == ["extreme close-up", "close-up"]
    assert one(spark, "Today, NIGHTfall; dayé and Dawn", lambda c: tag_terms(c, time)) == ["dawn"]
    assert one(spark, "P.O.V. and o.t.s", lambda c: tag_terms(c, shot)) == ["over-the-shoulder", "point of view"]


def test_terms_beats_ratio(spark):
    assert one(spark, "An Extreme Wide Shot of the company", lambda c: terms_in(c, t.SHOT_TERMS + t.MOVE_TERMS)) == [
        "wide shot", "extreme wide shot", "pan"]
    assert many(spark, ["Shot 1: a", "Shot 1: a shot 2 : b", "x Shot 1:  Shot2: b Snapshot 3: c", None], beats) == [
        [], ["a", "b"], ["b Snapshot 3: c"], []]
    assert many(spark, ["a TikTok for the feed", "Instagram", "tv advert", "a farmer", None], wanted_ratio) == [
        "9:16", "1:1", "16:9", None, None]
