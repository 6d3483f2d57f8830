"""Completions, replies and calls judged."""

from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.json import render_object
from kolanut.functions.lang import alias_lang, detect_lang, known_langs
from kolanut.functions.menus import declared_args
from kolanut.functions.text import beats, terms_in, wanted_ratio
from kolanut.operators.aggregates import pass_all, report_table, summary
from kolanut.operators.frames import lang_switches
from kolanut.operators.joins import missing
from kolanut.operators.scoring import (
    VIDEO_CHECKS, apply_patch, call_verdicts, score_abstain, score_ask, score_free, score_language, score_patch,
    score_schema, score_session, score_video,
)
from kolanut.plans.base import (
    BRIEF, CURRENT, LANG, MENU_SPARK, PAIRS_SQL, PATCH, SHOTS, VIDEO_CALL, VIDEO_MENU_SPARK, _spark, pairs, table, texts,
)

MODEL = "CASE user_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'nano' ELSE 'mini' END"
# what a model might write: a clean call, a wrong tool, an undeclared argument, a marker alone, a question, prose
COMPLETION = (
    "CASE event_id % 9 WHEN 0 THEN '{\"name\":\"' || event_type || '_note\",\"arguments\":{\"text\":\"x\"}}' "
    "WHEN 1 THEN '{\"name\":\"' || event_type || '\",\"arguments\":{\"zz\":1}}' WHEN 2 THEN 'I will call <|tool_call|> now' "
    "WHEN 3 THEN 'Which one do you mean?' WHEN 4 THEN 'All done.' WHEN 5 THEN 'Shall I? <reserved_3>' "
    "WHEN 6 THEN '{\"name\":\"unknown\",\"arguments\":{}}' WHEN 7 THEN '{\"name\":\"' || event_type || '\",\"arguments\":' "
    "ELSE '<reserved_3>{\"name\":\"' || event_type || '\",\"arguments\":' || props || '}<reserved_5>{\"name\":\"late\"}' END")
_WHOLE_CALL = ("'{\"name\":\"' || event_type || '\",\"arguments\":{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || "
               "'.0,\"note\":\"changed\",\"rate\":1.5}}'")
PATCH_TEXT = f"CASE WHEN event_id % 13 = 0 THEN {_WHOLE_CALL} WHEN event_id % 13 = 1 THEN 'no' ELSE {PATCH} END"


def _completions(spark, sf):
    return texts(spark, sf, "events", "event_id").select(
        "event_id", F.expr(MODEL).alias("model"), F.expr(COMPLETION).alias("text"),
        F.col("event_type").alias("expect"), F.expr(MENU_SPARK).alias("menu"))


def score_schema_rows(spark, sf):
    return score_schema(_completions(spark, sf)).select("event_id", "json_ok", "right", "args_clean")


def free_choice(spark, sf):
    return score_free(_completions(spark, sf)).select("event_id", "right", "declined")


def abstain_ask(spark, sf):
    return score_ask(score_abstain(_completions(spark, sf))).select("event_id", "abstained", "called", "asked")


def summary_by_model(spark, sf):
    return summary(score_schema(_completions(spark, sf)), ("json_ok", "right", "args_clean"))


def report_pivot(spark, sf):
    scored = score_abstain(score_schema(_completions(spark, sf)))
    checks = ("right", "args_clean", "abstained")
    long = scored.select("model", F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in checks])).alias("x")).select("model", "x.*")
    return report_table(long, checks)


def declared_lookup(spark, sf):
    c = _completions(spark, sf)
    return c.select("event_id", F.array_join(declared_args(F.col("menu"), F.concat("expect", F.lit("_note"))), ",").alias("declared"))


def _patches(spark, sf):
    return texts(spark, sf, "events", "event_id").select(
        "event_id", F.expr(_spark(CURRENT)).alias("current"), F.expr(_spark(PATCH_TEXT)).alias("text"), F.lit("k").alias("field"))


def patch_minimal_preserved(spark, sf):
    return score_patch(_patches(spark, sf)).select("event_id", "json_ok", "minimal", "preserved")


def apply_patch_rows(spark, sf):
    before = F.expr("substring(current, locate('\"arguments\":', current) + 12)")
    p = _patches(spark, sf).withColumn("r", apply_patch(before, F.col("text")))
    shown = F.array_join(F.transform(F.col("r")["fields"], lambda f: F.concat_ws("=", f["key"], f["value"], f["status"])), ";")
    return p.select("event_id", F.col("r")["op"].alias("op"), render_object(F.col("r")["after"]).alias("after"), shown.alias("fields"),
                    F.size(F.col("r")["corrupted"]).alias("corrupted"))


def session_score(spark, sf):
    """Conversations as sessions of six turns; the fifth is a call, the sixth is spoken."""
    c = texts(spark, sf, "conversations", "conv_id", "turn")
    amount = F.expr("CASE conv_id % 3 WHEN 0 THEN '{\"op\":\"patch\",\"set\":{\"total_amount\":3000}}' "
                    "WHEN 1 THEN '{\"name\":\"pay\",\"arguments\":{\"value\":2500.0,\"n\":7}}' "
                    "ELSE '{\"name\":\"pay\",\"arguments\":{\"amount\":\"3000\"}}' END")
    rows = c.select(
        F.lit("m").alias("model"), F.col("conv_id").alias("session_id"), "turn",
        F.when(F.col("turn") == 4, "call").otherwise("prose").alias("kind"),
        F.when(F.col("turn") == 4, amount).otherwise(F.col("text")).alias("text"),
        F.expr("CASE WHEN conv_id % 3 = 1 THEN 2500 ELSE 3000 END").cast("bigint").alias("want"),
        F.expr("CASE conv_id % 4 WHEN 0 THEN 'hau' WHEN 1 THEN 'ibo' WHEN 2 THEN 'eng' ELSE 'swh' END").alias("switch_to"))
    return score_session(rows).select("session_id", "amt", "kept_thread", "followed")


def language_id(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select("doc_id", detect_lang(F.col("text")).alias("guess"),
                                                detect_lang(F.col("text"), t.PROBE_WORDS).alias("probe_guess"))


def language_adherence(spark, sf):
    """Does the assistant turn keep the language of the user turn, per event type."""
    p = pairs(spark, sf).select(F.col("event_type").alias("model"), detect_lang(F.col("utext"), t.PROBE_WORDS).alias("lang"),
                                F.col("atext").alias("text"), F.when(F.col("event_id") % 5 == 0, "no call").otherwise(F.col("props")).alias("call"))
    return summary(score_language(p), ("stayed",))


def language_switches(spark, sf):
    c = texts(spark, sf, "conversations", "conv_id", "turn")
    return lang_switches(c.select("conv_id", "turn", detect_lang(F.col("text")).alias("lang")), "conv_id", "turn", "lang")


def language_coverage(spark, sf):
    """Document languages the rules do not know, with ``eng`` and ``en`` as one."""
    known = spark.createDataFrame([(x,) for x in known_langs()], "lang STRING")
    return missing(table(spark, sf, "documents").select(alias_lang(F.col("lang")).alias("lang")), known, "lang")


def _video(spark, sf):
    return pairs(spark, sf).select(
        "event_id", F.col("event_type").alias("model"), F.expr(_spark(VIDEO_CALL)).alias("text"), F.col("atext").alias("answer"),
        F.expr(LANG).alias("lang"), F.expr(BRIEF).alias("brief"), F.expr(SHOTS).alias("shots"),
        F.expr(VIDEO_MENU_SPARK).alias("menu"))


def video_brief_score(spark, sf):
    return score_video(_video(spark, sf)).select("event_id", *VIDEO_CHECKS, "n_beats", "want_beats")


def postable_rate(spark, sf):
    return pass_all(score_video(_video(spark, sf)), ("tool", "formula", "vocab", "ratio", "audio", "shots"), ("model",),
                    F.col("want_beats") > 1, "shots")


def call_verdict_rows(spark, sf):
    v = call_verdicts(_video(spark, sf))
    return v.select("event_id", "known", "undeclared", "camera_clause", "camera_terms", "ratio_ok", "duration_ok", "varied",
                    F.col("per_beat").cast("bigint").alias("per_beat"))


def prompt_terms(spark, sf):
    """X12-X14 over documents: contained terms, beats after a marker, and the ratio a text implies."""
    d = texts(spark, sf, "documents", "doc_id").select("doc_id", "text", F.concat(
        F.lit("Shot 1: "), F.col("text"), F.lit(" shot 2 : "), F.col("source"), F.lit(" Shot 3:")).alias("prompt"))
    return d.select("doc_id", F.array_join(terms_in(F.col("text"), t.MOVE_TERMS + t.SHOT_TERMS), ",").alias("terms"),
                    F.size(beats(F.col("prompt"))).alias("n_beats"), wanted_ratio(F.col("text")).alias("ratio"))


QUERIES = {
    "score_schema": score_schema_rows, "free_choice": free_choice, "abstain_ask": abstain_ask,
    "summary_by_model": summary_by_model, "report_pivot": report_pivot, "declared_lookup": declared_lookup,
    "patch_minimal_preserved": patch_minimal_preserved, "apply_patch": apply_patch_rows, "session_score": session_score,
    "language_id": language_id, "language_adherence": language_adherence, "language_switches": language_switches,
    "language_coverage": language_coverage, "video_brief_score": video_brief_score, "postable_rate": postable_rate,
    "call_verdicts": call_verdict_rows, "prompt_terms": prompt_terms,
}


def lang_sql(text: str, rules) -> str:
    """The rule cascade over a text column, as one SQL expression."""
    pad = f"(' ' || lower(regexp_replace(coalesce({text}, ''), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')) || ' ')"
    marked = lambda ws: " OR ".join(f"contains(p, ' {w} ')" for w in ws)
    hits = lambda ws: " + ".join(f"(length(p) - length(replace(p, ' {w} ', ''))) // {len(w) + 2}" for w in ws)
    scores = ", ".join(f"{{'n': {hits(ws)}, 'r': {-i}, 'lang': '{lang}'}}" for i, (lang, ws) in enumerate(rules.items()))
    return f"""(SELECT CASE
      WHEN regexp_matches(x, '[{t.YORUBA_MARKS}]') AND regexp_matches(x, '[{t.IGBO_VOWELS}]') AND NOT regexp_matches(x, '[{t.YORUBA_ONLY}]') THEN 'ibo'
      WHEN regexp_matches(x, '[{t.YORUBA_MARKS}]') THEN 'yor' WHEN regexp_matches(x, '[{t.IGBO_MARKS}]') THEN 'ibo'
      WHEN regexp_matches(x, '[{t.HAUSA_MARKS}]') THEN 'hau'
      WHEN {marked(t.PIDGIN_STRONG)} THEN 'pcm' WHEN {marked(t.HAUSA_STRONG)} THEN 'hau'
      ELSE list_sort([{{'n': 0, 'r': 1, 'lang': ''}}, {scores}], 'DESC')[1].lang END FROM (SELECT coalesce({text}, '') AS x, {pad} AS p))"""


def _lang(text, rules):
    return f"nullif({lang_sql(text, rules)}, '')"


_STOPPED = "string_split(string_split(string_split(text, '<reserved_5>')[1], '<reserved_1>')[1], '<reserved_0>')[1]"
_COMP = f"""c0 AS (SELECT *, {MODEL} AS model, {COMPLETION} AS text FROM events),
c1 AS (SELECT *, CASE WHEN strpos({_STOPPED}, '{{') > 0 THEN substr({_STOPPED}, strpos({_STOPPED}, '{{')) END AS j FROM c0),
c2 AS (SELECT *, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS o FROM c1),
c3 AS (SELECT *, o->>'$.name' AS name, coalesce(json_keys(o, '$.arguments'), []) AS ks,
  (contains(text, '<reserved_3>') OR contains(text, '<|tool_call|>') OR o IS NOT NULL) AS called FROM c2),
c4 AS (SELECT *, o IS NOT NULL AS json_ok, coalesce(name = event_type, false) AS "right",
  coalesce(name IN (event_type, event_type || '_note') AND len(list_filter(ks, lambda x: x NOT IN
    ('k', CASE WHEN name = event_type THEN 'k' ELSE 'text' END))) = 0, false) AS args_clean FROM c3)"""
_PAT = f"""p0 AS (SELECT event_id, {CURRENT} AS current, {PATCH_TEXT} AS text FROM events),
p1 AS (SELECT *, CAST(current AS JSON) AS cur, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS o FROM p0),
p2 AS (SELECT *, o->>'$.op' AS op, CASE WHEN o->>'$.op' = 'patch' THEN json_extract(o, '$.set') ELSE json_extract(o, '$.arguments') END AS body,
  CASE WHEN o->>'$.op' = 'patch' THEN coalesce(CAST(json_extract(o, '$.unset') AS VARCHAR[]), []) ELSE [] END AS uns FROM p1),
p3 AS (SELECT *, CASE WHEN json_type(body) = 'OBJECT' THEN json_keys(body) ELSE [] END AS ks,
  CAST(json_extract(cur, '$.arguments.k') AS VARCHAR) AS k0, CAST(json_extract(cur, '$.arguments.note') AS VARCHAR) AS n0 FROM p2),
p4 AS (SELECT *, CASE WHEN json_type(body) = 'OBJECT' THEN CAST(json_extract(body, '$.k') AS VARCHAR) END AS k1,
  CASE WHEN json_type(body) = 'OBJECT' THEN CAST(json_extract(body, '$.note') AS VARCHAR) END AS n1 FROM p3)"""
_PAT_SAME = "coalesce(TRY_CAST(k1 AS DOUBLE) = TRY_CAST(k0 AS DOUBLE) AND k1 NOT LIKE '\"%', k1 = k0)"
_has_word = lambda ws, x: " OR ".join(f"contains({x}, '{w}')" for w in ws)
_RATIO = lambda b: (f"CASE WHEN {_has_word(t.VERTICAL_WORDS, f'lower({b})')} THEN '9:16' "
                    f"WHEN {_has_word(t.SQUARE_WORDS, f'lower({b})')} THEN '1:1' WHEN {_has_word(t.WIDE_WORDS, f'lower({b})')} THEN '16:9' END")
_terms = lambda x, vocab: f"list_filter([{', '.join(repr(v) for v in vocab)}], lambda v: contains({x}, v))"
_BEATS = lambda p, keep="": (f"(SELECT CASE WHEN len(l) > 2 THEN list_filter(list_transform(l[2:], lambda z: trim(z, ' ' || chr(10) || chr(9))), "
                             f"lambda z: {'true' if keep else chr(122) + ' <> ' + chr(39) * 2}) ELSE CAST([] AS VARCHAR[]) END FROM (SELECT string_split(regexp_replace({p}, "
                             f"'(^|[^\\p{{L}}\\p{{N}}_])[Ss]hot\\s*[0-9]+\\s*:', '\\1' || chr(1), 'g'), chr(1)) AS l))")
_FRAMED = _terms("lower(z)", sorted(t.SHOT_TERMS + t.MOVE_TERMS))
_VARIED = f"len(list_distinct(list_filter(list_transform(bts, lambda z: array_to_string({_FRAMED}, '+')), lambda z: z <> ''))) > 1"
_VID = f"""{PAIRS_SQL},
v0 AS (SELECT event_id, event_type AS model, {VIDEO_CALL} AS text, atext AS answer, {LANG} AS lang, {BRIEF} AS brief, {SHOTS} AS shots FROM pairs),
v1 AS (SELECT *, CAST(text AS JSON) AS o FROM v0),
v2 AS (SELECT *, o->>'$.name' AS name, o->>'$.arguments.prompt' AS p, lower(o->>'$.arguments.prompt') AS low,
  o->>'$.arguments.aspect_ratio' AS ar, json_type(o, '$.arguments.duration') AS dt, TRY_CAST(o->>'$.arguments.duration' AS DOUBLE) AS d,
  o->>'$.arguments.generate_audio' = 'true' AS ga, o->>'$.arguments.camera_fixed' = 'true' AS cf FROM v1),
v3 AS (SELECT *, {_BEATS('p')} AS bts, CASE WHEN contains(low, 'the camera uses') THEN
  substr(low, strpos(low, 'the camera uses') + 15, 160) ELSE '' END AS tail, {_RATIO('brief')} AS want FROM v2),
v4 AS (SELECT *, name = 'seedance_generate' AS tool,
  contains(low, 'the camera uses') AND (contains(low, 'the image is') OR regexp_matches(p, '(?i)\\bsound includes\\b')) AS formula,
  len({_terms('low', t.SHOT_TERMS + t.MOVE_TERMS + t.ANGLE_TERMS)}) > 0 AND NOT regexp_matches(tail,
    '\\b(bokeh pan|snap zoom|hyperlapse|drone swoop|vertigo|parallax)\\b') AS vocab,
  want IS NULL OR ar = want AS ratio, dt IN ('UBIGINT', 'BIGINT') AND d BETWEEN 4 AND 30 AS duration,
  ga = regexp_matches(p, '(?i)sound includes\\s+\\S+(\\s+\\S+){{2,}}') AS audio, cf = contains(low, 'static shot') AS fixed,
  {_lang('answer', t.VIDEO_WORDS)} IS NOT DISTINCT FROM CASE lang WHEN 'eng' THEN 'en' ELSE lang END AS language,
  CASE WHEN shots > 1 THEN len(bts) >= 2 AND {_VARIED} ELSE len(bts) = 0 END AS shots_ok,
  CAST(len(bts) AS INTEGER) AS n_beats, CAST(shots AS INTEGER) AS want_beats FROM v3)"""
ORACLE = {
    "score_schema": f'WITH {_COMP} SELECT event_id, json_ok, "right", args_clean FROM c4',
    "free_choice": f'WITH {_COMP} SELECT event_id, "right", NOT called AS declined FROM c4',
    "abstain_ask": f"WITH {_COMP} SELECT event_id, NOT called AS abstained, called, contains(text, '?') AND NOT called AS asked FROM c4",
    "summary_by_model": f"""WITH {_COMP} SELECT model, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (json_ok) / count(*) AS json_ok,
        100.0::DOUBLE * count(*) FILTER ("right") / count(*) AS "right",
        100.0::DOUBLE * count(*) FILTER (args_clean) / count(*) AS args_clean FROM c4 GROUP BY model""",
    "report_pivot": f"""WITH {_COMP} SELECT model, 100.0::DOUBLE * count(*) FILTER ("right") / count(*) AS "right",
        100.0::DOUBLE * count(*) FILTER (args_clean) / count(*) AS args_clean,
        100.0::DOUBLE * count(*) FILTER (NOT called) / count(*) AS abstained FROM c4 GROUP BY model""",
    "declared_lookup": "SELECT event_id, 'text,k' AS declared FROM events",
    "patch_minimal_preserved": f"""WITH {_PAT} SELECT event_id, o IS NOT NULL AS json_ok,
        coalesce(op = 'patch', false) AND list_sort(list_distinct(list_concat(ks, uns))) = ['k'] AS minimal,
        NOT list_contains(uns, 'note') AND (n1 IS NULL OR n1 = n0) AS preserved FROM p4""",
    "apply_patch": f"""WITH {_PAT}, p5 AS (SELECT *, op = 'patch' AS patching, op IN ('cancel', 'confirm') AS ended,
        CASE WHEN op = 'patch' THEN k1 WHEN {_PAT_SAME} THEN NULL ELSE k1 END AS kc,
        CASE WHEN op = 'patch' THEN n1 WHEN n1 = n0 THEN NULL ELSE n1 END AS nc,
        list_filter(ks, lambda x: x NOT IN ('k', 'note', 'rate')) AS more FROM p4),
        p6 AS (SELECT *, CASE WHEN list_contains(uns, 'k') THEN NULL ELSE '"k":' || coalesce(kc, k0) END AS a1,
        CASE WHEN list_contains(uns, 'note') THEN NULL ELSE '"note":' || coalesce(nc, n0) END AS a2 FROM p5)
        SELECT event_id, CASE WHEN o IS NULL THEN NULL ELSE coalesce(op, 'call') END AS op,
        CASE WHEN op = 'cancel' THEN NULL WHEN o IS NULL OR op = 'confirm' THEN '{{"k":' || k0 || ',"note":' || n0 || ',"rate":1.5}}'
          ELSE '{{' || concat_ws(',', a1, a2, '"rate":1.5', nullif(array_to_string(list_transform(more, lambda x: '"' || x || '":' ||
            CAST(json_extract(body, '$.' || x) AS VARCHAR)), ','), '')) || '}}' END AS after,
        CASE WHEN o IS NULL OR coalesce(ended, false) THEN NULL ELSE concat_ws(';',
          'k=' || coalesce(CASE WHEN NOT list_contains(uns, 'k') THEN kc END, k0) || CASE WHEN list_contains(uns, 'k') THEN '=removed' WHEN kc IS NOT NULL THEN '=changed' ELSE '=untouched' END,
          'note=' || coalesce(CASE WHEN NOT list_contains(uns, 'note') THEN nc END, n0) || CASE WHEN list_contains(uns, 'note') THEN '=removed' WHEN nc IS NOT NULL THEN '=changed' ELSE '=untouched' END,
          'rate=1.5=untouched', nullif(array_to_string(list_transform(more, lambda x: x || '=' || CAST(json_extract(body, '$.' || x) AS VARCHAR) || '=added'), ';'), '')) END AS fields,
        0 AS corrupted FROM p6""",
    "session_score": f"""WITH s AS (SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN 2500 ELSE 3000 END AS want,
        CASE conv_id % 4 WHEN 0 THEN 'hau' WHEN 1 THEN 'ibo' WHEN 2 THEN 'eng' ELSE 'swh' END AS sw,
        CASE WHEN max(turn) >= 4 AND bool_or(turn = 4) THEN CASE conv_id % 3 WHEN 0 THEN '3000' WHEN 1 THEN '2500.0' ELSE '"3000"' END END AS amt,
        max(text) FILTER (turn = 5) AS said FROM conversations GROUP BY conv_id)
        SELECT conv_id AS session_id, amt, amt IS NOT NULL AND conv_id % 3 <> 2 AS kept_thread,
        coalesce({_lang('said', t.PROBE_WORDS)} = sw, false) AS followed FROM s""",
    "language_id": f"SELECT doc_id, {_lang('text', t.VIDEO_WORDS)} AS guess, {_lang('text', t.PROBE_WORDS)} AS probe_guess FROM documents",
    "language_adherence": f"""WITH {PAIRS_SQL}, l AS (SELECT event_type AS model, {_lang('utext', t.PROBE_WORDS)} AS a,
        {_lang('atext', t.PROBE_WORDS)} AS b, event_id % 5 <> 0 AS called FROM pairs)
        SELECT model, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (a = b AND called) / count(*) AS stayed FROM l GROUP BY model""",
    "language_switches": f"""WITH l AS (SELECT conv_id, turn, {_lang('text', t.VIDEO_WORDS)} AS lang FROM conversations),
        m AS (SELECT *, lag(lang) OVER w AS prev, row_number() OVER w AS i FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, count(*) AS turns, count(*) FILTER (i > 1 AND lang IS DISTINCT FROM prev) AS switches FROM m GROUP BY conv_id""",
    "language_coverage": f"""SELECT DISTINCT CASE lang WHEN 'eng' THEN 'en' ELSE lang END AS lang FROM documents
        WHERE CASE lang WHEN 'eng' THEN 'en' ELSE lang END NOT IN ({', '.join(repr(x) for x in known_langs())})""",
    "video_brief_score": f"""WITH {_VID} SELECT event_id, tool, formula, vocab, ratio, duration, audio, fixed, language,
        shots_ok AS shots, n_beats, want_beats FROM v4""",
    "postable_rate": f"""WITH {_VID}, w AS (SELECT *, tool AND formula AND vocab AND ratio AND audio AND shots_ok AS ok FROM v4)
        SELECT model, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (ok) / count(*) AS all_pass,
        count(*) FILTER (want_beats > 1) AS n_subset,
        100.0::DOUBLE * count(*) FILTER (want_beats > 1 AND shots_ok) / nullif(count(*) FILTER (want_beats > 1), 0) AS subset_pass FROM w GROUP BY model""",
    "call_verdicts": f"""WITH {_VID}, w AS (SELECT *, {_terms('low', t.SHOT_TERMS + t.MOVE_TERMS)} AS fr, {_terms('low', t.ANGLE_TERMS)} AS an,
        dt IN ('UBIGINT', 'BIGINT') OR (dt = 'DOUBLE' AND d = floor(d)) AS whole FROM v4)
        SELECT event_id, tool AS known, array_to_string(list_filter(json_keys(o, '$.arguments'), lambda x: NOT tool OR x NOT IN
          ('prompt', 'aspect_ratio', 'duration', 'generate_audio', 'camera_fixed')), ',') AS undeclared,
        contains(low, 'the camera uses') AS camera_clause,
        CASE WHEN len(fr) > 0 THEN array_to_string(list_concat(fr, an), ', ') END AS camera_terms,
        ar IN ('16:9', '9:16', '1:1', '4:3', '3:4', '21:9', '9:21') AS ratio_ok, whole AND d BETWEEN 4 AND 30 AS duration_ok,
        CASE WHEN len(bts) > 1 THEN {_VARIED} END AS varied,
        CASE WHEN whole AND len(bts) > 1 THEN CAST(floor(d / len(bts) + 0.5) AS BIGINT) END AS per_beat FROM w""",
    "prompt_terms": f"""SELECT doc_id, array_to_string({_terms('lower(text)', t.MOVE_TERMS + t.SHOT_TERMS)}, ',') AS terms,
        CAST(len({_BEATS("'Shot 1: ' || text || ' shot 2 : ' || source || ' Shot 3:'")}) AS INTEGER) AS n_beats,
        {_RATIO('text')} AS ratio FROM documents""",
}
