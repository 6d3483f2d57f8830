"""Records as training text, loss mask included."""

from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.json import compact_json
from kolanut.functions.text import turns
from kolanut.operators import histories
from kolanut.operators.rendering import (
    history, menu_json, patch_prompt, preview, probe_prompt, render, render_report, renderable, renderable_rate,
)
from kolanut.operators.sampling import exhibit
from kolanut.plans.base import MENU_SPARK, MENU_SQL, OUTPUTS, PAIRS_SQL, blocks_sql, pairs, records, records_sql, table, turns_sql


def _flat(segments):
    """All segments as one text, each behind its mask."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.when(s["train"], "<1>").otherwise("<0>"), s["text"])), "")


def _rendered(*kinds):
    def query(spark, sf):
        r = render(records(spark, sf, kinds))
        return r.select("id", F.size("segments").alias("n"), _flat(F.col("segments")).alias("flat"))
    return query


def render_counts(spark, sf):
    return render_report(render(records(spark, sf)))


def render_rate(spark, sf):
    return renderable_rate(render(records(spark, sf)))


def preview_refusals(spark, sf):
    r = renderable(render(records(spark, sf, ("toolrefuse",))))
    return r.select("id", preview(F.col("segments"), 300, 120).alias("shown"))


def probe_prompts(spark, sf):
    p = pairs(spark, sf).withColumn("m", menu_json(F.expr(MENU_SPARK)))
    current = F.expr("'{\"name\": \"' || event_type || '\", \"arguments\": ' || props || '}'")
    return p.select("event_id", probe_prompt(F.col("m"), F.col("utext"), True).alias("schema_prompt"),
                    probe_prompt(F.col("m"), F.col("utext")).alias("free_prompt"),
                    patch_prompt(F.col("m"), current, F.col("utext")).alias("patch_prompt"))


def history_prompt(spark, sf):
    """The prompt of every turn of a session, each with all turns before it."""
    r = records(spark, sf, ("toolsession",))
    ts = F.transform(turns(F.col("output")), lambda x: F.struct(
        F.coalesce(x["user"], F.lit("")).alias("user"), compact_json(x["act"]).alias("call"),
        F.coalesce(x["answer"], F.lit("")).alias("said")))
    return r.select("id", F.posexplode(history(menu_json(F.col("menu")), ts)).alias("turn", "prompt"))


def history_turns(spark, sf):
    """The prompt of every user turn of every conversation, from the turn table."""
    said = table(spark, sf, "conversations")
    return histories.turn_history(said, "conv_id", "turn", histories.said(), F.col("role") == "user", f"{t.USER}\n{t.TOOLS}[]")


def exhibit_records(spark, sf):
    """One record per type, two patches, in event order."""
    r = records(spark, sf).withColumn("pos", F.regexp_extract("id", r"-(\d+)$", 1).cast("bigint"))
    return exhibit(r.select("type", "id", "pos"), "type", "pos").select("type", "id", "rank")


QUERIES = {
    "render_call": _rendered("toolcall_api", "toolact"), "render_video": _rendered("seedance"),
    "render_patch": _rendered("toolpatch"), "render_refuse": _rendered("toolrefuse"),
    "render_disambig": _rendered("tooldisambig"), "render_session": _rendered("toolsession"),
    "render_report": render_counts, "renderable_rate": render_rate, "preview": preview_refusals,
    "probe_prompts": probe_prompts, "history_prompt": history_prompt, "history_turns": history_turns, "exhibit": exhibit_records,
}

_NL = "chr(10)"
_HEAD = f"'{t.USER}' || {_NL} || '{t.TOOLS}' || menu || {_NL} || b_user || {_NL}"
_J = lambda c: f"CAST(json({c}) AS VARCHAR)"
_OK = lambda c: f"(json_valid(coalesce({c}, '')) AND coalesce({c}, '') <> '{{}}')"
_HAS = lambda c: f"coalesce({c}, '') <> ''"
_CALL_FLAT = f"""CASE WHEN {_HAS('b_user')} AND {_OK('b_call')} AND {_HAS('b_answer')} THEN
  '<0>' || {_HEAD} || '{t.ASSISTANT}<1>{t.TOOL_CALL}' || {_J('b_call')} ||
  CASE WHEN {_OK('b_result')} THEN '<0>{t.TOOL_RESULT}' || {_J('b_result')} || '{t.ASSISTANT}<1>' || {_NL} || b_answer ELSE '' END END"""
_FLAT = {
    "toolcall_api": _CALL_FLAT, "toolact": _CALL_FLAT, "seedance": _CALL_FLAT,
    "toolpatch": f"""CASE WHEN {_HAS('b_user')} AND {_OK('b_patch')} AND {_HAS('b_answer')} THEN
      '<0>{t.USER}' || {_NL} || '{t.TOOLS}' || menu || {_NL} || '{t.ASSISTANT}{t.TOOL_CALL}' || {_J('current')} ||
      '{t.USER}' || {_NL} || b_user || {_NL} || '{t.ASSISTANT}<1>{t.TOOL_CALL}' || {_J('b_patch')} ||
      '<0>{t.ASSISTANT}<1>' || {_NL} || b_answer END""",
    "toolrefuse": f"CASE WHEN {_HAS('b_user')} AND {_HAS('b_answer')} THEN '<0>' || {_HEAD} || '{t.ASSISTANT}<1>' || {_NL} || b_answer END",
    "tooldisambig": f"""CASE WHEN {_HAS('b_user')} AND {_HAS('b_ask')} AND {_HAS('b_user2')} AND {_OK('b_call')} THEN
      '<0>' || {_HEAD} || '{t.ASSISTANT}<1>' || {_NL} || b_ask || '<0>{t.USER}' || {_NL} || b_user2 || {_NL} ||
      '{t.ASSISTANT}<1>{t.TOOL_CALL}' || {_J('b_call')} END""",
}
_NONE = lambda c: f"(upper(coalesce({c}, '')) IN ('', 'NONE', 'NULL', 'N/A', '-'))"
_SESSION = f"""SELECT id, type, lang, CASE WHEN count(n) >= 3 AND bool_and({_HAS('u')} AND {_HAS('ans')} AND ({_NONE('act')} OR {_OK('act')})) THEN
    '<0>{t.USER}' || {_NL} || '{t.TOOLS}' || any_value(menu) || string_agg(
      CASE WHEN i > 1 THEN '<0>{t.USER}' ELSE '' END || '<0>' || {_NL} || u || {_NL} || '<0>{t.ASSISTANT}' ||
      CASE WHEN {_NONE('act')} THEN '' ELSE '<1>{t.TOOL_CALL}' || {_J('act')} ||
        CASE WHEN {_NONE('res')} THEN '' ELSE '<0>{t.TOOL_RESULT}' || {_J('res')} END || '<0>{t.ASSISTANT}' END ||
      '<1>' || {_NL} || ans, '' ORDER BY n) END AS flat
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM
    (SELECT recs.id, type, lang, menu, n, u, CASE WHEN {_NONE('act')} OR json_valid(act) THEN act END AS act, res, ans FROM recs LEFT JOIN trn USING (id)))
  GROUP BY id, type, lang"""


def _flat_sql(kind, of=None):
    if kind == "toolsession":
        return f"WITH {records_sql((kind,), of)}, {turns_sql()} {_SESSION}"
    return f"WITH {records_sql((kind,), of)}, {blocks_sql()} SELECT id, type, lang, {_FLAT[kind]} AS flat FROM recs JOIN blk USING (id)"


_N = "CAST((length(flat) - length(replace(replace(flat, '<0>', ''), '<1>', ''))) // 3 AS INTEGER)"
_ALL = " UNION ALL ".join(f"SELECT * FROM ({_flat_sql(k, tuple(OUTPUTS))})" for k in OUTPUTS)
_pick = lambda *kinds: " UNION ALL ".join(f"SELECT id, {_N} AS n, flat FROM ({_flat_sql(k, kinds)})" for k in kinds)
_shown = lambda mark, body: (f"'{mark}' || replace(CASE WHEN length({body}) < 300 THEN {body} ELSE left({body}, 120) || {_NL} || '   ...[' || "
                             f"(length({body}) - 240) || ' chars]...' || {_NL} || right({body}, 120) END, {_NL}, {_NL} || '{mark}')")
ORACLE = {
    "render_call": _pick("toolcall_api", "toolact"), "render_video": _pick("seedance"), "render_patch": _pick("toolpatch"),
    "render_refuse": _pick("toolrefuse"), "render_disambig": _pick("tooldisambig"), "render_session": _pick("toolsession"),
    "render_report": f"""SELECT type, lang, count(flat) AS kept, count(*) - count(flat) AS unrenderable FROM ({_ALL}) GROUP BY 1, 2""",
    "renderable_rate": f"""SELECT type, count(flat) AS ok, count(*) AS total, 100.0::DOUBLE * count(flat) / count(*) AS pct
        FROM ({_ALL}) GROUP BY 1""",
    "preview": f"""WITH {records_sql(('toolrefuse',))}, {blocks_sql()}, segs AS (SELECT id, {_HEAD} || '{t.ASSISTANT}' AS s0,
        {_NL} || b_answer AS s1 FROM recs JOIN blk USING (id) WHERE {_HAS('b_user')} AND {_HAS('b_answer')})
        SELECT id, {_shown('   ', 's0')} || {_NL} || {_shown(' > ', 's1')} AS shown FROM segs""",
    "probe_prompts": f"""WITH {PAIRS_SQL}, m AS (SELECT *, {MENU_SQL} AS menu, '{t.USER}' || {_NL} || '{t.TOOLS}' AS h FROM pairs)
        SELECT event_id, h || menu || {_NL} || utext || {_NL} || '{t.ASSISTANT}{t.TOOL_CALL}' AS schema_prompt,
        h || menu || {_NL} || utext || {_NL} || '{t.ASSISTANT}' AS free_prompt,
        h || menu || {_NL} || '{t.ASSISTANT}{t.TOOL_CALL}{{"name":"' || event_type || '","arguments":' || CAST(json(props) AS VARCHAR)
        || '}}{t.USER}' || {_NL} || utext || {_NL} || '{t.ASSISTANT}{t.TOOL_CALL}' AS patch_prompt FROM m""",
    "history_prompt": f"""WITH {records_sql(('toolsession',))}, {turns_sql()}, x AS (
        SELECT id, n, menu, coalesce(u, '') AS u, {_NL} || coalesce(u, '') || {_NL} || '{t.ASSISTANT}' ||
          CASE WHEN strpos(coalesce(act, ''), '{{') > 0 AND json_valid(act) THEN '{t.TOOL_CALL}' || {_J('act')} ||
            '{t.TOOL_RESULT}{{"status":"success"}}{t.ASSISTANT}' ELSE '' END || {_NL} || coalesce(ans, '') || '{t.USER}' AS done
        FROM (SELECT recs.id, menu, n, u, ans, CASE WHEN json_valid(act) THEN act END AS act FROM recs JOIN trn USING (id)))
        SELECT id, CAST(row_number() OVER w - 1 AS INTEGER) AS turn, '{t.USER}' || {_NL} || '{t.TOOLS}' || menu ||
          coalesce(string_agg(done, '') OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ||
          {_NL} || u || {_NL} || '{t.ASSISTANT}' AS prompt FROM x WINDOW w AS (PARTITION BY id ORDER BY n)""",
    "history_turns": f"""SELECT conv_id, turn, prompt FROM (SELECT conv_id, turn, role, '{t.USER}' || {_NL} || '{t.TOOLS}[]' || string_agg({_NL} || coalesce(text, '') ||
        CASE WHEN role = 'user' THEN {_NL} || '{t.ASSISTANT}' ELSE '{t.USER}' END, '') OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations)
        WHERE role = 'user'""",
    "exhibit": f"""WITH {records_sql()} SELECT type, id, rank FROM (SELECT type, id, row_number() OVER (PARTITION BY type
        ORDER BY CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT)) AS rank FROM recs)
        WHERE rank <= CASE WHEN type = 'toolpatch' THEN 2 ELSE 1 END""",
}
