"""V1-V10 over derived records: the row-level reason per type, and the reports."""

from pyspark.sql import functions as F

from kolanut.operators.validation import unflagged, keep_rate, kept, reject_report, validate
from kolanut.plans.base import OUTPUTS, UNKNOWN, blocks_sql, records, records_sql, turns_sql

KINDS = (*OUTPUTS, UNKNOWN)


def _reasons(kind):
    def query(spark, sf):
        return validate(records(spark, sf, (kind,))).select("id", "reason")
    return query


def reject_histogram(spark, sf):
    return reject_report(validate(records(spark, sf, KINDS)))


def keep_rate_all(spark, sf):
    return keep_rate(validate(records(spark, sf, KINDS)))


def kept_records(spark, sf):
    return kept(validate(records(spark, sf, KINDS))).select("id", "type", "output")


def skip_flagged(spark, sf):
    """V9: flags come from the numbers of the pair's event, by type and language."""
    flagged = records(spark, sf, ("toolrefuse",)).withColumn(
        "degenerate", F.col("output").contains("reason\":\"because")).withColumn(
        "empty", F.when(F.col("output").contains("none"), True))
    return flagged.groupBy("type", "lang").agg(
        F.count(F.lit(1)).alias("total"), F.nullif(F.count_if(unflagged()), F.lit(0)).alias("left_n"))


QUERIES = {
    "validate_call": _reasons("toolcall_api"), "validate_act": _reasons("toolact"),
    "validate_video": _reasons("seedance"), "validate_patch": _reasons("toolpatch"),
    "validate_refuse": _reasons("toolrefuse"), "validate_disambig": _reasons("tooldisambig"),
    "validate_session": _reasons("toolsession"), "reject_histogram": reject_histogram,
    "keep_rate": keep_rate_all, "kept_records": kept_records, "skip_flagged": skip_flagged,
}

_CALL = "CASE WHEN json_valid(b_call) THEN CAST(b_call AS JSON) END"
_DECLARED = ("CASE WHEN c->>'$.name' = event_type THEN ['k'] WHEN c->>'$.name' = event_type || '_note' "
             "THEN ['text', 'k'] ELSE CAST([] AS VARCHAR[]) END")
_UNDECLARED = f"len(list_filter(json_keys(json_extract(c, '$.arguments')), lambda x: NOT list_contains({_DECLARED}, x))) > 0"
_CHECKS = f"""
  WHEN coalesce(b_user, '') = '' OR coalesce(b_answer, '') = '' THEN 'missing_block'
  WHEN coalesce(c->>'$.name', '') = '' THEN 'no_call'
  WHEN target IS NOT NULL AND c->>'$.name' <> target THEN 'wrong_tool_name'
  WHEN {_UNDECLARED} THEN 'undeclared_args'"""
_CASES = {
    "toolcall_api": f"SELECT id, type, CASE {_CHECKS} END AS reason FROM (SELECT *, {_CALL} AS c FROM recs JOIN blk USING (id))",
    "toolact": f"SELECT id, type, CASE {_CHECKS} WHEN contains(b_answer, '?') THEN 'asked_instead_of_acting' END AS reason "
               f"FROM (SELECT *, {_CALL} AS c FROM recs JOIN blk USING (id))",
    "seedance": f"""SELECT id, type, CASE
  WHEN coalesce(b_user, '') = '' OR coalesce(b_answer, '') = '' THEN 'missing_block'
  WHEN coalesce(c->>'$.name', '') = '' THEN 'no_call'
  WHEN c->>'$.name' <> 'seedance_generate' THEN 'wrong_tool_name'
  WHEN len(list_filter(json_keys(json_extract(c, '$.arguments')), lambda x: x NOT IN
    ('prompt', 'aspect_ratio', 'duration', 'generate_audio', 'camera_fixed'))) > 0 THEN 'undeclared_args'
  WHEN length(c->>'$.arguments.prompt') < 60 THEN 'prompt_too_short'
  WHEN NOT contains(lower(c->>'$.arguments.prompt'), 'the camera uses') THEN 'no_camera_clause'
  WHEN json_type(c, '$.arguments.duration') NOT IN ('UBIGINT', 'BIGINT')
    OR TRY_CAST(c->>'$.arguments.duration' AS DOUBLE) NOT BETWEEN 4 AND 30 THEN 'bad_duration'
  WHEN c->>'$.arguments.aspect_ratio' NOT IN ('16:9', '9:16', '1:1', '4:3', '3:4', '21:9', '9:21') THEN 'bad_aspect_ratio'
  END AS reason FROM (SELECT *, {_CALL} AS c FROM recs JOIN blk USING (id))""",
    "toolpatch": """SELECT id, type, CASE
  WHEN coalesce(p->>'$.op', '') NOT IN ('patch', 'cancel', 'confirm') THEN 'bad_op'
  WHEN p->>'$.op' = 'patch' AND len(ks) = 0 AND coalesce(json_array_length(p, '$.unset'), 0) = 0 THEN 'empty_patch'
  WHEN list_contains(ks, 'k') AND p->>'$.set.k' = current::JSON->>'$.arguments.k' THEN 'restates_unchanged'
  WHEN len(ks) > 3 THEN 'patch_too_wide' END AS reason
  FROM (SELECT *, CAST(b_patch AS JSON) AS p, CASE WHEN json_type(CAST(b_patch AS JSON), '$.set') = 'OBJECT'
    THEN json_keys(json_extract(CAST(b_patch AS JSON), '$.set')) ELSE CAST([] AS VARCHAR[]) END AS ks FROM recs JOIN blk USING (id))""",
    "toolrefuse": """SELECT id, type, CASE
  WHEN d IS NULL OR len(json_keys(d)) = 0 OR coalesce(json_type(d, '$.call'), 'NULL') <> 'NULL' THEN 'emitted_a_call'
  WHEN coalesce(d->>'$.reason', '') NOT IN ('no_tool', 'benign', 'unsafe', 'missing_info') THEN 'bad_reason'
  WHEN coalesce(b_answer, '') = '' THEN 'no_answer' END AS reason
  FROM (SELECT *, CASE WHEN json_valid(b_decision) THEN CAST(b_decision AS JSON) END AS d FROM recs JOIN blk USING (id))""",
    "tooldisambig": f"""SELECT id, type, CASE
  WHEN coalesce(b_ask, '') = '' OR coalesce(b_user2, '') = '' THEN 'missing_turn'
  WHEN length(b_ask) - length(replace(b_ask, '?', '')) <> 1 THEN 'not_one_question'
  WHEN coalesce(c->>'$.name', '') = '' THEN 'no_call'
  WHEN {_UNDECLARED} THEN 'undeclared_args' END AS reason
  FROM (SELECT *, {_CALL} AS c FROM recs JOIN blk USING (id))""",
    UNKNOWN: "SELECT id, type, 'unknown_type' AS reason FROM recs",
    "toolsession": """SELECT id, type, CASE
  WHEN n_turns < 3 THEN 'too_few_turns'
  WHEN coalesce(u1, '') = '' OR coalesce(ans1, '') = '' THEN 'missing_block'
  WHEN upper(coalesce(act1, '')) IN ('', 'NONE', 'NULL') THEN 'opens_without_acting'
  WHEN NOT prose THEN 'no_prose_turn' END AS reason
  FROM recs JOIN (SELECT id, count(*) AS n_turns, arg_min(coalesce(u, ''), n) AS u1, arg_min(coalesce(act, ''), n) AS act1,
    arg_min(coalesce(ans, ''), n) AS ans1, bool_or(coalesce(upper(act), '') IN ('NONE', 'NULL')) AS prose FROM trn GROUP BY id) USING (id)""",
}


def _ctes(kind, of=None):
    extra = turns_sql(multiline=False) if kind == "toolsession" else blocks_sql()
    return f"WITH {records_sql((kind,), of)}, {extra} {_CASES[kind]}"


_ALL = " UNION ALL ".join(f"SELECT * FROM ({_ctes(k, KINDS)})" for k in KINDS)
ORACLE = {
    name: f"SELECT id, reason FROM ({_ctes(kind)})" for name, kind in {
        "validate_call": "toolcall_api", "validate_act": "toolact", "validate_video": "seedance",
        "validate_patch": "toolpatch", "validate_refuse": "toolrefuse", "validate_disambig": "tooldisambig",
        "validate_session": "toolsession"}.items()
}
ORACLE |= {
    "reject_histogram": f"SELECT type, reason, count(*) AS n FROM ({_ALL}) GROUP BY type, reason",
    "keep_rate": f"""SELECT count(*) FILTER (reason IS NULL) AS kept, count(*) AS total,
        100.0::DOUBLE * count(*) FILTER (reason IS NULL) / count(*) AS kept_pct FROM ({_ALL})""",
    "kept_records": f"WITH {records_sql(KINDS)}, bad AS (SELECT id, reason FROM ({_ALL})) "
                    "SELECT recs.id, type, output FROM recs JOIN bad USING (id) WHERE reason IS NULL",
    "skip_flagged": f"""WITH {records_sql(('toolrefuse',))} SELECT type, lang, count(*) AS total,
        nullif(count(*) FILTER (NOT contains(output, 'reason":"because') AND NOT contains(output, 'none')), 0) AS left_n
        FROM recs GROUP BY type, lang""",
}
