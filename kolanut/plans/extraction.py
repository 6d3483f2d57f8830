"""Blocks, turns and JSON out of text."""

from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.json import compact_json, first_json
from kolanut.functions.text import blocks, is_noneish, turns
from kolanut.plans.base import blocks_sql, records, records_sql, table, texts, turns_sql


def block_parse(spark, sf):
    b = records(spark, sf, ("toolcall_api", "tooldisambig")).withColumn("b", blocks(F.col("output")))
    return b.select("id", *[F.col("b")[x].alias(f"b_{x.lower()}") for x in t.BLOCK_LABELS])


def video_block_parse(spark, sf):
    b = records(spark, sf, ("tooldisambig",)).withColumn("b", blocks(F.col("output"), t.VIDEO_LABELS))
    return b.select("id", *[F.col("b")[x].alias(f"b_{x.lower()}") for x in t.VIDEO_LABELS])


def _turn_rows(spark, sf, multiline):
    r = records(spark, sf, ("toolsession",)).select("id", F.explode(turns(F.col("output"), multiline)).alias("x"))
    return r.select("id", F.col("x.n").alias("n"), F.col("x.user").alias("u"), F.col("x.act").alias("act"),
                    F.col("x.result").alias("res"), F.col("x.answer").alias("ans"))


def turn_parse(spark, sf):
    return _turn_rows(spark, sf, True)


def turn_parse_lines(spark, sf):
    return _turn_rows(spark, sf, False)


# a prose prefix, an event's JSON, and a stop marker after it
_TEXT = ("CASE WHEN event_id % 7 = 0 THEN 'no call here' WHEN event_id % 7 = 1 THEN 'cut {\"k\": ' "
         "ELSE 'Sure: {\"name\":\"' || event_type || '\",\"arguments\":' || props || ',\"note\":null,\"rate\":1.50,"
         "\"tags\":[1, \"a\"]}' || '<reserved_5>{\"status\":1}' END")


def first_json_events(spark, sf):
    e = texts(spark, sf, "events", "event_id").select("event_id", F.expr(_TEXT).alias("text"))
    e = e.withColumn("o", first_json(F.col("text"), t.PROBE_STOPS))
    return e.select("event_id", F.col("o").isNotNull().alias("json_ok"), F.col("o")["name"].alias("name"),
                    F.col("o")["arguments"].alias("arguments"), F.col("o")["rate"].alias("rate"))


# numbers on both sides of the exponent's borders, and a control character, as a model may write them
_FORMS = ("1.50,\"small\":' || (event_id + 1) || 'e-07,\"large\":' || (event_id + 1) || 'E+13,\"exact\":[' || event_id || "
          "'00.125],\"end\":\"1.0E-5' || chr(92) || 'u001F\",")
_WRITTEN = _TEXT.replace("1.50,", _FORMS)


def compact_json_events(spark, sf):
    e = texts(spark, sf, "events", "event_id").select("event_id", F.expr(_WRITTEN).alias("text"))
    return e.select("event_id", compact_json(F.split("text", "<reserved_5>", 2)[0]).alias("body"))


def none_words(spark, sf):
    word = F.expr("CASE event_type WHEN 'click' THEN ' none ' WHEN 'view' THEN 'N/A' WHEN 'error' THEN '' "
                  "WHEN 'signup' THEN NULL ELSE props END")
    e = table(spark, sf, "events").select("event_type", word.alias("w"))
    return (e.groupBy("event_type").agg(F.count_if(is_noneish(F.col("w"))).alias("wide"),
                                        F.count_if(is_noneish(F.col("w"), t.NONE_WORDS_NARROW)).alias("narrow")))


QUERIES = {
    "block_parse": block_parse, "video_block_parse": video_block_parse, "turn_parse": turn_parse,
    "turn_parse_lines": turn_parse_lines, "first_json": first_json_events, "compact_json": compact_json_events,
    "none_words": none_words,
}

def _valid_sql(text: str) -> str:
    body = f"(SELECT event_id, string_split({text}, '<reserved_5>')[1] AS s FROM events)"
    return f"""(SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM
        (SELECT event_id, CASE WHEN strpos(s, '{{') > 0 THEN substr(s, strpos(s, '{{')) END AS j FROM {body}))"""


_VALID = _valid_sql(_TEXT)
_shortest = lambda number: f"CAST(CAST({number} AS DOUBLE) AS VARCHAR)"
ORACLE = {
    "block_parse": f"WITH {records_sql(('toolcall_api', 'tooldisambig'))}, {blocks_sql()} SELECT * FROM blk",
    "video_block_parse": f"WITH {records_sql(('tooldisambig',))}, {blocks_sql(labels=('USER', 'CALL', 'RESULT', 'ANSWER'))} SELECT * FROM blk",
    "turn_parse": f"WITH {records_sql(('toolsession',))}, {turns_sql()} SELECT * FROM trn",
    "turn_parse_lines": f"WITH {records_sql(('toolsession',))}, {turns_sql(multiline=False)} SELECT * FROM trn",
    "first_json": f"""SELECT event_id, j IS NOT NULL AS json_ok, j->>'$.name' AS name,
        CAST(json(CAST(json_extract(j, '$.arguments') AS VARCHAR)) AS VARCHAR) AS arguments,
        CASE WHEN j IS NOT NULL THEN '1.5' END AS rate FROM {_VALID}""",
    "compact_json": f"""SELECT event_id, CASE WHEN j IS NOT NULL THEN '{{"name":"' || (j->>'$.name') || '","arguments":'
        || CAST(json(CAST(json_extract(j, '$.arguments') AS VARCHAR)) AS VARCHAR)
        || ',"note":null,"rate":1.5,"small":' || {_shortest("j->>'$.small'")} || ',"large":' || {_shortest("j->>'$.large'")}
        || ',"exact":[' || {_shortest("j->>'$.exact[0]'")} || '],"end":"' || (chr(49) || '.0E-5') || chr(92) || 'u001f'
        || '","tags":[1,"a"]}}' END AS body FROM {_valid_sql(_WRITTEN)}""",
    "none_words": """SELECT event_type, count(*) FILTER (event_type <> 'purchase') AS wide,
        count(*) FILTER (event_type IN ('click', 'error', 'signup')) AS narrow FROM events GROUP BY event_type""",
}
