"""Tool-call records derived from the given tables, as Spark frames and as SQL for the check.

The tables hold no tool calls, so each event makes a record, put together with a user turn and the assistant
turn after it; a turn that nobody answered leaves the reply empty, and every eleventh event
carries a planted fault per rule. The texts are plain SQL that both engines read alike, so both sides start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolanut.operators.frames import position_chunk, running_total

MENU_SPARK = (
    "array(named_struct('name', event_type, 'description', 'Record the event', 'arguments', map('k', 'number')), "
    "named_struct('name', concat(event_type, '_note'), 'description', 'Add a note', "
    "'arguments', map('text', 'string', 'k', 'number')))")
MENU_SQL = (
    "'[{\"name\":\"' || event_type || '\",\"description\":\"Record the event\",\"arguments\":{\"k\":\"number\"}},"
    "{\"name\":\"' || event_type || '_note\",\"description\":\"Add a note\",\"arguments\":"
    "{\"text\":\"string\",\"k\":\"number\"}}]'")
VIDEO_MENU_SPARK = (
    "array(named_struct('name', 'seedance_generate', 'description', 'Generate a clip', 'arguments', "
    "map('prompt', 'string', 'aspect_ratio', 'string', 'duration', 'number', "
    "'generate_audio', 'boolean', 'camera_fixed', 'boolean')))")
VIDEO_MENU_SQL = (
    "'[{\"name\":\"seedance_generate\",\"description\":\"Generate a clip\",\"arguments\":{\"prompt\":\"string\","
    "\"aspect_ratio\":\"string\",\"duration\":\"number\",\"generate_audio\":\"boolean\",\"camera_fixed\":\"boolean\"}}]'")

LANG = "CASE conv_id % 4 WHEN 0 THEN 'pcm' WHEN 1 THEN 'yor' WHEN 2 THEN 'ibo' ELSE 'hau' END"
_F = "event_id % 11"
_NL = "chr(10)"
_CALL = ("'{\"name\":\"' || event_type || '\",\"arguments\":' || "
         f"CASE WHEN {_F} = 3 THEN replace(props, '\"k\"', '\"zz\"') ELSE props END || '}}'")
_CUT = f"CASE WHEN {_F} = 1 THEN '{{\"name\":\"' || event_type || '\"' ELSE {_CALL} END"
_RESULT = f"CASE WHEN {_F} = 7 THEN '' ELSE {_NL} || 'RESULT: {{\"status\": \"ok\", \"n\": 1.0}}' END"
_NUMBER = "regexp_extract(props, '([0-9]+)', 1)"

VIDEO_PROMPT = (
    "translate(utext, chr(10) || chr(34) || chr(92), '   ') || CASE event_id % 5 "
    "WHEN 0 THEN '. The camera uses a wide shot and a pan. The image is warm.' "
    "WHEN 1 THEN ' Shot 1: close-up, dolly in. The camera uses a tilt. Shot 2: medium shot. Sound includes the rain and far traffic.' "
    "WHEN 2 THEN ' Shot 1: wide shot. Shot 2: wide shot. The camera uses a static shot. Sound includes rain.' "
    "WHEN 3 THEN '. The camera uses a hyperlapse over the-shoulder. The image is cold.' "
    "ELSE '. The camera uses a static shot, low angle. Sound includes drums, horns and voices' END")

_VIDEO_ARGS = (
    "'{\"prompt\":\"' || CASE WHEN " + _F + " = 6 THEN 'Short. The camera uses a pan' WHEN " + _F + " = 7 THEN "
    "replace(" + VIDEO_PROMPT + ", 'The camera uses', 'There is') ELSE " + VIDEO_PROMPT + " END || "
    "'\",\"aspect_ratio\":\"' || CASE WHEN " + _F + " = 5 THEN '2:1' WHEN event_id % 3 = 0 THEN '9:16' "
    "WHEN event_id % 3 = 1 THEN '16:9' ELSE '1:1' END || '\",\"duration\":' || CASE " + _F +
    " WHEN 0 THEN '3' WHEN 1 THEN '\"15\"' WHEN 2 THEN '15.0' WHEN 3 THEN '31' WHEN 4 THEN 'true' "
    "ELSE CAST(4 + turn AS VARCHAR(9)) END || ',\"generate_audio\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END "
    "|| ',\"camera_fixed\":' || CASE WHEN event_id % 5 IN (2, 4) AND event_id % 2 = 0 THEN 'true' ELSE 'false' END "
    "|| CASE WHEN " + _F + " = 9 THEN ',\"fps\":24' ELSE '' END || '}'")
VIDEO_CALL = ("'{\"name\":\"' || CASE WHEN " + _F + " = 8 THEN 'seedance_extend' ELSE 'seedance_generate' END || "
              "'\",\"arguments\":' || " + _VIDEO_ARGS + " || '}'")
BRIEF = ("CASE event_id % 6 WHEN 0 THEN 'a clip for her WhatsApp Status' WHEN 1 THEN 'an advert for television' "
         "WHEN 2 THEN 'a square clip for Instagram' WHEN 3 THEN 'a TikTok teaser for the feed' "
         "WHEN 4 THEN 'the harvest for a buyer abroad' ELSE 'an explainer for its website' END")
SHOTS = "CASE WHEN event_id % 5 IN (1, 2) THEN 2 WHEN event_id % 7 = 0 THEN 3 ELSE 1 END"

CURRENT = ("'{\"name\":\"' || event_type || '\",\"arguments\":{\"k\":' || " + _NUMBER +
           " || ',\"note\":\"ref ' || CAST(event_id AS VARCHAR(20)) || '\",\"rate\":1.50}}'")
PATCH = (
    "CASE " + _F + " WHEN 0 THEN '{\"op\":\"edit\",\"set\":{\"k\":1}}' WHEN 1 THEN '{\"op\":\"patch\"}' "
    "WHEN 2 THEN '{\"op\":\"patch\",\"set\":' || props || '}' "
    "WHEN 3 THEN '{\"op\":\"patch\",\"set\":{\"a\":1,\"b\":2,\"c\":3,\"d\":4}}' "
    "WHEN 4 THEN '{\"op\":\"cancel\"}' WHEN 5 THEN '{\"op\":\"confirm\"}' "
    "WHEN 6 THEN '{\"op\":\"patch\",\"set\":{\"k\":\"' || " + _NUMBER + " || '\"}}' "
    "WHEN 7 THEN '{\"op\":\"patch\",\"unset\":[\"note\"]}' "
    "WHEN 8 THEN '{\"op\":\"patch\",\"set\":[]}' WHEN 9 THEN '{\"op\":\"patch\",\"set\":{\"k\":7000},\"unset\":[\"note\"]}' "
    "ELSE '{\"op\":\"patch\",\"set\":{\"k\":9000,\"why\":\"more\"}}' END")
DECISION = (
    "CASE " + _F + " WHEN 0 THEN '{\"call\":{\"name\":\"x\"},\"reason\":\"no_tool\"}' "
    "WHEN 1 THEN '{\"call\":null,\"reason\":\"because\"}' WHEN 3 THEN '{}' WHEN 4 THEN 'none' "
    "WHEN 5 THEN '{\"reason\":\"benign\"}' ELSE '{\"call\":null,\"reason\":\"' || CASE turn % 3 WHEN 0 THEN 'no_tool' "
    "WHEN 1 THEN 'unsafe' ELSE 'missing_info' END || '\"}' END")
ASK = (f"CASE {_F} WHEN 0 THEN '' WHEN 1 THEN 'ASK: Which one? This one?' || {_NL} "
       f"WHEN 2 THEN 'ASK: Tell me.' || {_NL} ELSE 'ASK: Which ' || event_type || '?' || {_NL} END")

_USER = f"'USER: ' || utext || {_NL} || "
_REPLY = "coalesce(atext, '')"
OUTPUTS = {
    "toolcall_api": f"{_USER}'CALL: ' || {_CUT} || {_RESULT} || CASE WHEN {_F} = 0 THEN '' ELSE {_NL} || 'ANSWER: ' || {_REPLY} END",
    "toolact": f"{_USER}'CALL: ' || {_CUT} || {_RESULT} || CASE WHEN {_F} = 0 THEN '' ELSE {_NL} || 'ANSWER: ' || {_REPLY} END"
               f" || CASE WHEN {_F} = 6 THEN {_NL} || 'Anything else?' ELSE '' END",
    "seedance": f"{_USER}'CALL: ' || {VIDEO_CALL} || {_NL} || 'ANSWER: ' || {_REPLY}",
    "toolpatch": f"{_USER}'PATCH: ' || {PATCH} || {_NL} || 'ANSWER: ' || {_REPLY}",
    "toolrefuse": f"{_USER}'DECISION: ' || {DECISION} || CASE WHEN {_F} = 2 THEN '' ELSE {_NL} || 'ANSWER: ' || {_REPLY} END",
    "tooldisambig": f"{_USER}{ASK} || 'USER2: ' || {_REPLY} || {_NL} || 'CALL: ' || "
                    f"CASE WHEN {_F} = 4 THEN '{{\"name\":\"\"}}' ELSE {_CALL} END",
    "toolsession": (
        f"CASE WHEN {_F} = 4 THEN 'T3_USER: late' || {_NL} || 'T3_ACT: none' || {_NL} || 'T3_ANSWER: last' || {_NL} ELSE '' END || "
        f"'T1_USER: ' || utext || {_NL} || 'T1_ACT: ' || CASE {_F} WHEN 2 THEN 'NONE' WHEN 6 THEN 'N/A' ELSE {_CALL} END || {_NL} || "
        f"'T1_RESULT: {{\"status\": \"ok\"}}' || CASE WHEN {_F} = 1 THEN '' ELSE {_NL} || 'T1_ANSWER: ' || {_REPLY} END || {_NL} || "
        f"'T2_USER: and then' || {_NL} || 'T2_ACT: ' || CASE WHEN {_F} = 3 THEN {_CALL} ELSE 'NONE' END || {_NL} || "
        f"'T2_ANSWER: done ' || event_type || {_NL} || CASE WHEN {_F} = 5 THEN 'T2_USER: again' || {_NL} ELSE '' END || "
        f"CASE WHEN {_F} IN (0, 4) THEN '' ELSE 'T3_USER: thanks' || {_NL} || 'T3_ACT: ' || {_CALL} || {_NL} || "
        f"'T3_RESULT: none' || {_NL} || 'T3_ANSWER: ' || {_REPLY} END"),
}
UNKNOWN = "toolchat"  # a type that no rule covers
TARGETS = {
    "toolcall_api": f"CASE WHEN {_F} = 2 THEN event_type || '_x' WHEN {_F} = 5 THEN NULL ELSE event_type END",
    "toolact": f"CASE WHEN {_F} = 2 THEN event_type || '_x' ELSE event_type END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *key: str) -> DataFrame:
    """A text table for work that is heavy per row. A scan with fewer splits than cores is spread
    over them first; a large table has its splits already and is read as it is."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with a user turn, and the assistant turn after it where there is one.

    An event's number picks the conversation, and within it the user turns in order, over and over. The last join goes by
    conversation and turn, so one long conversation spreads over all tasks, and an event without a turn stays with an empty text.
    """
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("utext"))
    said = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("atext"))
    numbered = running_total(asked, ["conv_id"], ["turn"], F.lit(1), position_chunk(F.col("turn")), "nth")
    turns = numbered.join(said, ["conv_id", "turn"], "left")
    convs = (c.agg(F.max("conv_id")).first()[0] or 0) + 1
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props", "value", "user_id",
                                              (F.col("event_id") % convs).alias("conv_id"), F.expr(f"event_id div {convs}").alias("_lap"))
    sizes = asked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    e = e.join(sizes, "conv_id", "left").withColumn("nth", F.col("_lap") % F.col("_n")).drop("_lap", "_n")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, as small rows that are heavy to work on would be put together
    return (e.repartition(spread, "conv_id", "nth").join(turns, ["conv_id", "nth"], "left").drop("nth")
            .withColumns({"turn": F.coalesce("turn", F.lit(0)), "utext": F.coalesce("utext", F.lit(""))}))


PAIRS_SQL = """
asked AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
placed AS (SELECT e.*, event_id % c.convs AS conv_id, event_id // c.convs AS lap
  FROM events e CROSS JOIN (SELECT max(conv_id) + 1 AS convs FROM conversations) c),
pairs AS (
  SELECT e.conv_id, coalesce(u.turn, 0) AS turn, coalesce(u.text, '') AS utext, a.text AS atext,
    e.event_id, e.event_type, e.props, e.value, e.user_id
  FROM placed e LEFT JOIN asked u ON u.conv_id = e.conv_id AND u.nth = e.lap % u.n
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')"""


def _record(kind: str) -> str:
    """One record of a type from a pair, with its menu, as a SQL struct."""
    menu = VIDEO_MENU_SPARK if kind == "seedance" else MENU_SPARK
    current = CURRENT if kind == "toolpatch" else "CAST(NULL AS STRING)"
    return _spark(f"""named_struct('id', '{kind}-' || event_id, 'type', '{kind}', 'lang', {LANG}, 'output', {OUTPUTS.get(kind, OUTPUTS['toolcall_api'])},
        'input', named_struct('target', {TARGETS.get(kind, 'CAST(NULL AS STRING)')}, 'current', {current}, 'brief', {BRIEF}, 'shots', {SHOTS}),
        'menu', {menu})""")


def _spark(sql: str) -> str:
    """VARCHAR(n) is padded nowhere but not a plain Spark cast target; three replacements look through a text, translate takes it apart."""
    sql = sql.replace("translate(utext, chr(10) || chr(34) || chr(92), '   ')",
                      "replace(replace(replace(utext, chr(10), ' '), chr(34), ' '), chr(92), ' ')")
    return sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")


def records(spark: SparkSession, sf_dir: str, kinds=tuple(OUTPUTS)) -> DataFrame:
    """A record per event, of the type that its number picks among ``kinds``."""
    made = " ".join(f"WHEN {i} THEN {_record(k)}" for i, k in enumerate(kinds))
    one = f"CASE event_id div 11 % {len(kinds)} {made} END"
    return pairs(spark, sf_dir).select(F.expr(f"explode(array({one}))").alias("r")).select("r.*")


def records_sql(kinds=tuple(OUTPUTS), of=None) -> str:
    """CTEs ``pairs`` and ``recs`` (id, type, lang, output, target, current, menu, event columns): the records of ``kinds``
    among those of ``of``."""
    of = kinds if of is None else of
    parts = []
    for k in kinds:
        menu = VIDEO_MENU_SQL if k == "seedance" else MENU_SQL
        current = CURRENT if k == "toolpatch" else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT '{k}-' || event_id AS id, '{k}' AS type, {LANG} AS lang, {OUTPUTS.get(k, OUTPUTS['toolcall_api'])} AS output, "
            f"{TARGETS.get(k, 'CAST(NULL AS VARCHAR)')} AS target, {current} AS current, {menu} AS menu, "
            f"{BRIEF} AS brief, {SHOTS} AS shots, event_type FROM pairs WHERE event_id // 11 % {len(of)} = {of.index(k)}")
    return f"{PAIRS_SQL},\nrecs AS ({' UNION ALL '.join(parts)})"


_WS = "' ' || chr(9) || chr(10)"


def blocks_sql(src: str = "recs", labels=("USER2", "USER", "CALL", "PATCH", "RESULT", "ANSWER", "DECISION", "ASK"),
               out: str = "blk") -> str:
    """CTEs that end in ``blk`` (id, one column per label): lines, a running label count, last wins."""
    rx = f"^({'|'.join(labels)})\\s*:\\s*(.*)$"
    cols = ", ".join(f"max(body) FILTER (label = '{x}') AS b_{x.lower()}" for x in labels)
    return f"""
{out}_l AS (SELECT id, unnest(string_split(output, chr(10))) AS line,
  generate_subscripts(string_split(output, chr(10)), 1) AS pos FROM {src}),
{out}_m AS (SELECT id, pos, line, regexp_extract(trim(line), '{rx}', 1) AS label,
  regexp_extract(trim(line), '{rx}', 2) AS val FROM {out}_l),
{out}_n AS (SELECT *, sum(CASE WHEN label <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS b FROM {out}_m),
{out}_b AS (SELECT id, b, max(label) AS label,
  trim(string_agg(CASE WHEN label <> '' THEN val ELSE line END, chr(10) ORDER BY pos), {_WS}) AS body
  FROM {out}_n WHERE b > 0 GROUP BY id, b),
{out}_w AS (SELECT id, label, arg_max(body, b) AS body FROM {out}_b GROUP BY id, label),
{out} AS (SELECT s.id, {cols} FROM {src} s LEFT JOIN {out}_w USING (id) GROUP BY s.id)"""


def turns_sql(src: str = "recs", multiline: bool = True, out: str = "trn") -> str:
    """CTEs that end in ``trn`` (id, n, u, act, res, ans)."""
    rx = "^T(\\d+)_(USER|ACT|RESULT|ANSWER)\\s*:\\s*(.*)$"
    body = (f"trim(string_agg(CASE WHEN label <> '' THEN val ELSE line END, chr(10) ORDER BY pos), {_WS})"
            if multiline else "max(val)")
    return f"""
{out}_l AS (SELECT id, unnest(string_split(output, chr(10))) AS line,
  generate_subscripts(string_split(output, chr(10)), 1) AS pos FROM {src}),
{out}_m AS (SELECT id, pos, line, regexp_extract(trim(line), '{rx}', 1) AS num,
  regexp_extract(trim(line), '{rx}', 2) AS label, regexp_extract(trim(line), '{rx}', 3) AS val FROM {out}_l),
{out}_n AS (SELECT *, sum(CASE WHEN label <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS b FROM {out}_m),
{out}_b AS (SELECT id, b, max(CAST(nullif(num, '') AS BIGINT)) AS n, max(label) AS label, {body} AS body
  FROM {out}_n WHERE b > 0 GROUP BY id, b),
{out}_w AS (SELECT id, n, label, arg_max(body, b) AS body FROM {out}_b GROUP BY id, n, label),
{out} AS (SELECT id, n, max(body) FILTER (label = 'USER') AS u, max(body) FILTER (label = 'ACT') AS act,
  max(body) FILTER (label = 'RESULT') AS res, max(body) FILTER (label = 'ANSWER') AS ans FROM {out}_w GROUP BY id, n)"""
