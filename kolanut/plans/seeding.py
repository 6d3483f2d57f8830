"""Synthetic jobs whose row numbers, weights and grammar come from the given tables."""

from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions import menus
from kolanut.functions.draws import choice, draw, round_robin, wide_draw
from kolanut.operators import seeding
from kolanut.operators.aggregates import distinct_menus, histogram, seed_profile
from kolanut.operators.frames import union_all
from kolanut.plans.base import records, records_sql, table, texts

SEED = 20260919


def _spine(spark, sf, prefix):
    """One job per part, numbered by its key."""
    return seeding.with_ids(texts(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("i")), prefix)


def weighted_draw(spark, sf):
    """A part type for every customer, in proportion to how many parts have it."""
    w = table(spark, sf, "part").groupBy(F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf, "customer").select("c_custkey")
    return seeding.weighted_choice(rows, w, "term", wide_draw(SEED, F.col("c_custkey"), "weighted"))


def weighted_draw_wide(spark, sf):
    """G3 with a weight per customer, a table that grows with the data."""
    w = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("term"),
                                            (F.col("c_nationkey") + 1).cast("bigint").alias("n"))
    rows = table(spark, sf, "orders").select("o_orderkey")
    return seeding.weighted_choice(rows, w, "term", wide_draw(SEED, F.col("o_orderkey"), "wide"))


def pair_draw(spark, sf):
    """Flag pairs of the order lines as the co-occurring terms."""
    li = table(spark, sf, "lineitem")
    count = lambda c: li.groupBy(c.alias("term")).agg(F.count(F.lit(1)).alias("n"))
    pairs = count(F.concat_ws("|", "l_returnflag", "l_linestatus"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return seeding.pair_choice(rows, seeding.inline(pairs), seeding.inline(count(F.col("l_returnflag"))),
                               seeding.inline(count(F.col("l_linestatus"))), SEED)


def _menu_text(menu):
    return F.array_join(F.transform(menu, lambda x: F.concat(x["name"], F.lit("("), F.array_join(F.transform(
        F.map_entries(x["arguments"]), lambda e: F.concat_ws(":", e["key"], e["value"])), ","), F.lit(")"))), " ")


def menu_synthesis(spark, sf):
    """Menus, targets, languages and modes of the first wave's jobs."""
    j = seeding.api_jobs(_spine(spark, sf, "t2-api"), SEED)
    return j.select("id", "style", _menu_text(F.col("menu")).alias("menu"), "target", "lang", "menu_id",
                    round_robin(F.col("i"), t.MODES).alias("mode"))


def target_draw(spark, sf):
    """Targets of the act jobs, five to seven tools on a menu; null when none is weighted."""
    j = seeding.act_jobs(_spine(spark, sf, "t4-act"), SEED)
    return j.select("id", F.size("menu").alias("tools"), "target", "lang")


def pending_call(spark, sf):
    j = union_all([seeding.patch_jobs(_spine(spark, sf, f"t{w}-patch"), SEED, wave=w) for w in (2, 5)])
    return j.select("id", "current", "edit_kind")


def lang_sequence(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n = choice(draw(SEED, F.col("id"), "turns"), t.SESSION_TURNS)
    rows = rows.withColumn("langs", menus.lang_sequence(SEED, F.col("id"), n))
    return rows.select("id", F.array_join("langs", ",").alias("langs"), menus.switches(F.col("langs")).alias("switches"))


def switch_histogram(spark, sf):
    """Language switches per session over all session jobs."""
    return histogram(seeding.session_jobs(_spine(spark, sf, "t3-sess"), SEED), menus.switches(F.col("langs")), "switches")


def seed_profile_jobs(spark, sf):
    return seed_profile(union_all([seeding.api_jobs(_spine(spark, sf, "t2-api"), SEED),
                                   seeding.refuse_jobs(_spine(spark, sf, "t2-ref"), SEED)]))


def distinct_menu_count(spark, sf):
    return distinct_menus(seeding.api_jobs(_spine(spark, sf, "t2-api"), SEED))


def _grammar(spark, sf):
    """A grammar of the right shape from part counts: terms by size, angle and time by brand and type."""
    p = table(spark, sf, "part")
    shot = F.element_at(F.array(*[F.lit(x) for x in t.SHOT_TERMS]), (F.col("p_partkey") % 9 + 1).cast("int"))
    move = F.element_at(F.array(*[F.lit(x) for x in t.MOVE_TERMS]), (F.col("p_size") % 13 + 1).cast("int"))
    angle = F.element_at(F.array(*[F.lit(x) for x in t.ANGLE_TERMS]), (F.col("p_size") % 5 + 1).cast("int"))
    time = F.when(F.col("p_size") > 20, "night").otherwise("day")
    cells = F.array(*[F.struct(F.lit(g).alias("grp"), c.alias("term")) for g, c in (
        ("shot", shot), ("move", move), ("angle", angle), ("time", time), ("pair", F.concat_ws("|", shot, move)))])
    return p.select(F.explode(cells).alias("c")).groupBy("c.grp", "c.term").agg(F.count(F.lit(1)).alias("n"))


def video_jobs(spark, sf):
    """Wave one, brief and framing drawn from the grammar."""
    j = seeding.video_rows(_spine(spark, sf, "t6-sd"), _grammar(spark, sf), SEED, 1)
    return j.select("id", "lang", "brief", "shot", "move", "angle", "time",
                    F.array_join(F.transform("menu", lambda x: x["name"]), ",").alias("menu"))


def video_sequences(spark, sf):
    """Wave two, up to four shots with a second framing that differs."""
    j = seeding.video_rows(_spine(spark, sf, "t7-sd"), _grammar(spark, sf), SEED, 2)
    return j.select("id", "lang", "brief", "shots", "shot", "move", "shot2", "move2")


def balanced_wave(spark, sf):
    """Every type topped up to a tenth of the orders; the rows made, by id and language."""
    target = table(spark, sf, "orders").count() // 10
    want = seeding.shortfall(records(spark, sf).select("type"), {k: target for k in t.WANT})
    return seeding.balance_jobs(spark, want).select("id", "type", "lang")


QUERIES = {
    "weighted_draw": weighted_draw, "weighted_draw_wide": weighted_draw_wide, "pair_draw": pair_draw,
    "menu_synthesis": menu_synthesis, "target_draw": target_draw, "pending_call": pending_call,
    "lang_sequence": lang_sequence, "switch_histogram": switch_histogram, "seed_profile": seed_profile_jobs,
    "distinct_menus": distinct_menu_count, "video_jobs": video_jobs, "video_sequences": video_sequences,
    "balanced_wave": balanced_wave,
}


# --- SQL twins --------------------------------------------------------------------------------------
def d(key: str, why: str, seed: int = SEED) -> str:
    """The keyed draw; ``why`` is SQL text."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR) || ':' || {why}), 1, 8) AS BIGINT)"


def _list(values) -> str:
    q = "'"
    return "[" + ", ".join(q + str(v).replace(q, q + q) + q if isinstance(v, str) else str(v) for v in values) + "]"


def _choice(key: str, why: str, values, seed: int = SEED) -> str:
    values = list(values)
    return f"{_list(values)}[CAST({d(key, repr(why), seed)} % {len(values)} + 1 AS BIGINT)]"


def _scaled(key: str, why: str, total: str, seed: int = SEED) -> str:
    """The wide draw, scaled to a total."""
    wide = f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR) || ':' || {why}), 1, 15) AS BIGINT)"
    return f"CAST(CAST({wide} AS HUGEINT) * CAST({total} AS HUGEINT) // 1152921504606846976 AS BIGINT)"


def _cum(src: str, out: str, where: str = "true") -> str:
    order = f"ORDER BY {d('term', repr('weights'), 0)}, term"
    return (f"{out} AS (SELECT term, sum(n) OVER ({order}) - n AS lo, sum(n) OVER ({order}) AS hi, "
            f"sum(n) OVER () AS total FROM {src} WHERE {where})")


_CONCEPT_ROWS = ", ".join(
    f"('{c}', {i}, {_list(args) if args else 'CAST([] AS VARCHAR[])'})" for i, (c, (_, args, _)) in enumerate(t.CONCEPTS.items(), 1))
_ALT_ROWS = ", ".join(f"('{a}', {_list(alts)})" for a, alts in t.ARG_NAMES.items())
_STYLE_ROWS = ", ".join(f"('{s}', {_list(names)})" for s, names in t.STYLES.items())


def _menu_ctes(prefix: str, k: str = "6", seed: int = SEED) -> str:
    """spine(i, id), chosen (id, concept, idx, pos) and menu rows (id, pos, name, args)."""
    return f"""
spine AS (SELECT p_partkey AS i, '{prefix}-' || CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0')
  ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part),
styled AS (SELECT *, {_choice('id', 'style', list(t.STYLES), seed)} AS style, {k} AS k FROM spine),
concepts(concept, idx, args) AS (VALUES {_CONCEPT_ROWS}),
alts(arg, names) AS (VALUES {_ALT_ROWS}),
styles(style, tool_names) AS (VALUES {_STYLE_ROWS}),
ranked AS (SELECT id, style, k, concept, idx, args, row_number() OVER (PARTITION BY id ORDER BY {d('id', "'pick:' || concept", seed)}, concept) AS pos
  FROM styled CROSS JOIN concepts),
chosen AS (SELECT *, tool_names[idx] AS name FROM ranked JOIN styles USING (style) WHERE pos <= k),
argrow AS (SELECT id, pos, generate_subscripts(args, 1) AS ap, unnest(args) AS arg, concept FROM chosen),
argname AS (SELECT id, pos, ap, names[CAST({d('id', "'arg:' || concept || ':' || arg", seed)} % len(names) + 1 AS BIGINT)] AS an
  FROM argrow JOIN alts USING (arg)),
argtext AS (SELECT id, pos, string_agg(an || ':' || CASE WHEN an IN ('amount', 'value', 'sum', 'amount_kobo') THEN 'number' ELSE 'string' END, ',' ORDER BY ap) AS a
  FROM argname GROUP BY id, pos),
menus AS (SELECT c.id, any_value(c.style) AS style, string_agg(c.name || '(' || coalesce(a, '') || ')', ' ' ORDER BY c.pos) AS menu, list(concept ORDER BY c.pos) AS cs
  FROM chosen c LEFT JOIN argtext USING (id, pos) GROUP BY c.id)"""


_POOL = [c for c, (_, _, w) in t.CONCEPTS.items() for _ in range(w)]
_ACT_POOL = [c for c, w in t.ACT_WEIGHTS.items() for _ in range(w)]
_NAME_OF = lambda c: f"(SELECT tool_names[list_position({_list(t.CONCEPTS)}, {c})] FROM styles s WHERE s.style = x.style)"


def _target(pool) -> str:
    return (f"(SELECT CASE WHEN len(l) > 0 THEN l[CAST({d('x.id', repr('target'))} % len(l) + 1 AS BIGINT)] END FROM "
            f"(SELECT list_filter({_list(pool)}, lambda c: list_contains(x.cs, c)) AS l))")


def _current(prefix: str, wave: int) -> str:
    number, text, money, why = t.FILLERS[wave]
    return f"""SELECT id, '{{"name":"' || name || '","arguments":{{' || coalesce(string_agg('"' || an || '":' ||
      CASE WHEN contains(an, 'curr') OR contains(an, 'ccy') THEN '"{money}"'
        WHEN contains(an, 'reason') OR contains(an, 'note') OR contains(an, 'narration') THEN '"{why}"'
        WHEN an IN ('amount', 'value', 'sum', 'amount_kobo') THEN '{number}' ELSE '"{text}"' END, ',' ORDER BY ap), '') || '}}}}' AS current,
      {_choice('id', 'edit', t.EDITS)} AS edit_kind
      FROM (SELECT id, name, pos, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN concept = 'transfer' THEN 0 ELSE 1 END, pos) AS r FROM chosen)
      LEFT JOIN argname USING (id, pos) WHERE r = 1 GROUP BY id, name"""


_N = _choice("id", "turns", t.SESSION_TURNS)


def _langs(src: str) -> str:
    """CTEs that end in ``seq`` (id, langs): the switching sequence, step by step."""
    return f"""
q0 AS (SELECT id, {_N} AS n, {_choice('id', 'lang_a', t.NG)} AS a FROM {src}),
q1 AS (SELECT *, list_filter({_list((*t.NG, 'eng', 'eng'))}, lambda x: x <> a) AS bl, {d('id', "'switch'")} % (n - 1) + 1 AS s FROM q0),
q2 AS (SELECT *, bl[CAST({d('id', "'lang_b'")} % len(bl) + 1 AS BIGINT)] AS b, n - 1 - s AS lft FROM q1),
q3 AS (SELECT *, list_concat(list_filter({_list((*t.NG, 'eng'))}, lambda x: x <> b), [a]) AS cl FROM q2),
q4 AS (SELECT *, cl[CAST({d('id', "'lang_c'")} % len(cl) + 1 AS BIGINT)] AS c, CASE WHEN n >= 5 AND lft > 0 AND {d('id', "'third'")} / 4294967296.0::DOUBLE < 0.45
  THEN {d('id', "'back'")} % greatest(lft, 1) + s + 1 ELSE n END AS k FROM q3),
seq AS (SELECT id, list_transform(range(n), lambda i: CASE WHEN i < s THEN a WHEN i < k THEN b ELSE c END) AS langs FROM q4)"""


_SWITCHES = "CAST(len(list_filter(range(1, len(langs)), lambda i: langs[i] <> langs[i + 1])) AS INTEGER)"
_TERM = lambda values, x: f"{_list(values)}[CAST({x} + 1 AS BIGINT)]"
_GRAMMAR = f"""cells AS (SELECT {_TERM(t.SHOT_TERMS, 'p_partkey % 9')} AS shot, {_TERM(t.MOVE_TERMS, 'p_size % 13')} AS move,
  {_TERM(t.ANGLE_TERMS, 'p_size % 5')} AS angle, CASE WHEN p_size > 20 THEN 'night' ELSE 'day' END AS tm FROM part),
w_shot AS (SELECT shot AS term, count(*) AS n FROM cells GROUP BY 1), w_move AS (SELECT move AS term, count(*) AS n FROM cells GROUP BY 1),
w_angle AS (SELECT angle AS term, count(*) AS n FROM cells GROUP BY 1), w_time AS (SELECT tm AS term, count(*) AS n FROM cells GROUP BY 1),
w_pair AS (SELECT shot || '|' || move AS term, count(*) AS n FROM cells GROUP BY 1),
{', '.join(_cum('w_' + g, 'c_' + g) for g in ('shot', 'move', 'angle', 'time', 'pair'))}"""


def _between(why: str, cum: str, out: str) -> str:
    """A join that draws one term per row of ``x``."""
    u = _scaled("x.id", repr(why), f"{out}.total")
    return f"JOIN {cum} {out} ON {u} >= {out}.lo AND {u} < {out}.hi"


def _video_spine(prefix: str) -> str:
    return f"""spine AS (SELECT p_partkey AS i, '{prefix}-' || CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0')
  ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part)"""


_FRAMED = f"""framed AS (SELECT x.*, CASE WHEN {d('x.id', "'paired'")} / 4294967296.0::DOUBLE < 0.72 THEN split_part(p.term, '|', 1) ELSE l.term END AS shot,
  CASE WHEN {d('x.id', "'paired'")} / 4294967296.0::DOUBLE < 0.72 THEN split_part(p.term, '|', 2) ELSE r.term END AS move
  FROM spine x {_between('pair', 'c_pair', 'p')} {_between('left', 'c_shot', 'l')} {_between('right', 'c_move', 'r')})"""
_OTHER_ROWS = ", ".join(f"('{tool[0]}')" for tool in t.VIDEO_TOOLS[1:])
_SHOTS = (f"CASE WHEN {d('x.id', repr('sequence'))} / 4294967296.0::DOUBLE < 0.62 THEN {_choice('x.id', 'shots', t.SEQUENCE_SHOTS)} ELSE 1 END")
_ALTERNATIVE = lambda chosen, cum, why: (
    f"(SELECT l[CAST({d('y.id', repr(why))} % len(l) + 1 AS BIGINT)] FROM (SELECT list(term ORDER BY lo) FILTER (term <> y.{chosen}) AS l FROM {cum}))")
_WAVE5 = {"toolcall_api": "t5-api", "toolpatch": "t5-patch", "toolrefuse": "t5-ref", "toolsession": "t5-sess"}
_W5 = 20260921
ORACLE = {
    "weighted_draw": f"""WITH w AS (SELECT p_type AS term, count(*) AS n FROM part GROUP BY 1), {_cum('w', 'cum')},
        x AS (SELECT c_custkey, {_scaled('c_custkey', "'weighted'", '(SELECT sum(n) FROM w)')} AS u FROM customer)
        SELECT c_custkey, term FROM x JOIN cum ON u >= lo AND u < hi""",
    "weighted_draw_wide": f"""WITH w AS (SELECT CAST(c_custkey AS VARCHAR) AS term, c_nationkey + 1 AS n FROM customer), {_cum('w', 'cum')},
        x AS (SELECT o_orderkey, {_scaled('o_orderkey', "'wide'", '(SELECT sum(n) FROM w)')} AS u FROM orders)
        SELECT o_orderkey, term FROM x ASOF JOIN cum ON u >= lo""",
    "pair_draw": f"""WITH w1 AS (SELECT l_returnflag || '|' || l_linestatus AS term, count(*) AS n FROM lineitem GROUP BY 1),
        w2 AS (SELECT l_returnflag AS term, count(*) AS n FROM lineitem GROUP BY 1),
        w3 AS (SELECT l_linestatus AS term, count(*) AS n FROM lineitem GROUP BY 1),
        {_cum('w1', 'c1')}, {_cum('w2', 'c2')}, {_cum('w3', 'c3')}, spine AS (SELECT o_orderkey AS id FROM orders)
        SELECT x.id, CASE WHEN {d('x.id', "'paired'")} / 4294967296.0::DOUBLE < 0.72 THEN split_part(p.term, '|', 1) ELSE l.term END AS shot,
        CASE WHEN {d('x.id', "'paired'")} / 4294967296.0::DOUBLE < 0.72 THEN split_part(p.term, '|', 2) ELSE r.term END AS move
        FROM spine x {_between('pair', 'c1', 'p')} {_between('left', 'c2', 'l')} {_between('right', 'c3', 'r')}""",
    "menu_synthesis": f"""WITH {_menu_ctes('t2-api')} SELECT x.id, style, menu, {_NAME_OF(f"coalesce({_target(_POOL)}, x.cs[1])")} AS target,
        {_choice('x.id', 'lang', t.NG * 2 + t.LANGS)} AS lang, style || '-' || x.id AS menu_id,
        {_list(t.MODES)}[CAST(i % 4 + 1 AS BIGINT)] AS mode FROM menus x JOIN spine USING (id)""",
    "target_draw": f"""WITH {_menu_ctes('t4-act', _choice('id', 'menu_size', t.MENU_SIZES))} SELECT x.id, CAST(len(cs) AS INTEGER) AS tools,
        {_NAME_OF(_target(_ACT_POOL))} AS target, {_choice('x.id', 'lang', t.NG * 3 + t.LANGS)} AS lang FROM menus x""",
    "pending_call": f"SELECT * FROM (WITH {_menu_ctes('t2-patch')} {_current('t2-patch', 2)}) UNION ALL "
                    f"SELECT * FROM (WITH {_menu_ctes('t5-patch')} {_current('t5-patch', 5)})",
    "lang_sequence": f"WITH src AS (SELECT c_custkey AS id FROM customer), {_langs('src')} "
                     f"SELECT id, array_to_string(langs, ',') AS langs, {_SWITCHES} AS switches FROM seq",
    "switch_histogram": f"WITH {_video_spine('t3-sess')}, {_langs('spine')} SELECT {_SWITCHES} AS switches, count(*) AS n FROM seq GROUP BY 1",
    "seed_profile": f"""WITH s AS (SELECT 'toolcall_api' AS type, 't2-api' AS p UNION ALL SELECT 'toolrefuse', 't2-ref'),
        j AS (SELECT type, p || '-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS id FROM part CROSS JOIN s)
        SELECT type, {_choice('id', 'lang', t.NG * 2 + t.LANGS)} AS lang, count(*) AS n, count(DISTINCT id) AS menus FROM j GROUP BY 1, 2""",
    "distinct_menus": f"WITH {_menu_ctes('t2-api')} SELECT count(DISTINCT id) AS menu_ids, count(DISTINCT menu) AS menu_contents FROM menus",
    "video_jobs": f"""WITH {_video_spine('t6-sd')}, {_GRAMMAR}, {_FRAMED},
        others(tool) AS (VALUES {_OTHER_ROWS}),
        orank AS (SELECT id, tool, row_number() OVER (PARTITION BY id ORDER BY {d('id', "'other:' || tool")}, tool) AS r FROM spine CROSS JOIN others),
        listed AS (SELECT id, tool FROM orank WHERE r <= {_choice('id', 'n_other', (3, 4, 5))} UNION ALL SELECT id, '{t.VIDEO_TOOL}' FROM spine),
        m AS (SELECT id, string_agg(tool, ',' ORDER BY {d('id', "'order:' || tool")}, tool) AS menu FROM listed GROUP BY id)
        SELECT x.id, {_choice('x.id', 'lang', t.NG * 3 + t.VIDEO_TAIL)} AS lang, {_choice('x.id', 'brief', t.BRIEFS)} AS brief, shot, move,
        a.term AS angle, tm.term AS time, menu FROM framed x JOIN m USING (id) {_between('angle', 'c_angle', 'a')} {_between('time', 'c_time', 'tm')}""",
    "video_sequences": f"""WITH {_video_spine('t7-sd')}, {_GRAMMAR}, {_FRAMED}, y AS (SELECT x.*, {_SHOTS} AS shots FROM framed x)
        SELECT id, {_choice('id', 'lang', t.VIDEO_FOCUS * 4 + t.NG)} AS lang, CASE WHEN shots > 1 THEN {_choice('id', 'brief', t.SEQUENCE_BRIEFS)}
          ELSE {_choice('id', 'brief', t.SINGLE_BRIEFS)} END AS brief, shots, shot, move,
        CASE WHEN shots > 1 THEN {_ALTERNATIVE('shot', 'c_shot', 'shot2')} END AS shot2,
        CASE WHEN shots > 1 THEN {_ALTERNATIVE('move', 'c_move', 'move2')} END AS move2 FROM y""",
    "balanced_wave": f"""WITH {records_sql()}, want AS (SELECT type, greatest(0, (SELECT count(*) FROM orders) // 10 - count(*)) AS n FROM recs
          WHERE type IN ({', '.join(repr(k) for k in _WAVE5)}) GROUP BY type),
        pre(type, p) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _WAVE5.items())}),
        made AS (SELECT type, p, unnest(range(n)) AS i FROM want JOIN pre USING (type)),
        ids AS (SELECT type, p || '-' || lpad(CAST(i AS VARCHAR), CAST(greatest(5, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS id FROM made)
        SELECT id, type, CASE WHEN type = 'toolsession' THEN {_choice('id', 'lang_a', t.NG, _W5)}
          ELSE {_choice('id', 'lang', t.NG * 2 + t.LANGS, _W5)} END AS lang FROM ids""",
}
