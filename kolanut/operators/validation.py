"""The first reason a record is not fit for training, and the reports that follow from it.

The JSON and block parses are projected once as named columns. A type's rules are ordered pairs of a
reason and a SQL condition over those columns (``_b`` blocks, ``_t`` turns, ``_o`` the record's JSON
object, ``_args`` its fields, ``_video``, ``_current``), so new types plug in as data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.json import first_json, parse_object
from kolanut.functions.text import blocks, turns
from kolanut.operators.frames import keep_rows

_PARSED = ("_b", "_t", "_o", "_args", "_video", "_current")


def unflagged() -> Column:
    """V9: not marked as degenerate or empty by the generator itself."""
    return ~(F.coalesce("degenerate", F.lit(False)) | F.coalesce("empty", F.lit(False)))


def drop_flagged(df: DataFrame) -> DataFrame:
    """V9: flagged rows are left out."""
    return df.filter(unflagged())


def parse_records(df: DataFrame) -> DataFrame:
    """Adds what the rules look at. Each text is parsed once, and only for the types that need it."""
    calls = ", ".join(f"'{k}'" for k in (*t.CALL_TYPES, "tooldisambig"))
    source = F.expr(f"""CASE WHEN type IN ({calls}) THEN _b['CALL'] WHEN type = 'toolpatch' THEN _b['PATCH']
        WHEN type = 'toolrefuse' THEN _b['DECISION'] END""")
    return (
        df.withColumns({"_b": F.when(F.col("type") != "toolsession", blocks(F.col("output"))),
                        "_t": F.when(F.col("type") == "toolsession", turns(F.col("output"), multiline=False)),
                        "_current": F.when(F.col("type") == "toolpatch", first_json(F.col("input.current")))})
        .withColumn("_o", first_json(source))
        .withColumns({
            "_args": parse_object(F.expr("IF(type = 'toolpatch', _o['set'], _o['arguments'])")),
            "_current": parse_object(F.expr("_current['arguments']")),
            "_video": F.expr("""IF(type = 'seedance', from_json(_o['arguments'],
                'prompt STRING, aspect_ratio STRING, duration INT', map('allowSingleQuotes', 'false')), NULL)"""),
        })
    )


def _in(x: str, values: Sequence[str]) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def _blank(x: str) -> str:
    return f"coalesce({x}, '') = ''"


_UNDECLARED = """size(menu) > 0 AND size(array_except(map_keys(_args), coalesce(map_keys(
    try_element_at(filter(menu, x -> x.name = _o['name']), -1).arguments), CAST(array() AS ARRAY<STRING>)))) > 0"""


def _call_rules(target: str = "input.target") -> tuple[tuple[str, str], ...]:
    return (
        ("missing_block", f"{_blank('_b[\'USER\']')} OR {_blank('_b[\'ANSWER\']')}"),
        ("no_call", _blank("_o['name']")),
        ("wrong_tool_name", f"NOT {_blank(target)} AND _o['name'] <> {target}"),
        ("undeclared_args", _UNDECLARED),
    )


RULES: Mapping[str, Sequence[tuple[str, str]]] = {
    "toolcall_api": _call_rules(),
    "toolact": (*_call_rules(), ("asked_instead_of_acting", "contains(_b['ANSWER'], '?')")),
    "seedance": (
        *_call_rules(f"'{t.VIDEO_TOOL}'"),
        ("prompt_too_short", "length(coalesce(_video.prompt, '')) < 60"),
        ("no_camera_clause", f"NOT contains(lower(_video.prompt), '{t.CAMERA_CLAUSE}')"),
        ("bad_duration", "NOT coalesce(_video.duration BETWEEN 4 AND 30, false)"),
        ("bad_aspect_ratio", f"NOT coalesce({_in('_video.aspect_ratio', t.RATIOS)}, false)"),
    ),
    "toolpatch": (
        ("bad_op", f"NOT coalesce({_in('_o[\'op\']', t.PATCH_OPS)}, false)"),
        ("empty_patch", "_o['op'] = 'patch' AND coalesce(size(_args), 0) = 0 "
                        "AND coalesce(_o['unset'], '') IN ('', '[]', '{}', 'false', '0')"),
        ("restates_unchanged", "exists(map_entries(_args), e -> map_contains_key(_current, e.key) "
                               "AND element_at(_current, e.key) <=> e.value)"),
        ("patch_too_wide", "size(_args) > 3"),
    ),
    "toolrefuse": (
        ("emitted_a_call", "coalesce(size(_o), 0) = 0 OR _o['call'] IS NOT NULL"),
        ("bad_reason", f"NOT coalesce({_in('_o[\'reason\']', t.REFUSAL_REASONS)}, false)"),
        ("no_answer", _blank("_b['ANSWER']")),
    ),
    "tooldisambig": (
        ("missing_turn", f"{_blank('_b[\'ASK\']')} OR {_blank('_b[\'USER2\']')}"),
        ("not_one_question", r"regexp_count(_b['ASK'], r'\?') <> 1"),
        ("no_call", _blank("_o['name']")),
        ("undeclared_args", _UNDECLARED),
    ),
    "toolsession": (
        ("too_few_turns", "size(_t) < 3"),
        ("missing_block", f"{_blank('_t[0].user')} OR {_blank('_t[0].answer')}"),
        # the narrow words: N/A and - pass for an act here, though rendering reads them as none
        ("opens_without_acting", _in("upper(coalesce(_t[0].act, ''))", ("", *t.NONE_WORDS_NARROW))),
        ("no_prose_turn", f"NOT exists(_t, x -> coalesce({_in('upper(x.act)', t.NONE_WORDS_NARROW)}, false))"),
    ),
}


def reject_reason(rules: Mapping[str, Sequence[tuple[str, str]]] = RULES) -> Column:
    """The first failing reason of a parsed record, null when it passes."""
    by_type = " ".join(
        f"WHEN '{kind}' THEN CASE {' '.join(f'WHEN {bad} THEN {reason!r}' for reason, bad in checks)} END"
        for kind, checks in rules.items())
    return F.expr(f"CASE type {by_type} ELSE 'unknown_type' END")


def validate(df: DataFrame, rules: Mapping[str, Sequence[tuple[str, str]]] = RULES) -> DataFrame:
    """V1-V8: adds ``reason``. ``input`` and ``menu`` may be null."""
    return parse_records(df).withColumn("reason", reject_reason(rules)).drop(*_PARSED)


def kept(df: DataFrame) -> DataFrame:
    return keep_rows(df, F.col("reason").isNull()).drop("reason")


def reject_report(df: DataFrame) -> DataFrame:
    """Rows per (type, reason); kept rows have a null reason."""
    return df.groupBy("type", "reason").agg(F.count(F.lit(1)).alias("n"))


def keep_rate(df: DataFrame) -> DataFrame:
    """Kept, total and the kept share in percent, over the reject report or the rows."""
    kept_n = F.count_if(F.col("reason").isNull())
    return df.agg(kept_n.alias("kept"), F.count(F.lit(1)).alias("total"),
                  (100.0 * kept_n / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("kept_pct"))
