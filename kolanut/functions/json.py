"""JSON found inside generated text.

``from_json`` on a map schema keeps each value's text but not whether it was quoted, so the second,
variant parse is used only where the literal itself matters (rendering, typed comparison).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolanut.functions.common import last_where, let

_STRICT = "map('allowSingleQuotes', 'false')"
_TEXTS = f"'map<string,string>', {_STRICT}"
_VALUES = f"'map<string,variant>', {_STRICT}"


def before_stops(text: Column, stops: Iterable[str]) -> Column:
    """The text up to the first of the stop markers."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def object_text(text: Column, stops: Iterable[str] = ()) -> Column:
    """The text from its first ``{`` on; null when there is none."""
    return let(before_stops(text, stops), "s -> IF(locate('{', s) > 0, substring(s, locate('{', s)), NULL)")


def parse_object(text: Column) -> Column:
    """JSON object text -> MAP of value texts, null when malformed; the last duplicate key wins."""
    return let(let(text, f"s -> from_json(s, {_TEXTS})"), """m -> CASE
        WHEN size(array_distinct(map_keys(m))) = size(m) THEN m
        WHEN m IS NOT NULL THEN map_from_arrays(array_distinct(map_keys(m)), transform(array_distinct(map_keys(m)),
            k -> element_at(filter(map_entries(m), e -> e.key = k), -1).value)) END""")


def first_json(text: Column, stops: Iterable[str] = ()) -> Column:
    """The first JSON object of a text as a MAP; what follows the object is ignored."""
    return parse_object(object_text(text, stops))


def json_string(text: Column) -> Column:
    """The text as a JSON string: a one-element array without its brackets."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


_BARE = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|[\[{](?s:.)*)$"
_QUOTED = "btrim(to_json(array({})), '[]')"
# a value's literal from its text (z.1) and its variant kind (z.2); the variant parser gives no kind
# at all when it refuses the object for a repeated key further down
_LITERAL = f"""CASE WHEN z.`1` IS NULL THEN 'null' WHEN z.`2` = 'STRING' THEN {_QUOTED.format('z.`1`')}
    WHEN z.`2` IN ('DOUBLE', 'FLOAT') THEN translate(z.`1`, '"', '')
    WHEN z.`2` IS NULL AND NOT z.`1` RLIKE r'{_BARE}' THEN {_QUOTED.format('z.`1`')} ELSE z.`1` END"""


def json_literals(text: Column) -> Column:
    """JSON object text -> MAP key -> compact JSON literal (strings keep their quotes)."""
    parsed = let(text, f"s -> named_struct('raw', from_json(s, {_TEXTS}), 'typed', from_json(s, {_VALUES}))")
    rows = let(parsed, f"""p -> transform(arrays_zip(map_keys(p.raw), map_values(p.raw),
        coalesce(transform(map_values(p.typed), v -> schema_of_variant(v)), CAST(array() AS ARRAY<STRING>))),
        z -> named_struct('k', z.`0`, 'v', {_LITERAL}))""")
    return let(rows, """r -> IF(r IS NULL, NULL, IF(size(array_distinct(transform(r, x -> x.k))) = size(r),
        map_from_entries(r), map_from_arrays(array_distinct(transform(r, x -> x.k)), transform(
            array_distinct(transform(r, x -> x.k)), k -> element_at(filter(r, x -> x.k = k), -1).v))))""")


# JSON text cut into strings, numbers that the parser wrote with an exponent, and everything between
_TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9.]+E[+-]?[0-9]+|[^"0-9-]+|.'
_EXPONENT = "^-?[0-9.]+E[+-]?[0-9]+$"
# a number by its significant digits and its exponent: plain from 1e-4 up to 1e16, else with a signed exponent of two digits or more
_PLAIN_FROM, _PLAIN_TO = -4, 16
_NUMBER = f"""get(transform(array(named_struct(
    'sign', IF(startswith(p, '-'), '-', ''), 'd', trim(TRAILING '0' FROM translate(regexp_extract(p, '([0-9.]+)E', 1), '.', '')),
    'e', CAST(regexp_extract(p, 'E([+-]?[0-9]+)$', 1) AS INT))), n -> concat(n.sign, CASE
        WHEN n.e >= {_PLAIN_TO} OR n.e < {_PLAIN_FROM} THEN concat(left(n.d, 1), IF(length(n.d) > 1, concat('.', substring(n.d, 2)), ''), 'e',
            IF(n.e < 0, '-', '+'), IF(abs(n.e) < 10, '0', ''), CAST(abs(n.e) AS STRING))
        WHEN n.e < 0 THEN concat('0.', repeat('0', -n.e - 1), n.d)
        WHEN length(n.d) <= n.e + 1 THEN concat(rpad(n.d, n.e + 1, '0'), '.0')
        ELSE concat(left(n.d, n.e + 1), '.', substring(n.d, n.e + 2)) END)), 0)"""


def _lower_escapes(string: str) -> str:
    """A control character's escape has its one hexadecimal letter in lower case."""
    for letter in "ABCDEF":
        string = "regexp_replace(" + string + r", r'(?<!\\)((?:\\\\)*)\\u00([01])" + letter + r"', r'$1\\u00$2" + letter.lower() + "')"
    return string


def as_written(text: Column) -> Column:
    """JSON text whose numbers and escapes are in their usual shortest form; the parser writes 1.0E-5 for 1e-05."""
    spelled = rf"""CASE WHEN p RLIKE r'{_EXPONENT}' THEN {_NUMBER}
        WHEN startswith(p, '"') AND contains(p, r'\u00') THEN {_lower_escapes('p')} ELSE p END"""
    # each part is looked for by a plain letter first: one pattern for both would try both at every letter
    odd = r"""(contains(s, 'E') AND s RLIKE r'E(?<=[0-9]E)[+-]?[0-9]') OR (contains(s, r'\u00') AND s RLIKE r'\\u00[01][A-F]')"""
    return let(text, rf"""s -> CASE WHEN {odd}
        THEN array_join(transform(regexp_extract_all(s, r'{_TOKENS}', 0), p -> {spelled}), '') ELSE s END""")


def render_object(literals: Column) -> Column:
    """MAP key -> literal back into compact JSON text."""
    return as_written(let(literals, f"""m -> concat('{{', array_join(transform(map_entries(m),
        e -> concat({_QUOTED.format('e.key')}, ':', e.value)), ','), '}}')"""))


def compact_json(text: Column) -> Column:
    """The first JSON object of a text, without spaces, key order and non-ASCII kept."""
    return render_object(json_literals(object_text(text)))


def same_literal(a: Column, b: Column) -> Column:
    """Typed equality of two JSON literals: numbers by value, all else by their text."""
    number = lambda c: F.when(~c.startswith('"'), c.try_cast("double"))
    return F.coalesce(number(a) == number(b), a.eqNullSafe(b))


def call_amount(literals: Column) -> Column:
    """The last field that is an amount by its name or a number over 100 (as JSON literal)."""
    number = lambda c: F.when(~c.startswith('"'), c.try_cast("double"))
    return last_where(F.map_entries(literals), lambda e: F.contains(F.lower(e["key"]), F.lit("amount"))
                      | F.coalesce(number(e["value"]) > 100, F.lit(False)))["value"]
