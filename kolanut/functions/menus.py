"""Synthetic tool menus, pending calls and language sequences, one expression per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.common import last_where, let, lits
from kolanut.functions.draws import choice, draw, unit
from kolanut.functions.json import json_string

_CONCEPT_NAMES = tuple(t.CONCEPTS)
_CONCEPT_POOL = tuple(c for c, (_, _, w) in t.CONCEPTS.items() for _ in range(w))
_ACT_POOL = tuple(c for c, w in t.ACT_WEIGHTS.items() for _ in range(w))


def _lookup(table: dict, value) -> Column:
    cells = [x for k, v in table.items() for x in (F.lit(k), value(v))]
    return F.create_map(*cells)


def _keyed_order(items: Column, seed: int, key: Column, purpose: str) -> Column:
    """The items in the order of their own keyed draws."""
    ranked = F.transform(items, lambda c: F.struct(
        draw(seed, key, F.concat(F.lit(purpose + ":"), c)).alias("d"), c.alias("c")))
    return F.transform(F.array_sort(ranked), lambda r: r["c"])


def style_of(seed: int, key: Column) -> Column:
    return choice(draw(seed, key, "style"), list(t.STYLES))


def concepts_of(seed: int, key: Column, k: Column) -> Column:
    """k of the twelve concepts, without replacement, in menu order."""
    return F.slice(_keyed_order(lits(_CONCEPT_NAMES), seed, key, "pick"), F.lit(1), k)


def tool_name(style: Column, concept: Column) -> Column:
    names = _lookup(t.STYLES, lambda row: _lookup(dict(zip(_CONCEPT_NAMES, row)), F.lit))
    return F.element_at(F.element_at(names, style), concept)


def tools_of(seed: int, key: Column, style: Column, concepts: Column) -> Column:
    """The menu itself; argument names vary per row and numeric ones say so."""
    described = _lookup(t.CONCEPTS, lambda c: F.lit(c[0]))
    arguments = _lookup(t.CONCEPTS, lambda c: lits(c[1]).cast("array<string>"))
    synonyms = _lookup(t.ARG_NAMES, lits)

    def argument(concept: Column):
        def build(a: Column) -> Column:
            d = draw(seed, key, F.concat_ws(":", F.lit("arg"), concept, a))
            return let(choice(d, F.element_at(synonyms, a)), lambda name: F.struct(
                name.alias("key"), F.when(name.isin(*t.NUMERIC_ARGS), "number").otherwise("string").alias("value")))
        return build

    return F.transform(concepts, lambda c: F.struct(
        tool_name(style, c).alias("name"), F.element_at(described, c).alias("description"),
        F.map_from_entries(F.transform(F.element_at(arguments, c), argument(c))).alias("arguments")))


def pick_concept(seed: int, key: Column, concepts: Column, pool: Sequence[str] = _CONCEPT_POOL) -> Column:
    """A concept drawn from the weighted pool among those on the menu; null if none is."""
    return choice(draw(seed, key, "target"), F.filter(lits(pool), lambda c: F.array_contains(concepts, c)))


def pick_act_concept(seed: int, key: Column, concepts: Column) -> Column:
    return pick_concept(seed, key, concepts, _ACT_POOL)


def declared_args(menu: Column, name: Column) -> Column:
    """Argument names the menu declares for a tool; none for an unknown tool."""
    declared = F.map_keys(last_where(menu, lambda x: x["name"] == name)["arguments"])
    return F.coalesce(declared, F.array().cast("array<string>"))


def undeclared(args: Column, menu: Column, name: Column) -> Column:
    """Call arguments the tool does not declare."""
    given = F.coalesce(F.map_keys(args), F.array().cast("array<string>"))
    return F.array_except(given, declared_args(menu, name))


def same_set(a: Column, b: Column) -> Column:
    """Equality of two arrays as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def pending_call(menu: Column, transfer: Column, wave: int = 2) -> Column:
    """JSON text of the call a patch edits: the transfer tool if listed, else the first."""
    number, text, money, why = t.FILLERS[wave]
    like = lambda k, *parts: k.rlike("|".join(parts))

    def literal(k: Column, v: Column) -> Column:
        return (F.when(like(k, "curr", "ccy"), json_string(F.lit(money)))
                .when(like(k, "reason", "note", "narration"), json_string(F.lit(why)))
                .when(v == "number", F.lit(number)).otherwise(json_string(F.lit(text))))

    def render(tool: Column) -> Column:
        fields = F.transform(F.map_entries(tool["arguments"]),
                             lambda e: F.concat(json_string(e["key"]), F.lit(":"), literal(e["key"], e["value"])))
        return F.concat(F.lit('{"name":'), json_string(tool["name"]), F.lit(',"arguments":{'),
                        F.array_join(fields, ","), F.lit("}}"))

    chosen = F.coalesce(last_where(menu, lambda x: x["name"] == transfer), F.get(menu, F.lit(0)))
    return let(chosen, render)


def lang_sequence(seed: int, key: Column, n: Column) -> Column:
    """A language per turn; switches after the first turn, sometimes to a third language."""
    first = choice(draw(seed, key, "lang_a"), t.NG)

    def second(p: Column) -> Column:
        pool = F.filter(lits((*t.NG, "eng", "eng")), lambda x: x != p["a"])
        return F.struct(p["a"].alias("a"), choice(draw(seed, key, "lang_b"), pool).alias("b"),
                        (F.pmod(draw(seed, key, "switch"), n - 1) + 1).alias("s"))

    def sequence(p: Column) -> Column:
        left = n - 1 - p["s"]
        third = choice(draw(seed, key, "lang_c"), F.concat(
            F.filter(lits((*t.NG, "eng")), lambda x: x != p["b"]), F.array(p["a"])))
        back = F.when((n >= 5) & (left > 0) & (unit(draw(seed, key, "third")) < 0.45),
                      F.pmod(draw(seed, key, "back"), F.greatest(left, F.lit(1))) + p["s"] + 1).otherwise(n)
        return let(F.struct(third.alias("c"), back.alias("k")), lambda q: F.transform(
            F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")),
            lambda i: F.when(i < p["s"], p["a"]).when(i < q["k"], p["b"]).otherwise(q["c"])))

    return let(F.struct(first.alias("a")), lambda p: let(second(p), sequence))


def switches(langs: Column) -> Column:
    """W1, array form: adjacent pairs that differ."""
    return F.size(F.filter(F.arrays_zip(langs.alias("x"), F.slice(langs, F.lit(2), F.size(langs)).alias("y")),
                           lambda p: p["y"].isNotNull() & (p["x"] != p["y"])))


def _video_tool(name: str, description: str, args) -> Column:
    arguments = F.create_map(*[F.lit(x) for pair in args for x in pair])
    return F.struct(F.lit(name).alias("name"), F.lit(description).alias("description"), arguments.alias("arguments"))


def video_menu(seed: int, key: Column) -> Column:
    """The generation tool among three to five of its sibling endpoints, shuffled."""
    names = [tool[0] for tool in t.VIDEO_TOOLS]
    tools = F.create_map(*[x for tool in t.VIDEO_TOOLS for x in (F.lit(tool[0]), _video_tool(*tool))])
    others = F.slice(_keyed_order(lits(names[1:]), seed, key, "other"), F.lit(1),
                     choice(draw(seed, key, "n_other"), (3, 4, 5)))
    listed = _keyed_order(F.concat(lits(names[:1]), others), seed, key, "order")
    return F.transform(listed, lambda n: F.element_at(tools, n))
