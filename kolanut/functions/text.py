"""Text into columns: labelled blocks, numbered turns, tagged spans, sentences, terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.common import (
    BLANK_CLASS, SPACE_CLASS, SPACES, is_blank, let, lines_of, quote_re, sql_list, sql_str, strip,
)

# Unicode noncharacters, reserved for use inside a process: they cannot occur in real text.
_OPEN, _SEP = "\ufdd0", "\ufdd1"
_SPACES = sql_str(SPACES)


def _labelled(text: Column, label: str, out: str) -> Column:
    """Text split at its label lines; what stands before the first label is dropped."""
    # the value is taken to the line's end and given back down to its last sign: a lazy one would test for the end at every letter
    rule = rf"(?m)^{BLANK_CLASS}*{label}{BLANK_CLASS}*:{BLANK_CLASS}*((?:[^\n]*(?!{BLANK_CLASS})[^\n])?){BLANK_CLASS}*$"
    marked = F.regexp_replace(lines_of(text), rule, out)
    return F.filter(F.split(marked, _OPEN), lambda _, i: i > 0)


def blocks(text: Column, labels: Iterable[str] = t.BLOCK_LABELS) -> Column:
    """``LABEL: text`` blocks with continuation lines -> MAP label -> text; a repeat wins."""
    labels = tuple(labels)
    chunks = _labelled(text, f"({'|'.join(labels)})", f"{_OPEN}$1{_SEP}$2")
    return let(let(chunks, f"""cs -> transform(cs, c -> named_struct(
            'k', substring_index(c, '{_SEP}', 1), 'v', btrim(substring_index(c, '{_SEP}', -1), {_SPACES})))"""),
        f"""e -> map_filter(map_from_arrays({sql_list(labels)}, transform({sql_list(labels)},
            l -> try_element_at(filter(e, x -> x.k = l), -1).v)), (k, v) -> v IS NOT NULL)""")


def turns(text: Column, multiline: bool = True) -> Column:
    """``T<n>_LABEL: text`` lines -> turns sorted by their stated number.

    ``multiline=False`` keeps the label's own line only, as the validator reads sessions.
    """
    chunks = _labelled(text, f"T([0-9]{{1,18}})_({'|'.join(t.TURN_LABELS)})", f"{_OPEN}$1{_SEP}$2{_SEP}$3")
    body = f"substring_index(c, '{_SEP}', -1)"
    body = f"btrim({body}, {_SPACES})" if multiline else f"substring_index({body}, '\\n', 1)"
    fields = ", ".join(f"'{x.lower()}', try_element_at(filter(e, x -> x.n = num AND x.k = '{x}'), -1).v" for x in t.TURN_LABELS)
    return let(let(chunks, f"""cs -> transform(cs, c -> named_struct('n', CAST(substring_index(c, '{_SEP}', 1) AS BIGINT),
            'k', substring_index(substring_index(c, '{_SEP}', 2), '{_SEP}', -1), 'v', {body}))"""),
        f"""e -> transform(sort_array(array_distinct(transform(e, x -> x.n))), num -> named_struct('n', num, {fields}))""")


def is_noneish(text: Column, words: Iterable[str] = t.NONE_WORDS) -> Column:
    """Absent, empty, or a word that says so."""
    return is_blank(text) | F.upper(strip(F.coalesce(text, F.lit("")))).isin(*words)


def tagged_spans(text: Column, tag: str = "scene_description") -> Column:
    """The texts between ``<tag>`` and its close (or the end of the text)."""
    t_ = quote_re(tag)
    return F.regexp_extract_all(text, F.lit(rf"(?sd)<{t_}>(.*?)(?:</{t_}>|$)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.split(text, rf"(?<=[.!?]){SPACE_CLASS}+")


_WORD = r"[\p{L}\p{N}_]"


_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def folded(text: Column) -> Column:
    """Lower case, with the letters that a caseless search takes for i and s."""
    return F.lower(F.translate(text, "\u0131\u0130\u017f", "iis"))


def _pattern(source: str, anchored: bool) -> str:
    """The wording in lower case with Unicode word edges.

    An edge in front of a letter looks for the letter first: the look-behind then runs only there,
    not at every character of the text.
    """
    if anchored:
        first = "".join(sorted({alt[0] for alt in re.sub(r"\\b|\([^()]*\)", "", source).lower().split("|")}))
        source = rf"(?=[{first}])(?<!{_WORD})(?:" + source.replace(r"\b", "").lower() + r")\b"
    else:
        source = re.sub(r"\\b(\w)", lambda m: rf"(?={m[1]})(?<!{_WORD}){m[1]}".lower(), source).lower()
        source = source.replace(_WORD.lower(), _WORD)
    return source.replace(r"\b", _EDGE)


def _stems(source: str) -> list[str]:
    """The plain letters each alternative of a wording starts with; none if one has a single letter."""
    flat = re.sub(r"\([^()]*\)", "(", source).lower()
    stems = [re.match(r"(?:\\b)?((?:[a-z '](?!\?))*)", alt)[1] for alt in flat.split("|")]
    return stems if min(map(len, stems)) > 1 else []


def tag_terms(text: Column, dictionary: Iterable[tuple[str, str]], anchored: bool = False,
              fold: bool = True) -> Column:
    """X11: canonical terms whose wording occurs in the text, in dictionary order, each once.

    ``anchored=True`` asks for whole words, where the default counts ``forms`` for ``MS``. The text
    is folded once, as a caseless pattern costs far more per character, and a pattern is searched
    for only where the first letters of one of its alternatives occur.
    """
    low = folded(text) if fold else text

    def occurs(source: str) -> Column:
        hit = low.rlike(_pattern(source, anchored))
        stems = [F.contains(low, F.lit(x)) for x in _stems(source)]
        return reduce(lambda a, b: a | b, stems) & hit if stems else hit

    found = [F.when(occurs(p), F.lit(term)) for p, term in dictionary]
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))


def tag_groups(text: Column, groups: Mapping[str, Iterable[tuple[str, str]]], anchored: bool = False,
               fold: bool = True) -> Column:
    return F.struct(*[tag_terms(text, d, anchored, fold).alias(g) for g, d in groups.items()])


def terms_in(text: Column, vocab: Iterable[str]) -> Column:
    """Vocabulary terms contained in the text, lower-cased, without word edges."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.when(F.contains(low, F.lit(v)), F.lit(v)) for v in vocab])
    return F.array_except(found, F.array(F.lit(None).cast("string")))


def beats(prompt: Column, keep_empty: bool = False) -> Column:
    """The ``Shot N:`` sections of a prompt; empty unless there are two markers."""
    rule = rf"(?iu)(?<!{_WORD})Shot{SPACE_CLASS}*\p{{Nd}}+{SPACE_CLASS}*:"

    empty = "true" if keep_empty else "x <> ''"
    return let(F.split(F.coalesce(prompt, F.lit("")), rule), f"""parts -> IF(size(parts) > 2,
        filter(transform(filter(parts, (x, i) -> i > 0), x -> btrim(x, {_SPACES})), x -> {empty}), CAST(array() AS ARRAY<STRING>))""")


def wanted_ratio(brief: Column) -> Column:
    """Aspect ratio implied by the purpose; null when the brief names none."""
    low = F.lower(F.coalesce(brief, F.lit("")))
    names = lambda words: low.rlike("|".join(words))
    return (F.when(names(t.VERTICAL_WORDS), "9:16")
            .when(names(t.SQUARE_WORDS), "1:1")
            .when(names(t.WIDE_WORDS), "16:9"))
