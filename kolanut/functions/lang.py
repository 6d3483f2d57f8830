"""Language of a short reply: orthography first, strong markers next, word counts last."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.common import let, sql_list, sql_str


def spaced(text: Column) -> Column:
    """Lower-cased text with everything but letters and digits as a space, and one at each end."""
    body = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N} ]", " "))
    return F.concat(F.lit(" "), body, F.lit(" "))


def squeezed(padded: Column) -> Column:
    """A run of one word counts every other time, as counting ' word ' without overlap does."""
    return F.regexp_replace(padded, r" ([^ ]++) \1(?= )", " $1")


def _one_of(words: Iterable[str]) -> str:
    """An alternation grouped by first letter, so most words are refused at their first letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(h + (f"(?:{'|'.join(rest)})" if rest != [""] else "") for h, rest in heads.items())


def known_words(squeezed_text: Column, words: Iterable[str]) -> Column:
    """The given words as they occur in squeezed text, in one scan."""
    return F.regexp_extract_all(squeezed_text, F.lit(f" ({_one_of(words)})(?= )"), F.lit(1))


def detect_lang(text: Column, rules: Mapping[str, Iterable[str]] = t.VIDEO_WORDS) -> Column:
    """Language code by rule cascade; null when nothing matches. The first rule wins a tie."""
    raw = F.coalesce(text, F.lit(""))
    has = lambda marks: raw.rlike(f"[{marks}]")
    every = [w for words in (*rules.values(), t.PIDGIN_STRONG, t.HAUSA_STRONG) for w in words]

    scores = ", ".join(f"named_struct('n', size(filter(ws, w -> w IN ({', '.join(map(sql_str, words))}))), 'r', {-i}, 'lang', '{lang}')"
                       for i, (lang, words) in enumerate(rules.items()))
    by_words = f"""ws -> CASE WHEN arrays_overlap(ws, {sql_list(t.PIDGIN_STRONG)}) THEN 'pcm'
        WHEN arrays_overlap(ws, {sql_list(t.HAUSA_STRONG)}) THEN 'hau'
        ELSE array_max(array(named_struct('n', 0, 'r', 1, 'lang', CAST(NULL AS STRING)), {scores})).lang END"""
    # every mark lies in one range, which plain Latin text has nothing in
    marked = raw.rlike(r"[\u0181-\u1ee5]")
    return (F.when(marked & has(t.YORUBA_MARKS) & has(t.IGBO_VOWELS) & ~has(t.YORUBA_ONLY), "ibo")
            .when(marked & has(t.YORUBA_MARKS), "yor")
            .when(marked & has(t.IGBO_MARKS), "ibo")
            .when(marked & has(t.HAUSA_MARKS), "hau")
            .otherwise(let(known_words(squeezed(spaced(raw)), every), by_words)))


def alias_lang(lang: Column, table: Mapping[str, str] = t.LANG_ALIAS) -> Column:
    """One code per language."""
    out = lang
    for old, new in table.items():
        out = F.when(lang == old, new).otherwise(out)
    return out


def known_langs(rules: Mapping[str, Iterable[str]] = t.VIDEO_WORDS) -> tuple[str, ...]:
    return tuple(dict.fromkeys((*rules, "yor", "ibo", "hau")))
