"""Small helpers the other expression modules share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Unicode-aware strip sees it. LINE_ENDS are the characters that also end a line.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = "\t\x1f \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
SPACES = LINE_ENDS + BLANKS
BLANK_CLASS = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body: str | Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    ``body`` is a lambda, or the same as SQL text (``"x -> concat(x, x)"``): a long expression is
    then one parse on the driver in place of hundreds of calls.
    """
    bound = F.expr(body) if isinstance(body, str) else body
    held = F.array(value)
    out = F.call_function("transform", held, bound) if isinstance(body, str) else F.transform(held, bound)
    return F.get(out, F.lit(0))


def sql_str(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: Iterable[str]) -> str:
    return "array(" + ", ".join(sql_str(v) for v in values) + ")"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lines_of(text: Column) -> Column:
    """The text with every kind of line end turned into ``\\n``; null becomes empty. Texts without the rare kinds are only looked through."""
    rare = " OR ".join(f"contains(s, {sql_str(c)})" for c in LINE_ENDS if c != "\n")
    rule = sql_str(r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return let(F.coalesce(text, F.lit("")), f"s -> IF({rare}, regexp_replace(s, {rule}, '\\n'), s)")


def lits(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def last_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(-1))


def is_blank(text: Column) -> Column:
    """True for null and for the empty string, the two values that read as absent."""
    return F.coalesce(text, F.lit("")) == ""


def quote_re(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)
