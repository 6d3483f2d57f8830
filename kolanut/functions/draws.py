"""Keyed draws: every random choice is a pure function of (seed, row key, purpose).

The same row gets the same draw under any partitioning and after any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolanut.functions.common import let, lits

RANGE = 1 << 32
WIDE_BITS = 60


def draw(seed: int, key: Column, purpose: Column | str) -> Column:
    """A uniform integer in [0, 2^32)."""
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), purpose))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def wide_draw(seed: int, key: Column, purpose: Column | str) -> Column:
    """A uniform integer in [0, 2^60), for choices among more than 2^32 things."""
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), purpose))
    return F.conv(F.substring(digest, 1, WIDE_BITS // 4), 16, 10).cast("bigint")


def scaled(d: Column, total: Column) -> Column:
    """floor(d * total / 2^60) for a wide draw and a total below 2^62: every unit of the total is as likely.

    The product has up to 122 bits, so it is put together from halves of 30 bits.
    """
    half, low = WIDE_BITS // 2, F.lit((1 << (WIDE_BITS // 2)) - 1)
    a, b = F.shiftright(total, half), total.bitwiseAND(low)
    h, l = F.shiftright(d, half), d.bitwiseAND(low)
    return h * a + F.shiftright(h * b + l * a + F.shiftright(l * b, half), half)


def unit(d: Column) -> Column:
    return d / F.lit(float(RANGE))


def choice(d: Column, values: Sequence | Column) -> Column:
    """Uniform choice; repeat a value in the list to weight it."""
    if not isinstance(values, Column):
        values = list(values)
        return F.element_at(lits(values), (F.pmod(d, F.lit(len(values))) + 1).cast("int"))
    return let(values, lambda v: F.when(F.size(v) > 0, F.get(v, F.pmod(d, F.greatest(F.size(v), F.lit(1))).cast("int"))))


def round_robin(i: Column, values: Sequence) -> Column:
    """Category by position."""
    return F.element_at(lits(values), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def weighted_of(d: Column, terms: Column) -> Column:
    """G3 over an ARRAY of (term, lo, hi) structs: the term whose [lo, hi) holds the wide draw, scaled to the total.

    The array is a handful of dictionary terms; ``weighted_choice`` handles tables of any size.
    """
    return let(terms, lambda ts: let(
        scaled(d, F.coalesce(F.try_element_at(ts, F.lit(-1))["hi"], F.lit(1).cast("bigint"))),
        lambda u: F.get(F.filter(ts, lambda x: (x["lo"] <= u) & (u < x["hi"])), F.lit(0))["term"]))
