"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int, pool=None) -> str:
    pool = pool or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(pool) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def odd_rows(rng: random.Random):
    """Nulls, empty and blank texts, one very long text, ties and repeated rows."""
    long = prose(rng, 30_000)
    return [(0, None, None, None), (1, ""), (2, " \t\n"), (3, "one"), (4, long, "en", "big"), (5, "a b c d e"), (5, "a b c d e"),
            (6, "a b c d e"), (None, "no key at all", "en", None), (7, "xé中 " * 40, None, "s")]
