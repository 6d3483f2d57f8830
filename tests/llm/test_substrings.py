import random
import re

import pytest
from frames import documents, odd_rows, prose

from kolanut.llm import packed, substrings
from kolanut.llm import words as w


def brute(rows, run):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, ws in split:
        for i in range(len(ws) - run + 1):
            if d is not None:
                k = tuple(ws[i:i + run])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - run + 1):
            if d is not None and least[tuple(ws[i:i + run])] < d:
                gone |= set(range(i, i + run))
        out.append((d is None, d or 0, len(ws), len(gone), " ".join(x for i, x in enumerate(ws) if i not in gone)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_cover_holds_every_difference():
    assert substrings.cover_ok(substrings.PERIOD, substrings.COVER)
    assert not substrings.cover_ok(7, (0, 1, 2))


@pytest.mark.parametrize("flush", [50, 1 << 20])
def test_matches_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(packed, "FLUSH_KEYS", flush)
    rng = random.Random(flush)
    shared = [prose(rng, n) for n in (12, 13, 14, 40, 90)]
    rows = [(i, " ".join([prose(rng, rng.randint(0, 30)), rng.choice(shared), prose(rng, rng.randint(0, 9)), rng.choice(shared)]))
            for i in rng.sample(range(1000), 60)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(3000, "r " * 50), (3001, "r " * 30 + "s " * 20), (3001, "r " * 30 + "s " * 20)]
    rows += [(d, t) for d, t, *_ in odd_rows(rng)]
    got = result(substrings.remove_repeats(documents(spark, rows)))
    assert got == brute(rows, 13)
    assert sum(g[3] for g in got) > 500


def test_empty_and_clashing_columns(spark):
    docs = documents(spark, [(1, "a " * 20), (2, "a " * 20)]).selectExpr("*", "1 AS found", "2 AS owner", "3 AS kept")
    assert [g[3] for g in result(substrings.remove_repeats(docs))] == [0, 20]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_windows_never_cross_rows():
    import numpy as np
    import pyarrow as pa
    data, at = w.raw(pa.array(["a b c", None, "d", "", "e f g h"]))
    starts, ends, first = w.spans(data, at, w.separators())
    assert first.tolist() == [0, 3, 3, 4, 4, 8]
    hashes = w.WordHash()(data, starts, ends)
    found, before = w.windows(hashes, first, 3)
    assert before.tolist() == [0, 1, 1, 1, 1, 3]
    again, _ = w.windows(hashes[4:], np.array([0, 4]), 3)
    assert found[1:].tolist() == again.tolist()
