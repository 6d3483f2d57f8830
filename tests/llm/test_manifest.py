"""Manifest trees against a brute-force version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from frames import documents, odd_rows
from kolanut.llm import manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _climb(digests):
    """Root of a list of digests, and for each its siblings (before, behind) level by level."""
    steps = [[] for _ in digests]
    under, level = [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        for k, own in enumerate(under):
            lo = k // 16 * 16
            for i in own:
                steps[i].append(("".join(level[lo:k]), "".join(level[k + 1:lo + 16])))
        under = [[i for own in under[k:k + 16] for i in own] for k in range(0, len(level), 16)]
        level = [_h(*level[k:k + 16]) for k in range(0, len(level), 16)]
    return level[0], steps


def brute(rows):
    """Rows of (doc_id, text, lang, source, n_chars) -> (doc_id, source, leaf, subroot, root, steps)."""
    groups = {}
    for d, t, lang, s, n in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, _h(*map(_field, (d, s, lang, n, t))), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _climb([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in names}
    root, tops = _climb([trees[s][0] for s in names])
    return sorted(((r[3], s, r[2], trees[s][0], root, trees[s][1][i] + tops[k]) for k, s in enumerate(names)
                   for i, r in enumerate(sorted(groups[s], key=lambda r: r[:3]))), key=str)


def _got(df):
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_trees_match_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(i, f"text {i}", "en", "hot", i) for i in range(300)] + [(i, f"t{i}", None, f"s{i % 20}", 1) for i in range(60)]
    rows += [(i, "x", "de", None, 1) for i in range(17)] + [(7, "alone", "en", "é", None), (8, "alone", "en", "z", None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(parts)
    assert _got(manifest.manifest(docs)) == brute(rows)


def test_odd_rows_repeated_keys_and_clashing_names(spark):
    rows = odd_rows(random.Random(4)) + [(None, "hot key", "en", "s")] * 40
    docs = documents(spark, rows)
    full = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()]
    named = docs
    for c in ("leaf", "root", "steps", "lo", "hi", "n", "_group", "_row", "_at", "kids"):
        named = named.withColumn(c, F.lit("given"))
    assert _got(manifest.manifest(named)) == brute(full)
    assert manifest.manifest(docs.limit(0)).collect() == []
    one = documents(spark, [(1, "only")])
    [row] = manifest.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.steps == []


def test_folding_tells_changed_leaves(spark):
    docs = documents(spark, [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(100)])
    wrong = F.when(F.col("doc_id") % 7 == 0, F.sha2("text", 256))
    out = manifest.manifest(docs, carry={"wrong": wrong})
    folded = out.select("doc_id", "root", manifest.fold(F.coalesce("wrong", "leaf"), F.col("steps")).alias("folded"))
    assert all((r.folded == r.root) == (r.doc_id % 7 != 0) for r in folded.collect())
