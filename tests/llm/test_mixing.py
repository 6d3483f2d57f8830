import random
from collections import defaultdict

import pytest
from frames import documents, odd_rows, prose

from kolanut.llm import mixing


def water_level(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again what is over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 0, "b": 0}, {"a": 0, "b": 7},
    {f"s{i:02d}": (i * 37) % 11 * 10 for i in range(20)}, {"only": 50}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water_level(sizes))


def test_taken_words_come_near_the_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows += odd_rows(rng)
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    size, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    assert {r.source: r.source_size for r in got} == size
    assert target == pytest.approx(water_level(size))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    again = mixing.mix(documents(spark, rows).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_and_clashing_columns(spark):
    docs = documents(spark, [(1, "a b", "en", "s")]).selectExpr("*", "1 AS size", "2 AS target", "3 AS _rate")
    assert [(r.size, r.taken) for r in mixing.mix(docs).collect()] == [(2, 2)]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_null_and_repeated_keys_get_places_of_their_own(spark):
    """Rows under one key, alike in text or not, are taken like any others, and alike under other partitionings."""
    rows = [(None, f"w{i % 40} x", "en", "s") for i in range(900)] + [(7, "same text", "en", "s") for _ in range(900)]
    rows += [(i, "a b", "en", "t") for i in range(300)]
    runs = []
    for parts in (1, 3, 8):
        got = mixing.mix(documents(spark, rows).repartition(parts)).collect()
        runs.append(sorted((str(r.doc_id), r.source, r.size, r.copies) for r in got))
        size = {s: sum(r.size for r in got if r.source == s) for s in "st"}
        goal = water_level(size)
        for key in (None, 7):  # each key's rows come near their share of the source
            mine = [r for r in got if r.doc_id == key]
            assert abs(sum(r.taken for r in mine) / goal["s"] - sum(r.size for r in mine) / size["s"]) < 0.05
    assert runs[0] == runs[1] == runs[2]
    texts = [sorted((str(r.doc_id), r.text) for r in mixing.mixed(documents(spark, rows).repartition(p)).collect()) for p in (2, 5)]
    assert texts[0] == texts[1] and len(texts[0]) == sum(n for *_, n in runs[0])


def test_mixed_keeps_all_columns_whatever_their_names(spark):
    """Copies hold their row's own columns, and no row alike in key, text and source is lost where other columns differ."""
    rows = [(i % 50, f"t{i % 25} u", "en" if i % 2 else "fr", "s") for i in range(200)] + [(None, None, None, None), (1000, "", "en", "s")]
    docs = documents(spark, rows).selectExpr("*", "1 AS _a", "2 AS copies", "3 AS _row", "4 AS size", "5 AS `a.b`")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert all((r["_a"], r["copies"], r["_row"], r["size"], r["a.b"]) == (1, 2, 3, 4, 5) for r in got)
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.copies
    have = defaultdict(int)
    for r in got:
        have[r.doc_id] += 1
    assert have == {k: n for k, n in taken.items() if n}
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_slices_follow_the_counts(spark, monkeypatch):
    """Rows that share size, source and key are spread over many slices, and still taken evenly."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 64)
    rows = documents(spark, [(None, "a b", "en", "s")] * 4000)
    got = mixing.mix(rows).collect()
    assert abs(sum(r.taken for r in got) - 8000) <= 2 and {r.copies for r in got} <= {0, 1}
    plan = mixing.with_copies(spark.range(4000).selectExpr("id", "2L AS n", "'s' AS source"), "n", "source", mixing.F.col("id").cast("string"))
    assert plan.agg({"copies": "sum"}).first()[0] == 4000
