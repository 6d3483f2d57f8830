import random

import pytest
from frames import documents, odd_rows, prose

from kolanut.llm import decontamination as dc

ITEM = "item_id bigint, text string"


def planted(rng, pool, n_items=40):
    items = [(i, prose(rng, rng.randint(10, 60), pool)) for i in range(n_items)]
    rows, want = [], set()
    for d in range(300):
        text = prose(rng, rng.randint(0, 200), pool)
        if d % 3 == 0:
            item, words = rng.choice(items)
            ws = words.split()
            for _ in range(rng.randint(0, int(len(ws) * dc.EDITS))):
                j = rng.randrange(len(ws))
                ws[j:j + 1] = rng.choice([[], [ws[j], "extra"], ["other"]])
            text = " ".join([text, " ".join(ws).upper() if d % 2 else ", ".join(ws), prose(rng, 20, pool)])
            want.add((d, item))
        rows.append((d, text))
    return items, rows, want


def test_planted_leaks_are_found_and_nothing_else(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(150)]
    items, rows, want = planted(rng, pool)
    items += [(90, None), (91, ""), (92, "w1 w2"), (None, prose(rng, 20, pool))]
    rows += odd_rows(rng)[:8] + [(900, items[0][1]), (900, items[0][1])]
    found = dc.leaks(documents(spark, rows), spark.createDataFrame(items, ITEM))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(want & got) >= 0.97 * len(want)
    assert got - want == {(900, 0)}


def test_each_hit_is_checked_by_its_edits(spark):
    rng = random.Random(5)
    items = [(1, prose(rng, 30))]
    ws = items[0][1].split()
    rows = [(1, " ".join(ws)), (2, " ".join(ws[:10] + ["x"] + ws[11:])), (3, " ".join(ws[:5] + ws[7:])), (4, " ".join(ws[:15])),
            (5, " ".join("x" if i % 3 == 0 else x for i, x in enumerate(ws)))]
    got = {r.doc_id: (r.first_word, r.edits) for r in dc.leaks(documents(spark, rows), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (0, 2)}


def test_edit_distance_is_exact():
    import numpy as np

    def slow(a, b):
        best = []
        for k in range(len(b) + 1):
            row = list(range(k + 1))
            for i, x in enumerate(a):
                new = [i + 1]
                for j in range(k):
                    new.append(min(row[j] + (b[j] != x), row[j + 1] + 1, new[j] + 1))
                row = new
            best.append(row[-1])
        return min(best)

    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        assert dc.edit_distance(np.array(a), np.array(b), 99)[0] == slow(a, b)


@pytest.mark.parametrize("per_pass", [7, 10_000])
def test_passes_do_not_change_the_result(spark, per_pass):
    items, rows, _ = planted(random.Random(8), [f"w{i}" for i in range(150)])
    one = dc.leaks(documents(spark, rows), spark.createDataFrame(items, ITEM), items_per_pass=per_pass)
    exact = {(d, i) for d, t in rows for i, x in items if f" {x} " in f" {t.lower().replace(',', '')} "}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in one.collect()}


def test_empty_tables_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], ITEM)
    docs = documents(spark, [(1, "x a b c d e f g h i j y")]).selectExpr("*", "1 AS item_id", "2 AS edits")
    assert [(r.doc_id, r.item_id, r.first_word) for r in dc.leaks(docs, items).collect()] == [(1, 1, 1)]
    assert dc.leaks(docs.limit(0), items).count() == 0 and dc.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("n", [20, 60, 120, 300])
def test_long_items_are_found_at_the_edit_limit(spark, n):
    rng = random.Random(n)
    pool = [f"w{i}" for i in range(5000)]
    items = [(i, prose(rng, n, pool)) for i in range(100)]
    rows = []
    for i, text in items:
        ws = text.split()
        for _ in range(int(n * dc.EDITS)):
            j = rng.randrange(len(ws))
            ws[j:j + 1] = rng.choice([[], [ws[j], "extra"], ["other"]])
        rows.append((i, " ".join([prose(rng, rng.randint(0, 40), pool), " ".join(ws), prose(rng, 20, pool)])))
    got = {(r.doc_id, r.item_id) for r in dc.leaks(documents(spark, rows), spark.createDataFrame(items, ITEM)).collect()}
    assert len(got & {(i, i) for i in range(100)}) >= 98


def test_the_best_start_is_exact():
    import numpy as np
    rng = random.Random(9)
    for _ in range(200):
        a = np.array([rng.randint(0, 3) for _ in range(rng.randint(2, 10))])
        b = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 16))])
        want = min((dc.edit_distance(a, b[s:], 99)[0], s) for s in range(len(b) + 1))
        start, edits = dc.best_start(a, b, 99)
        assert (edits, start) == want


def test_short_items_and_scripts_without_spaces(spark):
    zh = "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待"
    th = "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ"
    items = [(1, "forty-two"), (2, "Paris"), (3, "what is seven times six in words"), (4, zh), (5, th), (6, "自由"), (7, "🙂 𠀀𠀁")]
    rows = [(10, "He said: FORTY two, then left"), (11, "paris"), (12, "forty times two"), (13, "So what is seven times six, in words?"),
            (14, "what is seven times nine in words"), (15, "前言。" + zh + "后记"), (16, zh[:10] + "不" + zh[11:20] + zh[21:]), (17, zh[::-1]),
            (18, "text " + th[:12] + th[13:] + " text"), (19, "parisian"), (20, "x🙂𠀀𠀁"), (21, "🙂 𠀀𠀁 x"), (22, None), (23, "paris paris")]
    found = dc.leaks(documents(spark, rows), spark.createDataFrame(items, ITEM), short_items=True)
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.edits) for r in found.collect()}
    assert got.pop((16, 4))[2] == 2 and got.pop((18, 5))[2] == 1
    assert got == {(10, 1): (2, 2, 0), (11, 2): (0, 1, 0), (13, 3): (1, 7, 0), (15, 4): (3, len(zh), 0), (15, 6): (7, 2, 0), (16, 6): (4, 2, 0),
                   (21, 7): (0, 3, 0), (23, 2): (0, 1, 0)}


def test_characters_are_cut_as_by_a_plain_loop():
    import numpy as np
    import pyarrow as pa

    from kolanut.llm import words
    table = words.separators(alnum_only=True)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é中文ไท,🙂𠀀ñひ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", "中", "a中", "中a"]
    data, at = words.raw(pa.array(texts))
    starts, ends, first = words.characters(data, at, table)
    got = [[bytes(data[starts[i]:ends[i]]).decode() for i in range(first[r], first[r + 1])] for r in range(len(texts))]
    import re
    assert got == [re.findall("[中文ไท𠀀ひ]|[abéñ🙂]+", t) for t in texts] and (np.diff(first) >= 0).all()
