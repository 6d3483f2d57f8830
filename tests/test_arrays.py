"""JSON arrays read by byte ranges against the JSON library."""

import json
import random

import pytest

from kolanut.sources import arrays, readers


def _texts(rng):
    odd = ['"', "\\", '\\"', "[", "]", "{", "}", ",", "é", "漢", "\n", "a", "\\\\", '],[{"', "😀"]
    return "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))


def _value(rng, deep=0):
    kind = rng.randint(0, 7 if deep < 3 else 4)
    if kind > 5:
        return [_value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    if kind > 3 and deep < 3:
        return {_texts(rng): _value(rng, deep + 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([_texts(rng), rng.randint(-9, 999), None, True, 1.5])


def _dump(value, rng):
    return json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))


def test_any_cut_gives_the_same_elements(tmp_path):
    """Every range length, down to one byte: borders inside texts, escapes and characters."""
    rng = random.Random(5)
    path = str(tmp_path / "a.json")
    for _ in range(25):
        value = [_value(rng) for _ in range(rng.randint(0, 8))]
        data = (" \n" * rng.randint(0, 2) + _dump(value, rng) + "\n").encode()
        with open(path, "wb") as f:
            f.write(data)
        for span in {1, 2, 3, 7, 40, len(data)}:
            state, got = arrays.State(), []
            for start in range(0, len(data), span):
                end, block = min(start + span, len(data)), rng.choice([1, 3, 1000])
                got += arrays.elements(path, start, end, len(data), state, block)
                state = arrays.after(state, arrays.effect(path, start, end, block))
            assert [json.loads(x) for _, x in got] == value
            assert state == arrays.State() and [at for at, _ in got] == sorted({at for at, _ in got})


def test_files_in_many_ranges(spark, tmp_path):
    rng = random.Random(8)
    want = {}
    for i in range(4):
        want[f"f{i}.json"] = [_value(rng) for _ in range((0, 1, 30, 90)[i])]
        (tmp_path / f"f{i}.json").write_text(_dump(want[f"f{i}.json"], rng))
    for span, block in ((64, 16), (1000, 100), (1 << 25, 1 << 20)):
        df = arrays.read_array(spark, str(tmp_path), span, block)
        got = {name: [] for name in want}
        for r in df.orderBy("_file", "_at").collect():
            got[r["_file"].rsplit("/", 1)[1]].append(json.loads(r["value"]))
        assert got == want


def test_a_task_reads_its_range_and_the_rest_of_one_element(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": str(i), "t": "x" * 80} for i in range(2000)]))
    read = []
    plain = arrays._blocks
    monkeypatch.setattr(arrays, "_blocks", lambda *a: (read.append(len(b)) or (at, b) for at, b in plain(*a)))
    size, state = path.stat().st_size, arrays.State()
    state = arrays.after(state, arrays.effect(str(path), 0, 100_000, 256))
    read.clear()
    assert 90 < len(list(arrays.elements(str(path), 100_000, 110_000, size, state, 256))) < 110
    assert sum(read) <= 10_000 + 3 * 256


@pytest.mark.parametrize("text", ['{"id": "a"}', '[{"id": "a"}', '[{"id": "a}]', "12"])
def test_what_is_no_array_raises(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array|has no end"):
        arrays.read_array(spark, str(tmp_path)).collect()


def test_seed_waves_by_ranges(spark, tmp_path):
    """The reader of seed waves gives the rows of the plain reader, in their order, and the last wave still wins."""
    from kolanut.operators import joins
    rows = [{"id": f"s{i}", "type": "toolact", "menu_id": "m", "menu": [{"name": "n[", "description": '"]', "arguments": {"k": "number"}}], "phase": i} for i in range(300)]
    (tmp_path / "w0.json").write_text(json.dumps(rows))
    (tmp_path / "w1.json").write_text(json.dumps([r | {"phase": -1} for r in rows[:50]]))
    seeds = readers.read_seeds(spark, [f"{tmp_path}/w0.json", f"{tmp_path}/w1.json"], span=512)
    got = seeds.filter("_wave = 0").orderBy("_pos").collect()
    plain = spark.read.schema(seeds.drop("_wave", "_file", "_pos").schema).option("multiLine", True).json(f"{tmp_path}/w0.json").collect()
    assert [r.asDict(True) | {"_wave": 0, "_file": 0, "_pos": 0} for r in got] == [r.asDict(True) | {"_wave": 0, "_file": 0, "_pos": 0} for r in plain]
    assert joins.last_wave(seeds).filter("phase = -1").count() == 50
