import random

import public_tokenizers
import pytest
import sentencepiece
from frames import documents, odd_rows, prose

from kolanut.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(tc.read_scores(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts(rng, n):
    for _ in range(n):
        size = rng.randint(0, 40)
        yield rng.choice([
            lambda: "".join(rng.choice("ab ") for _ in range(size)),
            lambda: "".join(rng.choice("etaoinshr \n.,'") for _ in range(size)),
            lambda: " " * size + rng.choice(["", "x", "the"]) + " " * rng.randint(0, 20),
            lambda: "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x4E00, 0x4F00), 0x1F600, 0x2581, 32])) for _ in range(size)),
            lambda: "<s> </s> <unk> <0x41>"[:size],
        ])()


def test_counts_are_the_librarys_for_any_chunks(counter, library):
    rng = random.Random(3)
    for text in _texts(rng, 1500):
        marked = tc.marked_text(text)
        chunk = rng.choice([1, 2, 5, 17, 1000])
        maps = [counter.chunk_map(marked[i:i + chunk]) for i in range(0, len(marked), chunk)]
        assert counter.fold(maps) == len(library.encode(text)), repr(text)


def test_chunk_maps_compose_in_any_grouping(counter):
    rng = random.Random(4)
    marked = tc.marked_text(prose(rng, 60) + "z" * 30)
    maps = [counter.chunk_map(marked[i:i + 7]) for i in range(0, len(marked), 7)]
    left = maps[0]
    for m in maps[1:]:
        left = counter.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = counter.compose(m, right)
    assert left == right


def test_tables_that_overflow_are_rebuilt(monkeypatch, library):
    monkeypatch.setattr(tc, "MAX_STATES", 5)
    monkeypatch.setattr(tc, "MAX_WORDS", 5)
    small = tc.Counter(tc.read_scores(PATH))
    text = prose(random.Random(5), 300, ["the", "thing", "other", "strange", "words", "here"])
    assert small.count(tc.marked_text(text)) == len(library.encode(text))


def test_rows_of_every_kind(spark, library):
    rows = odd_rows(random.Random(1))
    docs = documents(spark, rows).select("doc_id", "text", tc.n_bytes("text").alias("n_bytes"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tc.count_tokens(docs, PATH).collect())
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert got == want
    clash = docs.selectExpr("doc_id", "text", "7 AS n_tokens", "text AS extra")
    assert tc.count_tokens(clash, PATH).columns == ["doc_id", "extra", "n_tokens"]
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
