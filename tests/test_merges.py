"""Sub-word encoding: against a plain merge loop, a tokenizer library on its own file, and the mask rule spelled out."""

import random

import pytest

from kolanut import tables as t
from kolanut.operators import merges
from kolanut.sources.readers import read_tokens

LEXICON = [" the", " then", "the", "ing", " th", "aa", "aaa", "ß", " de", "ón", "12"]
GPT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_merge(word: str, pairs) -> list[bytes]:
    parts = [bytes([b]) for b in word.encode()]
    for left, right in pairs:  # ranks in order: a later merge never makes an earlier one possible
        k = 0
        while k + 1 < len(parts):
            if (parts[k], parts[k + 1]) == (left, right):
                parts[k:k + 2] = [left + right]
            k += 1
    return parts


def _encoder(spark, pairs):
    return merges.Encoder(merges.Tokens.read(merges.merge_vocab(spark, pairs)))


def test_merges_match_a_plain_loop(spark):
    pairs = merges.chained(LEXICON)
    encoder = _encoder(spark, pairs)
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice(["a", "aa", " the", "n", "in", "g", "ó", "ß", "e"]) for _ in range(rng.randint(1, 12)))
        want = plain_merge(word, pairs)
        assert encoder._merged(word.encode()) == [encoder.tokens.ids[p] for p in want]


def test_long_words_stay_fast_and_whole(spark):
    pairs = merges.chained(LEXICON)
    word = "a" * 200_000
    assert _encoder(spark, pairs).ids([word])[:2] == _encoder(spark, pairs).ids(["aaaaaa"])[:2]


def _examples(spark, rows):
    schema = "example_id bigint, segments array<struct<text: string, train: boolean>>"
    return spark.createDataFrame([(i, segs) for i, segs in enumerate(rows)], schema).repartition(3)


def by_the_rule(encode, segs, eos):
    """Each segment behind all text before it if that leaves the ids of that text as they were, else by itself."""
    ids, mask, before = [], [], ""
    for text, train in segs:
        text = text or ""
        whole, base = encode(before + text), encode(before)
        new = whole[len(base):] if whole[:len(base)] == base else encode(text)
        ids, mask, before = ids + new, mask + [int(train)] * len(new), before + text
    return ids + [eos], mask + [1]


EDGES = [
    [("th", False), ("en", True)],                      # the word goes on and its ids change: encoded by itself
    [(" the", False), ("n x", True)],
    [("a ", False), (" the", True), ("re", False)],
    [("x <reserved_", False), ("5> y", True)],          # a marker over an edge
    [("<reserved_5>", False), (" the<reserved_6>", True), ("", False), (None, True), ("end", False)],
    [("", False)], [], [("  \n", False), (" a", True)], [("漢字 ón", True), ("ß" * 40, False), (" the" * 30, True)],
]


def test_masks_at_segment_edges(spark):
    rng = random.Random(2)
    rows = EDGES + [[("".join(rng.choice(["th", "e", " ", "n", "aa", "<reserved_5>", "\n", "1", "ó"]) for _ in range(rng.randint(0, 9))), rng.random() < 0.5)
                     for _ in range(rng.randint(1, 8))] for _ in range(150)]
    vocab = merges.merge_vocab(spark, merges.chained(LEXICON))
    encoder = merges.Encoder(merges.Tokens.read(vocab))
    encode = lambda text: encoder.ids(encoder.words(text))
    out = merges.encode_merges(_examples(spark, rows), vocab)
    assert "Exchange" not in merges.encode_merges(_examples(spark, rows).coalesce(1), vocab)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.example_id: (list(r.ids), list(r["mask"])) for r in out.collect()}
    assert got == {i: by_the_rule(encode, segs, t.EOS_ID) for i, segs in enumerate(rows)}
    whole = {r.example_id: r.text for r in merges.decode_merges(out, vocab).collect()}
    assert whole == {i: "".join(x or "" for x, _ in segs) for i, segs in enumerate(rows)}


def test_a_tokenizer_file_encodes_as_its_library(spark):
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    tok = library.Tokenizer.from_file(path)
    encode = lambda text: tok.encode(text, add_special_tokens=False).ids
    rng = random.Random(8)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect() if r.text]
    rows = [[(d[:k], False), (d[k:], True)] for d in docs for k in (rng.randint(0, len(d)),)]
    rows += [[("don't", False), (" we'll\n\n", True), ("  x", False)], [("<|endoftext|>a", True), ("<|end", False), ("oftext|>", True)]]
    out = merges.encode_merges(_examples(spark, rows), read_tokens(spark, path), words=GPT, eos_id=50256)
    got = {r.example_id: (list(r.ids), list(r["mask"])) for r in out.collect()}
    for i, segs in enumerate(rows):
        assert got[i] == by_the_rule(encode, segs, 50256), segs


def test_faults_in_token_tables_are_told(spark):
    with pytest.raises(ValueError, match="no earlier one"):
        merges.merge_vocab(spark, [(b"ab", b"c")])
    with pytest.raises(ValueError, match="come back whole"):
        merges.Tokens.read(merges.merge_vocab(spark, []).filter("id <> 100"))
    vocab = merges.merge_vocab(spark, [])
    assert merges.encode_merges(_examples(spark, []), vocab).collect() == []
