"""Tokenizer alignment against both libraries on whole texts and a plain walk over byte offsets."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frames import documents, odd_rows, prose
from kolanut.llm import alignment
from kolanut.llm.shared import as_table

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def specs():
    return alignment.read_specs(A_PATH, B_PATH)


class Plain:
    """Tokens, groups and links of one text by the libraries and byte offsets alone."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        printable = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
        others = [b for b in range(256) if b not in printable]
        self.letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}

    def piece(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.piece(i)) for i in self.b.encode(text)]
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return [], []
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        a, b = spans
        shared = {t[2] for t in a} & {t[2] for t in b}
        runs = []
        for tokens in (a, b):
            out = [[]]
            for i, _, e in tokens:
                out[-1].append(i)
                out += [[]] if e in shared else []
            runs.append(out[:-1])
        groups, links, j = list(zip(*runs)), [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        return groups, links


def brute(rows):
    """[(doc_id, text)] -> sorted (doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum)."""
    plain = Plain()
    met = [(d, *plain(t)) for d, t in rows]
    count = Counter(link for _, _, links in met for link in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    told = lambda ids: ",".join(map(str, ids))
    return sorted(((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), ";".join(f"{told(x)}|{told(y)}" for x, y in g),
                    sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)) for d, g, links in met), key=str)


def _got(spark, specs, docs, chunk):
    out = alignment.supported(alignment.align(docs, specs, chunk=chunk))
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in out.collect()), key=str)


ODD = ["a", " a", "a ", "  ", " ", "a  b", "a\n b", "a \n b\t", "\n\n x", "don't  we'll", "x  y", "x\u0085 y", "a▁b", "▁", "▁ ▁", "<s> </s> <unk>",
       "<|endoftext|> a<|endoftext|>", "<0x41>", "a\x00b", "漢字かな交じり文" * 9, "😀 😀👍🏽", "é é", "a" * 500, "1234567 89", "naïve—“quoted”",
       "x\x1c y", "﻿bom", "word " * 40, "ﬁ ligature", "… … ..."]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_alignment_matches_the_libraries(spark, specs, chunk):
    rng = random.Random(chunk)
    mixed = ["".join(rng.choice(["a", "b ", " ", "é", "\n", "the ", "ing", "漢", "9", "'s ", "…"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(ODD + mixed)]
    assert _got(spark, specs, documents(spark, rows), chunk) == brute(rows)


def test_odd_rows_and_clashing_names(spark, specs):
    rows = [(r[0], r[1]) for r in odd_rows(random.Random(1))]
    docs = documents(spark, rows)
    for name in ("_row", "_key", "groups", "n_a", "part", "pairs"):
        docs = docs.withColumn(name, docs["doc_id"])
    assert _got(spark, specs, docs, 4096) == brute(rows)
    assert _got(spark, specs, docs.limit(0), 4096) == []


def test_hot_words_and_parts(spark, specs, monkeypatch):
    """A word that most texts hold is asked for once per part; parts of few links give the same counts."""
    monkeypatch.setattr(alignment, "PART_LINKS", 20)
    rng = random.Random(9)
    rows = [(i, "the same words " * 3 + prose(rng, 5)) for i in range(80)]
    assert _got(spark, specs, documents(spark, rows), 40) == brute(rows)


def test_fragments_compose_associatively(specs):
    rng = random.Random(3)
    aligner = alignment.Aligner(specs)
    text = " " + "".join(rng.choice(["ab", " ", "the", " x", "é "]) for _ in range(80))

    def fragment(lo, hi):
        return alignment.fragment_of(text[lo:hi], lo == 0, aligner)

    def told(f):
        return f[0], f[1][0].tolist(), f[1][1], f[1][2].tolist(), f[1][3].tolist(), f[2]

    for _ in range(20):
        cuts = sorted(rng.sample(range(1, len(text)), 3))
        parts = [fragment(lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(text)])]
        left = alignment.compose([alignment.compose(parts[:2], aligner), *parts[2:]], aligner)
        right = alignment.compose([parts[0], alignment.compose(parts[1:], aligner)], aligner)
        assert told(left) == told(right)


def test_short_texts_are_aligned_in_steps(specs, monkeypatch):
    """However many rows a batch holds, a bounded number of bytes is worked on at once, with the same result."""
    rng = random.Random(5)
    texts = [None, "", *(prose(rng, rng.randint(1, 30)) for _ in range(60)), "long " * 100, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["_key", "_text"])
    told = lambda: [r for out in alignment._short(iter([batch]), specs) for r in out.to_pylist()]
    whole, met = told(), []
    closed = alignment.Aligner.closed
    monkeypatch.setattr(alignment.Aligner, "closed", lambda self, lists: met.append(sum(len(w) + 1 for words in lists for w in words)) or closed(self, lists))
    monkeypatch.setattr(alignment, "STEP_BYTES", 300)
    assert told() == whole and len(whole) == len(texts)
    assert sorted(met)[-2] <= 300 < sorted(met)[-1] == 501


def test_large_rows_are_written_in_small_row_groups(spark):
    rows = spark.range(40, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.xxhash64("id", i)).alias("x"))
    table = as_table(rows, "large", 1 << 20)
    file = pq.ParquetFile(table.inputFiles()[0].removeprefix("file:"))
    assert file.num_row_groups >= 5 and table.select("id", "x").exceptAll(rows).count() == 0 and table.count() == 40
