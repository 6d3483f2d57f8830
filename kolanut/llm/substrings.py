"""Removal of long word runs that an earlier document holds, found by difference-cover anchors.

Two equal runs of 13 words may start at any places of their texts. Of the residues {0, 1, 3} modulo 7 every difference
occurs, so within the first seven words of the two runs one common offset leads to places in both texts
whose residues are in that cover. Hashing the 7 words behind cover places only (three of seven) therefore gives any two
equal runs a common anchor at the same offset. Anchors held by several documents are extended to the
runs of 13 words around them; of each such run the smallest document keeps its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolanut.llm import packed
from kolanut.llm.words import WordHash, mixed, raw, row_of, separators, slices, spans, windows

RUN = 13
PERIOD = 7
COVER = (0, 1, 3)
#: Anchors only lead to runs, so 48 bits do; runs are told apart by 64 + 32 bits.
ANCHOR_BITS, RUN_BITS = np.uint64((1 << 48) - 1), np.uint64((1 << 32) - 1)


def cover_ok(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Texts:
    """Words, word hashes and anchors of batches of texts."""

    def __init__(self, run: int, period: int, cover: tuple[int, ...]):
        self.table, self.hash = separators(), WordHash()
        self.run, self.anchor = run, run - period + 1
        self.in_cover = np.zeros(period, bool)
        self.in_cover[list(cover)] = True
        self.period = period

    def read(self, texts: pa.Array):
        data, at = raw(texts)
        starts, ends, first = spans(data, at, self.table)
        return data, starts, ends, first

    def anchors(self, hashes: np.ndarray, first: np.ndarray):
        """Hash, row and word place in the row of each anchor."""
        found, at = windows(hashes, first, self.anchor, salt=1)
        found = found & ANCHOR_BITS
        row = row_of(at)
        place = np.arange(len(found)) - at[row]
        kept = self.in_cover[place % self.period]
        return found[kept], row[kept], place[kept]

    def runs(self, hashes: np.ndarray, first: np.ndarray):
        lo, at = windows(hashes, first, self.run, salt=2)
        return lo, windows(hashes, first, self.run, salt=3)[0] & RUN_BITS, at


def _owners(batch: pa.RecordBatch, key: str) -> np.ndarray:
    return batch.column(key).cast(pa.int64()).to_numpy(zero_copy_only=False)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, period: int = PERIOD,
                   cover: tuple[int, ...] = COVER) -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by one space.

    A word goes if a run of ``run`` words over it also starts in a document of a smaller key; runs are judged on
    the input. Null and empty texts have no words. Rows without a key neither lose words nor take others' words;
    rows repeated under one key do not count as earlier than each other. Runs are compared by 96-bit hashes.
    Text is shuffled once, by key; the two joins with what was found use that one exchange.
    """
    if not cover_ok(period, cover) or run < period:
        raise ValueError("the cover must hold every difference modulo the period, and a run at least one period")
    # an alias of the same name would tell the two exchanges of the text apart, and both would be made
    all_docs = docs.select(F.col(key).cast("bigint").alias("owner_id"), F.col(text) if text == "text" else F.col(text).alias("text"))
    named = all_docs.filter(F.col("owner_id").isNotNull())

    def reader() -> _Texts:
        return _Texts(run, period, cover)

    def anchor_keys(batch: pa.RecordBatch, texts: _Texts) -> Iterator:
        data, starts, ends, first = texts.read(batch.column("text"))
        found, row, _ = texts.anchors(texts.hash(data, starts, ends), first)
        yield _owners(batch, "owner_id")[row], found, found[:0]

    def run_keys(batch: pa.RecordBatch, texts: _Texts) -> Iterator:
        data, starts, ends, first = texts.read(batch.column("text"))
        hashes = texts.hash(data, starts, ends)
        found, row, place = texts.anchors(hashes, first)
        hit = np.isin(found, packed.unpacked(batch.column("found")))
        # anchors within the first `period` words of each run
        marks = np.zeros(len(hashes) + 1, np.int64)
        marks[1:][first[row[hit]] + place[hit]] = 1
        before = np.cumsum(marks)
        lo, hi, at = texts.runs(hashes, first)
        row = row_of(at)
        begin = first[row] + np.arange(len(lo)) - at[row]
        near = before[begin + period] > before[begin]
        yield _owners(batch, "owner_id")[row[near]], lo[near], hi[near]

    shared = packed.find(named, reader, anchor_keys, packed.SHARED, widths=(6, 8))
    suspects = named.join(shared, named["owner_id"] == shared["owner"]).select("owner_id", "text", "found")
    later = packed.find(suspects, reader, run_keys, packed.LATER, widths=(8, 4))
    judged = named.join(later, named["owner_id"] == later["owner"], "left").select("owner_id", "text", "found")
    judged = judged.unionByName(all_docs.filter(F.col("owner_id").isNull()).withColumn("found", F.lit(None).cast("binary")))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(run, period, cover)
        for batch in batches:
            for piece in slices(batch, "text"):
                yield _kept(piece, texts)

    out = judged.mapInArrow(kept, "owner_id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("owner_id", key)


def _kept(batch: pa.RecordBatch, texts: _Texts) -> pa.RecordBatch:
    data, starts, ends, first = texts.read(batch.column("text"))
    gone = np.zeros(len(starts), bool)
    found = batch.column("found")
    if found.null_count < len(found):
        hashes = texts.hash(data, starts, ends)
        lo, _, at = texts.runs(hashes, first)
        row = row_of(at)
        own = 0x9E3779B97F4A7C15
        lists = [np.frombuffer(x, np.uint64) if x else np.zeros(0, np.uint64) for x in found.to_pylist()]
        wanted = np.concatenate([mixed(x + np.uint64((i + 1) * own & (1 << 64) - 1)) for i, x in enumerate(lists)])
        hit = np.isin(mixed(lo + (row + 1).astype(np.uint64) * np.uint64(own)), wanted)
        begin = (first[row] + np.arange(len(lo)) - at[row])[hit]
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + texts.run, -1)
        gone = np.cumsum(edges[:-1]) > 0
    s, e = starts[~gone], ends[~gone]
    before = np.concatenate(([0], np.cumsum(~gone)))[first]
    sizes = e - s + 1
    last = before[1:][before[1:] > before[:-1]] - 1
    sizes[last] -= 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    letters = np.concatenate((data, [np.uint8(0x20)]))[np.arange(at[-1]) + np.repeat(s - at[:-1], sizes)]
    gaps = np.ones(len(sizes), bool)
    gaps[last] = False
    letters[at[1:][gaps] - 1] = 0x20
    kept = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(at[before].astype(np.int64)), pa.py_buffer(letters))
    n = np.diff(first)
    return pa.RecordBatch.from_arrays(
        [batch.column("owner_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(before), pa.int64()), kept.cast(pa.string())],
        ["owner_id", "n_words", "n_removed", "kept"])
