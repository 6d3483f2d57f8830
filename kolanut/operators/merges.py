"""R9 with sub-words: byte-level merges by rank, looked up per Arrow batch with the examples in place.

A token table has one row per token: ``id``, ``bytes``, ``rank`` with ``left`` and ``right`` for a merged token, and
``marker`` for one that stands whole in the text. ``merge_vocab`` makes one from a list of merges, ``readers.read_tokens`` from a
tokenizer file; nothing is learned here. The table is bounded (checked) and travels with the function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kolanut import tables as t
from kolanut.operators.packing import BYTE_ID, FIRST_ID, MARKER_ID, MARKERS, MOST_PIECES

TOKENS = "id INT, bytes BINARY, rank INT, left BINARY, right BINARY, marker BOOLEAN"
#: Words that merges stay within: letters, up to three digits or other signs, each with the blank before it, or blanks.
WORDS = r" ?\p{L}+| ?\p{N}{1,3}| ?[^ \p{L}\p{N}]+| +"
#: Letters before a segment edge within which the words may still change.
EDGE = 32
MAX_WORDS = 200_000


def chained(words: Iterable[str]) -> list[tuple[bytes, bytes]]:
    """Merges that put each word together from its left end, in the order of the words."""
    out = {}
    for word in words:
        data = word.encode()
        out |= {(data[:k], data[k:k + 1]): None for k in range(1, len(data))}
    return list(out)


def merge_vocab(spark: SparkSession, merges: Sequence[tuple[bytes, bytes]]) -> DataFrame:
    """A token table: markers and bytes at their fixed ids, then the merges in their order."""
    made = {bytes([b]) for b in range(256)}
    rows = [(MARKER_ID + i, m.encode(), None, None, None, True) for i, m in enumerate(MARKERS)]
    rows += [(BYTE_ID + b, bytes([b]), None, None, None, False) for b in range(256)]
    for rank, (left, right) in enumerate(merges):
        if left not in made or right not in made:
            raise ValueError(f"merge {rank} joins a token that no earlier one makes")
        made.add(left + right)
        rows.append((FIRST_ID + rank, left + right, rank, left, right, False))
    return spark.createDataFrame(rows, TOKENS)


class Tokens(NamedTuple):
    """A token table as lookups, and the pattern of the words."""

    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    markers: dict[str, int]
    words: str

    @classmethod
    def read(cls, tokens: DataFrame, words: str = WORDS) -> Tokens:
        rows = tokens.limit(MOST_PIECES + 1).collect()
        if len(rows) > MOST_PIECES:
            raise ValueError(f"a token table holds at most {MOST_PIECES} rows")
        plain = {bytes(r["bytes"]): r["id"] for r in rows if not r["marker"]}
        missing = [b for b in range(256) if bytes([b]) not in plain]
        if missing:
            raise ValueError(f"no token for the byte {missing[0]}: texts would not come back whole")
        ranks = {(bytes(r["left"]), bytes(r["right"])): r["rank"] for r in rows if r["rank"] is not None}
        return cls(plain, ranks, {bytes(r["bytes"]).decode(): r["id"] for r in rows if r["marker"]}, words)


class Encoder:
    """Texts to ids; the ids of the words met are kept up to a bound."""

    def __init__(self, tokens: Tokens):
        import regex
        self.tokens = tokens
        self.pattern = regex.compile(tokens.words)
        self.marked = regex.compile("(" + "|".join(regex.escape(m) for m in sorted(tokens.markers, key=len, reverse=True)) + ")") if tokens.markers else None
        self.known: dict[str, list[int]] = {}

    def _merged(self, data: bytes) -> list[int]:
        """The pair of least rank is merged first, the leftmost of equals, until none is left."""
        ranks, ids = self.tokens.ranks, self.tokens.ids
        parts: list[bytes | None] = [data[i:i + 1] for i in range(len(data))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        heapify(waiting)
        while waiting:
            _, i, left, right = heappop(waiting)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < len(parts) and (pair := (parts[k], parts[m])) in ranks:
                    heappush(waiting, (ranks[pair], k, *pair))
        return [ids[p] for p in parts if p is not None]

    def words(self, text: str) -> list[str]:
        """Markers and words, one behind the other."""
        if self.marked is None:
            return self.pattern.findall(text)
        out = []
        for k, part in enumerate(self.marked.split(text)):
            out += [part] if k % 2 else self.pattern.findall(part)
        return out

    def ids(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for word in words:
            known = self.known.get(word)
            if known is None:
                if len(self.known) > MAX_WORDS:
                    self.known.clear()
                marker = self.tokens.markers.get(word)
                known = self._merged(word.encode()) if marker is None else [marker]
                if len(word) <= 64:
                    self.known[word] = known
            out += known
        return out

    def segments(self, parts: Iterable[tuple[str, bool]]) -> tuple[list[int], list[int]]:
        """Ids and mask of consecutive segments.

        A segment is read behind the text before it where that leaves the earlier ids as they were, and by itself where it
        does not. Only the last words before the edge are read again, so the work is linear in the text.
        """
        ids, mask, last = [], [], []
        for text, train in parts:
            base, whole = self.ids(last), self.words("".join(last) + text)
            new = self.ids(whole)
            new = new[len(base):] if new[:len(base)] == base else self.ids(self.words(text))
            ids += new
            mask += [int(train)] * len(new)
            held, k = 0, len(whole)
            while k and held < EDGE:
                k -= 1
                held += len(whole[k])
            last = whole[k:]
        return ids, mask


def encode_merges(df: DataFrame, tokens: DataFrame, key: str | Sequence[str] = "example_id", segments: str = "segments",
                  eos_id: int = t.EOS_ID, words: str = WORDS) -> DataFrame:
    """(key, ids, mask) of each example's segments (``text``, ``train``), ended by eos with mask 1.

    Examples stay where they are: one pass over Arrow batches, no shuffle and no row per token. A null text is empty; an example
    without segments is its eos alone.
    """
    keys = [key] if isinstance(key, str) else list(key)
    held = Tokens.read(tokens, words)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held)
        for batch in batches:
            done = [encoder.segments((s["text"] or "", s["train"]) for s in parts or ()) for parts in batch.column(segments).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array([ids + [eos_id] for ids, _ in done], pa.list_(pa.int32())),
                 pa.array([mask + [1] for _, mask in done], pa.list_(pa.int8()))], [*keys, "ids", "mask"])

    told = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, segments).mapInArrow(coded, f"{told}, ids ARRAY<INT>, mask ARRAY<TINYINT>")


def decode_merges(df: DataFrame, tokens: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, text) from ids; ids without a token, such as eos, spell nothing."""
    spelled = {r["id"]: bytes(r["bytes"]) for r in tokens.limit(MOST_PIECES).collect()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(spelled.get(i, b"") for i in ids).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, "ids").mapInArrow(read, f"`{key}` {df.schema[key].dataType.simpleString()}, text STRING")
