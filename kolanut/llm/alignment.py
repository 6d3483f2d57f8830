"""Alignment of two tokenizers over the same bytes.

Both read a blank and the text behind it. A blank behind another sign starts a new word for either (no piece and no match of the
byte-level pattern goes on over it), so a text is the sequence of its words and every word's tokens cover the same bytes: words
are encoded and aligned once, when first met, and looked up afterwards.

A byte range of a text is a fragment: an open prefix (up to its first word start), the closed groups of its whole words, and an open
suffix (from its last word start). Fragments compose associatively: the suffix of one and the prefix of the next become words, whose
groups are closed between those of the two. The ranges of a long text are read in tasks of their own and composed as a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolanut.llm.shared import as_table, written

#: Bytes of a text that one task reads at once.
CHUNK = 1 << 16
#: Fragments that one composition takes.
FAN = 8
#: Words remembered by a task; beyond, the table is made anew.
MAX_WORDS = 200_000
#: New words that are encoded as one text.
BLOCK = 512
#: Bytes of short texts that a task works on at once, whatever rows a batch holds.
STEP_BYTES = 1 << 20
#: Link entries of one part, the unit in which documents ask for the counts of their links.
PART_LINKS = 1 << 19
#: Encoded bytes of a row group of written links; a reader's column vectors hold a row group's rows, up to thousands, at once.
GROUP_BYTES = 1 << 24
MARK = "▁"
_BORDER = re.compile(r"(?<=\S)(?= )")
_UNEVEN = re.compile(r"\s ")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_TOLD = [("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups", "string"),
         ("link_a", "array<int>"), ("link_b", "array<int>"), ("link_n", "array<bigint>")]


def words_of(spaced: str) -> list[str]:
    """The words of a text that starts with a blank, each without the blank before it."""
    if _UNEVEN.search(spaced) is None:
        return spaced.split(" ")[1:]
    return [w[1:] for w in _BORDER.split(spaced)]


class Closed(NamedTuple):
    """Closed groups of several texts: counts (rows of A tokens, B tokens, groups, links), groups as text, and the distinct links
    (``owner``: number of the text) with their times."""

    counts: np.ndarray
    groups: pa.Array
    owner: np.ndarray
    links: np.ndarray
    times: np.ndarray
    differs: np.ndarray

    def columns(self) -> list[pa.Array]:
        """The columns of ``_TOLD``."""
        at = pa.array(np.searchsorted(self.owner, np.arange(len(self.counts) + 1)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in (
            (self.links >> 32, pa.int32()), (self.links & 0xFFFFFFFF, pa.int32()), (self.times, pa.int64())))
        return [*(pa.array(self.counts[:, k]) for k in range(4)), self.groups.cast(pa.string()), *lists]

    def run(self) -> tuple | None:
        """The first text as a closed run: (counts, groups, links, times); None where its bytes differ."""
        return None if self.differs[0] else (self.counts[0], self.groups[0].as_py(), self.links, self.times)


class ByteLevel:
    """Token bytes of a byte-level vocabulary, in which every byte is written as a printable letter."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(spec)
        self.model.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.bytes = [b""] * self.model.get_vocab_size()
        for entry, i in self.model.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()

    def encode(self, spaced: str) -> list[int]:
        return self.model.encode(spaced, add_special_tokens=False).ids


class Pieces:
    """Token bytes of a piece model, which puts the blank before a word itself."""

    def __init__(self, spec: bytes):
        import sentencepiece
        self.model = sp = sentencepiece.SentencePieceProcessor(model_proto=spec)
        self.bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
                      for i in range(sp.get_piece_size())]
        self.blank = [sp.piece_to_id(MARK)]

    def encode(self, spaced: str) -> list[int]:
        return self.model.encode(spaced[1:], num_threads=1) if len(spaced) > 1 else self.blank


def _grouped(texts: pa.Array, bounds: np.ndarray, sign: str) -> pa.Array:
    """Texts joined by ``sign`` within consecutive runs."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts), pa.scalar(sign, texts.type))


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of consecutive runs, one behind the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _summed(owner: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times summed by owner and pair, in that order."""
    order = np.lexsort((pairs, owner))
    owner, pairs, times = owner[order], pairs[order], times[order]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(pairs, prepend=-1) != 0))
    return owner[first], pairs[first], np.add.reduceat(times, first) if len(first) else times


class Aligner:
    """Words with their tokens, groups and links, remembered up to a bound."""

    def __init__(self, specs: tuple[str, bytes]):
        self.a, self.b = ByteLevel(specs[0]), Pieces(specs[1])
        self.size_a, self.size_b = (np.array([len(t) for t in m.bytes], dtype=np.int64) for m in (self.a, self.b))
        self.names = pa.array([str(i) for i in range(max(len(self.a.bytes), len(self.b.bytes)))], pa.large_string())
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts = pa.array([], pa.large_string())
        #: Columns: tokens of A, tokens of B, groups, links, where the links start, whether the bytes differ.
        self.facts = np.zeros((0, 6), dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)

    def _encoded(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of consecutive words and how many each word has, in blocks. Words are encoded as one text; where a block is not
        given back byte for byte it is halved, and a word that is not given back by itself has no tokens."""
        sizes = np.array([len(w.encode()) + 1 for w in words], dtype=np.int64)
        spaced = " " + " ".join(words)
        data, told, ends = spaced.encode(), [], np.cumsum(sizes)
        for model, size in ((self.a, self.size_a), (self.b, self.size_b)):
            ids = model.encode(spaced)
            at = np.cumsum(size[ids]) if ids else np.zeros(0, dtype=np.int64)
            cut = np.searchsorted(at, ends)
            if b"".join([model.bytes[i] for i in ids]) != data or (at[cut] != ends).any():
                if len(words) == 1:
                    return [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(1, dtype=np.int64),) * 2]
                half = len(words) // 2
                return self._encoded(words[:half]) + self._encoded(words[half:])
            told.append((np.array(ids, dtype=np.int64), np.diff(cut + 1, prepend=0)))
        (a, n_a), (b, n_b) = told
        return [(a, b, n_a, n_b)]

    def learn(self, words: list[str]) -> None:
        """Encode and align words not met before, all in one stream of bytes."""
        alone = [w for w in words if not w or w[-1].isspace()]
        words = [w for w in words if w and not w[-1].isspace()]
        blocks = [x for w in alone for x in self._encoded([w])]
        for i in range(0, len(words), BLOCK):
            blocks += self._encoded(words[i:i + BLOCK])
        a, b, n_a, n_b = (np.concatenate(x) for x in zip(*blocks))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cut_a, cut_b = (np.flatnonzero(np.isin(x, y, assume_unique=True)) + 1 for x, y in ((end_a, end_b), (end_b, end_a)))
        first = np.searchsorted(end_b, end_a - self.size_a[a], side="right")
        n = np.searchsorted(end_b - self.size_b[b], end_a, side="left") - first
        links = (np.repeat(a, n) << 32) | b[_spread(first, n)]
        bounds_a = _bounds(n_a)
        of_group, of_links = np.searchsorted(cut_a, bounds_a, side="right"), _bounds(n)[bounds_a]
        groups = pc.binary_join_element_wise(_grouped(self.names.take(pa.array(a)), np.concatenate([[0], cut_a]), ","),
                                             _grouped(self.names.take(pa.array(b)), np.concatenate([[0], cut_b]), ","),
                                             pa.scalar("|", pa.large_string()))
        facts = np.stack([n_a, n_b, np.diff(of_group), np.diff(of_links), len(self.links) + of_links[:-1], n_a == 0], axis=1)
        self.known.update(zip(alone + words, range(len(self.texts), len(self.texts) + len(n_a))))
        self.texts = pa.concat_arrays([self.texts, _grouped(groups, of_group, ";")])
        self.facts, self.links = np.concatenate([self.facts, facts]), np.concatenate([self.links, links])

    def closed(self, lists: list[list[str]]) -> Closed:
        """Whole words of several texts. A text of which a word's bytes differ has nothing."""
        if len(self.known) > MAX_WORDS:
            self._clear()
        new = {w for words in lists for w in words if w not in self.known}
        if new:
            self.learn(sorted(new))
        known = self.known
        ids = np.array([known[w] for words in lists for w in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(words) for words in lists])
        differs = np.zeros(len(lists), dtype=bool)
        differs[owner[self.facts[ids, 5] > 0]] = True
        ids, owner = ids[~differs[owner]], owner[~differs[owner]]
        counts = np.zeros((len(lists), 4), dtype=np.int64)
        np.add.at(counts, owner, self.facts[ids, :4])
        groups = _grouped(self.texts.take(pa.array(ids)), _bounds(np.bincount(owner, minlength=len(lists))), ";")
        of, met, times = _summed(owner, ids, np.ones(len(ids), dtype=np.int64))
        n = self.facts[met, 3]
        links = self.links[_spread(self.facts[met, 4], n)]
        return Closed(counts, groups, *_summed(np.repeat(of, n), links, np.repeat(times, n)), differs)


_MADE: dict[int, Aligner] = {}


def _aligner(specs: tuple[str, bytes]) -> Aligner:
    """The aligner of a task, made when first asked for."""
    name = hash(specs)
    if name not in _MADE:
        _MADE[name] = Aligner(specs)
    return _MADE[name]


_NOTHING = (np.zeros(4, dtype=np.int64), "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _joined(parts: list[tuple | None]) -> tuple | None:
    """Closed runs of words one behind the other."""
    if any(p is None for p in parts):
        return None
    counts = np.sum([p[0] for p in parts], axis=0)
    return counts, ";".join(p[1] for p in parts if p[1]), *_summed(
        np.zeros(sum(len(p[2]) for p in parts), dtype=np.int64), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))[1:]


def fragment_of(text: str, first: bool, aligner: Aligner) -> tuple:
    """(prefix, closed, suffix) of a range of a text; ``suffix`` is None where no word starts in it."""
    runs = _BORDER.split(text)
    prefix = "" if first else runs.pop(0)
    return prefix, aligner.closed([[w[1:] for w in runs[:-1]]]).run(), runs[-1] if runs else None


def compose(fragments: list[tuple], aligner: Aligner) -> tuple:
    """One fragment of consecutive ones."""
    prefix, runs, suffix = fragments[0][0], [fragments[0][1]], fragments[0][2]
    for before, closed, behind in fragments[1:]:
        if suffix is None:
            prefix, suffix = prefix + before, behind
            runs = [closed]
        elif behind is None:
            suffix += before
        else:
            runs += [aligner.closed([words_of(suffix + before)]).run(), closed]
            suffix = behind
    return prefix, _joined(runs), suffix


def _told(run: tuple | None) -> list[pa.Array]:
    """The columns of ``_TOLD`` of one text; one whose bytes differ tells the same as an empty one."""
    counts, groups, links, times = run or _NOTHING
    return Closed(counts.reshape(1, 4), pa.array([groups]), np.zeros(len(links), dtype=np.int64), links, times, np.zeros(1, dtype=bool)).columns()


def _steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows, from and to, whose sizes add up to ``most`` at most; a larger row is by itself."""
    ends, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _lean(batches: Iterator[pa.RecordBatch], sizes, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into steps. What Arrow took for a step goes back after it, and a batch before the next one is read."""
    for whole in batches:
        for lo, hi in _steps(sizes(whole), most):
            yield whole.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()
        del whole


def _lengths(column: str):
    """The sizes of a column's texts or lists, with one for the row; a null is empty."""
    def sizes(batch: pa.RecordBatch) -> np.ndarray:
        values = batch.column(column)
        long = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        return pc.fill_null(long, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return sizes


def _short(batches: Iterator[pa.RecordBatch], specs: tuple) -> Iterator[pa.RecordBatch]:
    for batch in _lean(batches, _lengths("_text"), STEP_BYTES):
        closed = _aligner(specs).closed([words_of(" " + t) if t else [] for t in batch.column("_text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("_key"), *closed.columns()], ["_key", *(n for n, _ in _TOLD)])
        del batch, closed


def _ranges(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of long texts, cut between letters."""
    for batch in _lean(batches, _lengths("_text"), STEP_BYTES):
        for k in range(batch.num_rows):
            own = batch.slice(k, 1)
            data = (" " + own.column("_text")[0].as_py()).encode()
            cuts = [0]
            while len(data) - cuts[-1] > chunk:
                cut = cuts[-1] + chunk
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
                cuts.append(cut)
            cuts.append(len(data))
            for i, (lo, hi) in enumerate(pairwise(cuts)):
                yield pa.RecordBatch.from_arrays([own.column("_key"), own.column("_row"), pa.array([i], pa.int64()),
                                                  pa.array([data[lo:hi].decode()], pa.string())], ["_key", "_row", "_at", "_bytes"])


_FRAGMENT = [("_row", "bigint"), ("_at", "bigint"), ("_prefix", "string"), ("_suffix", "string"), ("_differs", "boolean"), *_TOLD]


def _as_row(key: pa.Array, row: int, at: int, fragment: tuple) -> list[pa.Array]:
    prefix, closed, suffix = fragment
    return [key, pa.array([row], pa.int64()), pa.array([at], pa.int64()), pa.array([prefix], pa.string()), pa.array([suffix], pa.string()),
            pa.array([closed is None]), *_told(closed)]


def _fragments(batches: Iterator[pa.RecordBatch], specs: tuple) -> Iterator[pa.RecordBatch]:
    for batch in _lean(batches, _lengths("_bytes"), STEP_BYTES):
        for k, row in enumerate(batch.drop_columns(["_key"]).to_pylist()):
            fragment = fragment_of(row["_bytes"], row["_at"] == 0, _aligner(specs))
            yield pa.RecordBatch.from_arrays(_as_row(batch.column("_key").slice(k, 1), row["_row"], row["_at"], fragment),
                                             ["_key", *(n for n, _ in _FRAGMENT)])


def _composed(table: pa.Table, specs: tuple) -> pa.Table:
    rows = table.sort_by("_at")
    parts = [_read(rows, k) for k in range(rows.num_rows)]
    out = parts[0] if len(parts) == 1 else compose(parts, _aligner(specs))
    key = table.column("_key").combine_chunks().slice(0, 1)
    return pa.Table.from_arrays(_as_row(key, rows["_row"][0].as_py(), rows["_at"][0].as_py() // FAN, out), ["_key", *(n for n, _ in _FRAGMENT)])


def _read(rows: pa.RecordBatch | pa.Table, k: int) -> tuple:
    """A row as a fragment; its lists are read as arrays, as a number for each entry would take many times their memory."""
    prefix, suffix, groups = (rows[c][k].as_py() for c in ("_prefix", "_suffix", "groups"))
    if rows["_differs"][k].as_py():
        return prefix, None, suffix
    a, b, n = (rows[c][k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("link_a", "link_b", "link_n"))
    return prefix, (np.array([rows[c][k].as_py() for c in _COUNTS], dtype=np.int64), groups, (a << 32) | b, n), suffix


def _ended(batches: Iterator[pa.RecordBatch], specs: tuple) -> Iterator[pa.RecordBatch]:
    """Whole texts: the last word ends with the text."""
    for batch in _lean(batches, _lengths("groups"), STEP_BYTES):
        for k in range(batch.num_rows):
            _, closed, _ = compose([_read(batch, k), ("", _NOTHING, "")], _aligner(specs))
            yield pa.RecordBatch.from_arrays([batch.column("_key").slice(k, 1), *_told(closed)], ["_key", *(n for n, _ in _TOLD)])


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def read_specs(a_path: str, b_path: str) -> tuple[str, bytes]:
    """The two vocabulary files; they travel with the functions (2 MB)."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def align(docs: DataFrame, specs: tuple[str, bytes], key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, groups, link_a, link_b, link_n``, one row per row of ``docs``.

    ``groups`` is the alignment, ``a1,a2|b1;a3|b2,b3``: runs of token ids between the byte offsets where tokens of both end. The three
    arrays hold the distinct linked id pairs and how often each is linked. Null and empty texts, and texts that either tokenizer does
    not give back byte for byte, have no tokens: zeros, an empty text and empty arrays. Repeated rows are aligned each. Other
    columns of ``docs`` are not read, so their names cannot clash. Texts up to ``chunk`` bytes are aligned where they are read;
    of longer ones the byte ranges are spread over tasks and their fragments composed, ``FAN`` at a time.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    long = F.coalesce(F.octet_length("_text"), F.lit(0)) > chunk
    key_type = rows.schema["_key"].dataType.simpleString()
    short = rows.filter(~long).mapInArrow(lambda batches: _short(batches, specs), f"_key {key_type}, {_ddl(_TOLD)}")

    named = rows.withColumn("_row", F.monotonically_increasing_id()).filter(long)
    ranges = named.mapInArrow(lambda batches: _ranges(batches, chunk), f"_key {key_type}, _row bigint, _at bigint, _bytes string")
    spread = ranges.repartition(F.col("_row"), F.col("_at"))
    fragment = f"_key {key_type}, {_ddl(_FRAGMENT)}"
    parts = written(spread.mapInArrow(lambda batches: _fragments(batches, specs), fragment))
    left = parts.agg(F.max("_at")).first()[0]
    if left is None:
        return short.withColumnRenamed("_key", key)
    while left > 0:
        parts = written(parts.groupBy("_row", F.floor(F.col("_at") / FAN).alias("_next")).applyInArrow(
            lambda table: _composed(table, specs), fragment))
        left //= FAN
    ended = parts.mapInArrow(lambda batches: _ended(batches, specs), f"_key {key_type}, {_ddl(_TOLD)}")
    return short.unionByName(ended).withColumnRenamed("_key", key)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts: rows with their links as numbers into one list of distinct pairs, each with its times over the part."""
    part = TaskContext.get().partitionId() << 32
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    for batch in _lean(batches, lambda whole: _lengths("link_n")(whole) - 1, PART_LINKS):
        a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("link_a", "link_b", "link_n"))
        pairs, number = np.unique((a << 32) | b, return_inverse=True)
        total = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(total, number, n)
        sizes = np.diff(batch.column("link_n").offsets.to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), one(pairs, pa.int64()), one(total, pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("_row")),
             one(sizes.astype(np.int32), pa.int32()), one(number.astype(np.int32), pa.int32()), one(n, pa.int64())],
            ["part", "pairs", "total", "rows", "sizes", "number", "times"])
        part += 1
        del batch, a, b, n, pairs, number, total, sizes


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _lean(batches, _lengths("number"), PART_LINKS):
        for k in range(batch.num_rows):
            rows = batch.column("rows")[k].values
            told = batch.column("answers")[k].values
            counts, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
            if told is not None and len(told):
                counts = told.field("n").to_numpy(zero_copy_only=False)
                best = told.field("best").to_numpy(zero_copy_only=False).astype(bool)
            sizes, number, times = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("sizes", "number", "times"))
            ends = np.cumsum(sizes, dtype=np.int64)
            sums = [np.concatenate([[0], np.cumsum(values)])[ends] - np.concatenate([[0], np.cumsum(values)])[ends - sizes]
                    for values in (times * best[number], times * counts[number])]
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(s.astype(np.int64)) for s in sums)], ["_row", "n_best", "count_sum"])


def supported(aligned: DataFrame) -> DataFrame:
    """The columns of ``aligned`` but its three arrays, with ``n_best`` (links whose pair is the most linked one of its B id in
    the whole frame, ties included) and ``count_sum`` (how often the pairs of its links are linked in the frame, summed over links).

    The frame is written first, so that aligning and packing do not share a task's memory. Documents are packed into parts; a part asks once for each distinct pair it holds, so the pairs shuffled are those of parts, not of
    documents. Counts are taken over all rows. Columns named ``n_best`` or ``count_sum`` already are replaced.
    """
    kept = [c for c in aligned.columns if c not in ("link_a", "link_b", "link_n", "n_best", "count_sum")]
    rows = as_table(aligned.select(F.struct(*kept).alias("_row"), "link_a", "link_b", "link_n"), "aligned", GROUP_BYTES)
    row_type = rows.schema["_row"].dataType.simpleString()
    parts = as_table(rows.mapInArrow(_packed, f"part bigint, pairs array<bigint>, total array<bigint>, rows array<{row_type}>, "
                                     "sizes array<int>, number array<int>, times array<bigint>"), "parts", GROUP_BYTES)
    asked = parts.select("part", F.explode(F.arrays_zip("pairs", "total")).alias("_ask")).select("part", "_ask.pairs", "_ask.total")
    counted = written(asked.groupBy("pairs").agg(F.sum("total").alias("n")))
    b = F.col("pairs").bitwiseAND(0xFFFFFFFF)
    most = counted.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    judged = counted.join(most, b == F.col("_b")).select(F.col("pairs").alias("_pair"), "n", (F.col("n") == F.col("_most")).alias("best"))
    answers = asked.join(judged, F.col("pairs") == F.col("_pair")).groupBy(F.col("part").alias("_part")).agg(
        F.sort_array(F.collect_list(F.struct("pairs", "n", "best"))).alias("answers"))
    met = parts.select("part", "rows", "sizes", "number", "times").join(answers, F.col("part") == F.col("_part"), "left")
    done = met.select("rows", "sizes", "number", "times", "answers").mapInArrow(_answered, f"_row {row_type}, n_best bigint, count_sum bigint")
    return done.select("_row.*", "n_best", "count_sum")
