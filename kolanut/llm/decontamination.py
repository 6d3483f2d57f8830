"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit checks.

Documents and benchmark items are sequences of words (ASCII lower-cased, cut at white space and punctuation; a character of a script without
spaces is a word). Items of few words are met by equal runs of words. For the others, the CGK
random walk reads a sequence with one fixed random bit per step and word: it writes the word it stands on and moves on by
that bit. Two sequences a few edits apart fall into step again, so their walks agree in most places (edit
distance becomes Hamming distance). Each repetition walks by other bits and samples a few steps; a window of a document whose
samples equal an item's is a candidate, and enough repetitions reach the target recall; how many is simulated at the edit limit. The
walks of long sequences drift apart, so items are searched by pieces of at most ``PIECE`` words: of a copy within the edit limit at least one
piece is within it too. Every start that a candidate allows is checked by exact word edit distance against the whole item.
Windows start at every word and are as long as the pieces, by classes of about equal length; one that shares too few word pairs with the
benchmark to be within the edit limit of any piece of its class is passed over, which loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolanut.llm.words import WordHash, characters, lower_table, mixed, raw, row_of, separators, slices, windows

#: Word edits allowed per word of an item.
EDITS = 0.15
#: Shorter items are met without edits only.
LEAST_WORDS = 8
RECALL = 0.99
#: Steps sampled per repetition.
SAMPLED = 2
#: Items of one pass over the documents; a larger benchmark takes several passes.
ITEMS = 20_000
#: Pieces of one class differ in length by this factor at most.
LENGTH_RATIO = 1.25
#: Words of a piece at most; a longer item is cut into pieces of about equal length.
PIECE = 32
#: Copies of a piece that are simulated to find the repetitions, and repetitions at most.
_COPIES = 2000
_MAX_REPEATS = 128


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many words changed, inserted or deleted at random."""
    out = words.tolist()
    for kind, at, new in zip(rng.integers(0, 3, edits), rng.random(edits), rng.integers(1, 1 << 62, edits), strict=True):
        j = int(at * len(out))
        out[j:j + 1] = [[], [out[j], new], [new]][kind]
    return np.array(out, np.uint64)


@lru_cache(maxsize=256)
def repetitions(length: int, edits: int, sampled: int, steps: int, recall: float) -> int:
    """Repetitions after which a piece of this length is met in a share ``recall`` of its copies with ``edits`` edits, by simulation.

    Only the copy's own start counts; those beside it are tried as well, so the search meets more.
    """
    rng = np.random.Generator(np.random.PCG64([23, length, edits]))
    whole = rng.integers(1, 1 << 62, (_COPIES, length)).astype(np.uint64)
    copies = [edited(w, edits, rng) for w in whole]
    sizes = np.array([len(c) for c in copies])
    end = np.cumsum(sizes)
    follow = rng.integers(1, 1 << 62, length).astype(np.uint64)  # the text goes on after the copy
    spread = np.concatenate([np.concatenate([c, follow]) for c in copies])
    begin = end - sizes + length * np.arange(_COPIES)
    first = np.arange(_COPIES) * length
    met = np.zeros(_COPIES, bool)
    for r, at in enumerate(sampled_steps(steps, sampled, _MAX_REPEATS)):
        met |= _walk(whole.ravel(), first, first + length, at, r) == _walk(spread, begin, begin + sizes + length, at, r)
        if met.mean() >= recall:
            return r + 1
    return _MAX_REPEATS


def sampled_steps(steps: int, sampled: int, repeats: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    return np.sort(np.stack([rng.choice(steps, sampled, replace=False) for _ in range(repeats)]), axis=1)


def _walk(words: np.ndarray, begin: np.ndarray, end: np.ndarray, stops: np.ndarray, repeat: int) -> np.ndarray:
    """One hash per start: the words that the CGK walk writes at the sampled steps of this repetition."""
    place = begin.copy()
    out = np.zeros(len(begin), np.uint64)
    step = 0
    for stop in stops:
        while True:
            inside = place < end
            word = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0))
            if step == stop:
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word)
            bit = mixed(word ^ np.uint64((repeat * 4096 + step + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)) >> np.uint64(63)
            place = place + bit.astype(np.int64)
            step += 1
            if step > stop:
                break
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int]:
    """The smallest number of word edits between ``a`` and a prefix of ``b``, and the length of that prefix.

    More than ``most``: (most + 1, 0).
    """
    n = len(b)
    places = np.arange(n + 1)
    row = places.copy()
    for i in range(len(a)):
        change = np.minimum(row[:-1] + (b != a[i]), row[1:] + 1)
        new = np.concatenate(([i + 1], change))
        row = np.minimum.accumulate(new - places) + places  # insertions run along the row
        if row.min() > most:
            return most + 1, 0
    k = int(np.lexsort((np.abs(places - len(a)), row))[0])
    return (int(row[k]), k) if row[k] <= most else (most + 1, 0)


def best_start(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """The first word of ``text`` from which the fewest word edits lead to the item, and their number; more than ``most``: (0, most + 1).

    One table for all starts: both are read backwards, and the reversed text may begin anywhere.
    """
    b = text[::-1]
    places = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for i, word in enumerate(item[::-1]):
        change = np.minimum(row[:-1] + (b != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([i + 1], change)) - places) + places
        if row.min() > most:
            return 0, most + 1
    least = int(row.min())
    return len(b) - int(np.flatnonzero(row == least)[-1]), least


@dataclass
class Items:
    """Pieces of about one length: words, the item each is of and where it begins there, allowed edits, and samples per repetition."""

    items: np.ndarray
    offsets: np.ndarray
    words: list[np.ndarray]
    edits: float
    sampled: int
    recall: float

    def __post_init__(self):
        sizes = np.array([len(w) for w in self.words])
        self.least = int(sizes.min())
        self.allowed = np.floor(sizes * self.edits + 1e-9).astype(int)
        # a window of `reach` words that starts a piece within its limit holds at least `fewest` of the benchmark's word pairs
        self.reach = int((sizes + self.allowed).max())
        self.fewest = max(1, int((sizes - 1 - 2 * self.allowed).min()))
        self.steps = 2 * self.least
        # pieces of every length in the class, each at its own limit
        self.repeats = max(repetitions(int(n), int(k), self.sampled, self.steps, self.recall) for n, k in {*zip(sizes.tolist(), self.allowed.tolist(), strict=True)})
        self.at = sampled_steps(self.steps, self.sampled, self.repeats)
        every = np.concatenate(self.words)
        begin = np.cumsum(sizes) - sizes
        self.samples = []
        for r in range(self.repeats):
            found = self.walk(every, begin, begin + sizes, r)
            order = np.argsort(found, kind="stable")
            self.samples.append((found[order], order))

    def walk(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, repeat: int) -> np.ndarray:
        return _walk(words, begin, end, self.at[repeat], repeat)

    def candidates(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pairs (start, item) that agree in the samples of some repetition; one row each."""
        out = []
        for r, (sorted_samples, order) in enumerate(self.samples):
            found = self.walk(words, begin, end, r)
            lo, hi = np.searchsorted(sorted_samples, found, "left"), np.searchsorted(sorted_samples, found, "right")
            n = hi - lo
            start = np.repeat(np.arange(len(begin)), n)
            item = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            out.append(np.unique(start * np.int64(len(self.words)) + item))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _pairs(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


@dataclass
class Benchmark:
    """The items of one pass, their pieces by length class, and the word pairs of all of them."""

    ids: np.ndarray
    words: list[np.ndarray]
    allowed: np.ndarray
    classes: list[Items]
    short: np.ndarray

    def __post_init__(self):
        self.exact = {}  # length of short items: sorted hashes and the items
        for n in np.unique([len(self.words[i]) for i in self.short.tolist()]).astype(int).tolist():
            items = np.array([i for i in self.short.tolist() if len(self.words[i]) == n])
            found = windows(np.concatenate([self.words[i] for i in items]), np.arange(len(items) + 1) * n, n)[0]
            order = np.argsort(found, kind="stable")
            self.exact[n] = found[order], items[order]
        self.pairs = np.unique(np.concatenate([_pairs(w) for w in self.words]))
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.pairs >> np.uint64(44)).astype(np.int64)] = True

    def equal(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Row, item and first word of the first run in each row that equals a short item."""
        for n, (hashes, items) in self.exact.items():
            found, at = windows(words, first, n)
            lo, hi = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                r = int(np.searchsorted(at, i, "right")) - 1
                for item in items[lo[i]:hi[i]].tolist():
                    if (words[first[r] + i - at[r]:][:n] == self.words[item]).all():
                        yield r, item, i - int(at[r])

    def known(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many of the word pairs before each word are pairs of the benchmark."""
        pairs = _pairs(words)
        maybe = self.near[(pairs >> np.uint64(44)).astype(np.int64)]
        known = np.zeros(len(words), np.int64)
        known[:-1][maybe] = np.isin(pairs[maybe], self.pairs)
        known[first[1:][first[1:] > 0] - 1] = 0  # no pair across rows
        return np.concatenate(([0], np.cumsum(known)))


def _merged(spots: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, first and last start, with the ranges of one row and item that touch made one."""
    if not spots:
        return
    every = np.concatenate(spots, axis=1)
    last: list[int] | None = None
    for r, item, lo, hi in every[:, np.lexsort(every[::-1])].T.tolist():
        if last is not None and last[:2] == [r, item] and lo <= last[3] + 1:
            last[3] = max(last[3], hi)
        else:
            if last is not None:
                yield tuple(last)
            last = [r, item, lo, hi]
    if last is not None:
        yield tuple(last)


def _hits(piece: pa.RecordBatch, benchmark: Benchmark, table: np.ndarray, hasher: WordHash) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item, first word, words and edits of the best window per row and item."""
    data, at = raw(piece.column("text"))
    starts, ends, first = characters(data, at, table)
    if not len(starts):
        return
    words, row = hasher(data, starts, ends), row_of(first)
    sums = benchmark.known(words, first)
    spots: list[np.ndarray] = []  # row, item, and the first and last word at which the item may start
    for pieces in benchmark.classes:
        held = sums[np.minimum(np.arange(len(words)) + pieces.reach - 1, len(words))] - sums[:-1]
        begin = np.flatnonzero(held >= pieces.fewest)
        if not len(begin):
            continue
        codes = pieces.candidates(words, begin, first[row[begin] + 1])
        start, piece_ = begin[codes // len(pieces.words)], codes % len(pieces.words)
        item = pieces.items[piece_]
        most = benchmark.allowed[item] + pieces.allowed[piece_]
        about = start - pieces.offsets[piece_]
        spots.append(np.stack([row[start], item, np.maximum(about - most, first[row[start]]), about + most]))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, item, start in benchmark.equal(words, first):
        key = r, int(benchmark.ids[item])
        now = 0, start, len(benchmark.words[item])
        best[key] = min(best.get(key, now), now)
    for r, item, lo, hi in _merged(spots):
        wanted, most = benchmark.words[item], int(benchmark.allowed[item])
        text = words[lo:min(hi + 1 + len(wanted) + most, first[r + 1])]
        if len(text) + most < len(wanted):
            continue
        start, edits = best_start(wanted, text, most)
        if edits <= most and start < len(text):
            edits, n = edit_distance(wanted, text[start:start + len(wanted) + most], most)
            key = r, int(benchmark.ids[item])
            now = edits, int(lo + start - first[r]), n
            if key not in best or now < best[key]:
                best[key] = now
    for (r, item), (edits, start, n) in sorted(best.items()):
        yield r, item, start, n, edits


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          edits: float = EDITS, least_words: int = LEAST_WORDS, recall: float = RECALL, sampled: int = SAMPLED, items_per_pass: int = ITEMS,
          short_items: bool = False) -> DataFrame:
    """One row per document and item that it holds: key, ``item_id``, ``first_word``, ``n_words``, ``edits``.

    A window of a document holds an item if at most ``edits`` of the item's words must be changed, inserted or deleted to get it; of several
    windows the one with the fewest edits, then the first, is given. Items below ``least_words`` words are held by equal runs of words
    only, and take no part unless ``short_items`` is set (the queries set it). A character of a script without spaces counts as a word. Null texts and items without words take no part. Rows without a key are not reported. At most ``items_per_pass`` items are held in memory at once: a larger benchmark is taken in passes.
    """
    named = docs.select(F.col(key).cast("bigint").alias("owner_id"), F.col(text).alias("text")).filter("owner_id is not null and text is not null")
    wanted = benchmark.select(F.col(item).cast("bigint").alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null").distinct()
    passes = max(1, -(-wanted.count() // items_per_pass))
    ddl = "owner_id bigint, item_id bigint, first_word bigint, n_words bigint, edits int"
    found = None
    for turn in range(passes):
        rows = wanted.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == turn).collect()
        table, hasher = separators(alnum_only=True), WordHash(lower_table())
        rows.sort(key=lambda r: (r.id, r.text))
        data, at = raw(pa.array([r.text for r in rows], pa.string()))
        starts, ends, first = characters(data, at, table)
        hashes = hasher(data, starts, ends)
        kept = [i for i in range(len(rows)) if first[i + 1] - first[i] >= (1 if short_items else max(2, least_words))]
        if not kept:
            continue
        whole = [hashes[first[i]:first[i + 1]] for i in kept]
        by_length: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        short = np.array([len(w) < max(2, least_words) for w in whole])
        for i, words in enumerate(whole):
            if short[i]:
                continue
            cuts = np.arange(-(-len(words) // PIECE) + 1) * len(words) // -(-len(words) // PIECE)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                by_length.setdefault(int(np.log(hi - lo) / np.log(LENGTH_RATIO)), []).append((i, lo, words[lo:hi]))
        classes = Benchmark(
            np.array([rows[i].id for i in kept], np.int64), whole, np.array([int(len(w) * edits + 1e-9) for w in whole], np.int64),
            [Items(np.array([g[0] for g in group]), np.array([g[1] for g in group]), [g[2] for g in group], edits, sampled, recall)
             for _, group in sorted(by_length.items())], np.flatnonzero(short))

        def search(batches: Iterator[pa.RecordBatch], items: Benchmark = classes) -> Iterator[pa.RecordBatch]:
            own, hash_ = separators(alnum_only=True), WordHash(lower_table())
            for batch in batches:
                for piece in slices(batch, "text"):
                    hits = list(_hits(piece, items, own, hash_))
                    if hits:
                        owner = piece.column("owner_id").take(pa.array([h[0] for h in hits], pa.int64()))
                        yield pa.RecordBatch.from_arrays([owner, *(pa.array([h[j] for h in hits], pa.int64()) for j in (1, 2, 3)),
                                                          pa.array([h[4] for h in hits], pa.int32())],
                                                         ["owner_id", "item_id", "first_word", "n_words", "edits"])

        one = named.mapInArrow(search, ddl)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], ddl)
    return found.withColumnRenamed("owner_id", key)
