"""Words of whole Arrow batches as numpy arrays: no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Text handled at a time, so that intermediates stay small beside the batch; a longer text is one slice.
SLICE_BYTES = 1 << 21
_STEP = 1 << 17


def separators(alnum_only: bool = False) -> np.ndarray:
    """A table over bytes: True where a byte ends a word. ``alnum_only`` also cuts at ASCII punctuation."""
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    if alnum_only:
        table[[b for b in range(128) if not chr(b).isalnum()]] = True
    return table


def lower_table() -> np.ndarray:
    """A table over bytes that lower-cases A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text array, and where each row begins (one more entry than rows). Null: empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return found, at - at[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``size`` bytes of text; no text is cut."""
    _, at = raw(batch.column(text))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and the number of words before each row (one more entry than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    word = ~table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def _unspaced() -> np.ndarray:
    """A table over the first two bytes of a UTF-8 character: True in scripts that put no spaces between words (Han, kana, Thai, Lao, Burmese, Khmer)."""
    table = np.zeros(1 << 16, bool)
    for lead, low, high in ((0xE0, 0xB8, 0xBB), (0xE1, 0x80, 0x82), (0xE1, 0x9E, 0x9F), (0xE2, 0xBA, 0xBF), (0xE3, 0x80, 0xBF), *((b, 0x80, 0xBF) for b in range(0xE4, 0xEA)),
                            (0xEF, 0xA4, 0xAB), (0xF0, 0xA0, 0xB3)):
        table[(lead << 8) + low:(lead << 8) + high + 1] = True
    return table


UNSPACED = _unspaced()


def characters(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``spans``, but each character of a script without spaces is a word of its own."""
    starts, ends, first = spans(data, at, table)
    lead = np.flatnonzero(data[:-1] >= 0xE0) if len(data) else np.zeros(0, np.int64)
    lead = lead[UNSPACED[(data[lead].astype(np.int64) << 8) + data[lead + 1]]]
    if not len(lead):
        return starts, ends, first
    after = lead + np.where(data[lead] >= 0xF0, 4, 3)
    inner = np.unique(np.concatenate((lead, after)))
    word = np.searchsorted(starts, inner, "right") - 1  # every such byte lies in a word or ends one
    inner = inner[(starts[word] < inner) & (inner < ends[word])]
    starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHash:
    """64-bit word hashes from running sums of a polynomial over the bytes, modulo 2^64."""

    def __init__(self, fold: np.ndarray | None = None):
        rng = np.random.Generator(np.random.PCG64(7))
        letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.letters = letters if fold is None else letters[fold]
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers(2 * _STEP)

    def _powers(self, n: int) -> None:
        def powers(b):
            out = np.full(n, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)
        self.up, self.down = powers(self.base), powers(self.inverse)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STEP, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo > len(self.up):
                self._powers(2 * (hi - lo))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.letters[data[lo:hi]] * self.up[:hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mixed((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64))
            i = j
        return out


def windows(hashes: np.ndarray, first: np.ndarray, size: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words, and the number of runs before each row.

    ``first`` holds the number of words before each row. A run never crosses rows.
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    at = np.concatenate(([0], np.cumsum(counts)))
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    keep = np.ones(len(hashes), bool)
    tail = np.minimum(np.diff(first), size - 1)
    drop = np.repeat(first[1:] - tail, tail) + np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail)
    keep[drop] = False
    begin = np.flatnonzero(keep)
    total = np.zeros(len(begin), np.uint64)
    factor = (0xD6E8FEB86659FD93 * (2 * salt + 1)) & ((1 << 64) - 1)
    for k in range(size):
        total = total * np.uint64(factor) + mixed(hashes[begin + k] + np.uint64(salt))
    return mixed(total), at


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each element, from the counts before each row."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
