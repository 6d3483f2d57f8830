"""Which keys of a row does another row hold too? Asked for very many keys a row.

Keys of many rows travel together, packed by hash bucket, instead of as a row each. Equal keys met in one batch collapse to
one entry there, so a key that a third of all rows hold weighs one entry per batch, not one per row; what
the batch already knows it answers itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kolanut.llm.words import SLICE_BYTES, mixed, slices

#: Keys gathered before a batch is packed.
FLUSH_KEYS = 1 << 20
#: SHARED: every owner of a key that at least two owners hold. LATER: those above the key's smallest owner.
SHARED, LATER = "shared", "later"
#: Asked: a bucket's keys with an owner each. Known: pairs of owner and key that were found, for the owners of one group.
_SCHEMA = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("owners", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])
_DDL = "bucket int, known boolean, owners binary, lo binary, hi binary"


def _bytes(x: np.ndarray, width: int) -> bytes:
    """64-bit numbers by their lowest bytes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(parts: list[bytes], width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :width] = data
    return out.view(np.uint64).ravel()


def _dealt(group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """The members of each group that has any."""
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cut)):
        yield int(g), order[cut[g]:cut[g + 1]]


def _group_of(owner: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(owner.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _grouped(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str):
    """Sort order, the first entry of each key with its smallest and largest owner, and a mask of entries that the rule finds."""
    order = np.argsort(lo) if not len(hi) else np.lexsort((hi, lo))
    slo = lo[order]
    new = np.ones(len(lo), bool)
    new[1:] = slo[1:] != slo[:-1]
    if len(hi):
        shi = hi[order]
        new[1:] |= shi[1:] != shi[:-1]
    at = np.flatnonzero(new)
    held = owner[order]
    least, most = np.minimum.reduceat(held, at), np.maximum.reduceat(held, at)
    sizes = np.diff(np.append(at, len(lo)))
    if rule == SHARED:
        found = np.repeat(most > least, sizes)
    else:
        found = held > np.repeat(least, sizes)
    return order, at, least, most, held, found


def _found_rows(owner: np.ndarray, lo: np.ndarray, groups: int) -> list[tuple]:
    """What was found, packed by group of owners."""
    order = np.argsort(owner, kind="stable")
    owner, lo = owner[order], lo[order]
    return [(g, True, owner[i].tobytes(), lo[i].tobytes(), None) for g, i in _dealt(_group_of(owner, groups), groups)]


def _flushed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, rule: str, widths: tuple[int, int]) -> pa.RecordBatch | None:
    owner, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(lo):
        return None
    order, at, least, most, held, found = _grouped(owner, lo, hi, rule)
    keys, high = lo[order][at], hi[order][at] if len(hi) else hi
    if rule == SHARED:  # the smallest and the largest owner ask, the others know already
        sizes = np.diff(np.append(at, len(lo)))
        found &= (held != np.repeat(least, sizes)) & (held != np.repeat(most, sizes))
        two = most > least
        keys, least = np.concatenate((keys, keys[two])), np.concatenate((least, most[two]))
        high = np.concatenate((high, high[two])) if len(hi) else high
    rows = _found_rows(held[found], lo[order][found], buckets)
    bucket = ((keys >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
    deal = np.argsort(least, kind="stable")  # runs of one owner pack well
    for b, i in _dealt(bucket[deal], buckets):
        i = deal[i]
        rows.append((b, False, least[i].tobytes(), _bytes(keys[i], widths[0]), _bytes(high[i], widths[1]) if len(high) else b""))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _answered(batches: Iterator[pa.RecordBatch], rule: str, buckets: int, widths: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """One bucket: passes on what was found, and finds what is held in several batches."""
    out = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("keys", pa.binary())])
    asked: list[tuple[bytes, bytes, bytes]] = []
    for batch in batches:
        known = batch.filter(batch.column("known"))
        if len(known):
            yield pa.RecordBatch.from_arrays([known.column("bucket"), known.column("owners"), known.column("lo")], schema=out)
        batch = batch.filter(pc.invert(batch.column("known")))
        asked += zip(*(batch.column(c).to_pylist() for c in ("owners", "lo", "hi")), strict=True)
    if not asked:
        return
    owner = np.frombuffer(b"".join(a[0] for a in asked), np.int64)
    lo = _numbers([a[1] for a in asked], widths[0])
    hi = _numbers([a[2] for a in asked], widths[1])
    del asked
    order, _, _, _, held, found = _grouped(owner, lo, hi, rule)
    rows = _found_rows(held[found], lo[order][found], buckets)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()),
                                          pa.array([r[3] for r in rows], pa.binary())], schema=out)


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per owner of a group, with its distinct keys."""
    owners, keys = [], []
    for batch in batches:
        owners += batch.column("owners").to_pylist()
        keys += batch.column("keys").to_pylist()
    owner, key = np.frombuffer(b"".join(owners), np.int64), np.frombuffer(b"".join(keys), np.uint64)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    owner, key = owner[new], key[new]
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    ends = [*at[1:].tolist(), len(owner)]
    return pa.RecordBatch.from_arrays([pa.array(owner[at], pa.int64()), pa.array([key[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary())],
                                      ["owner", "found"])


def find(rows: DataFrame, reader: Callable[[], Any], keys: Callable[[pa.RecordBatch, Any], Iterator[tuple[np.ndarray, ...]]],
         rule: str, text: str | None = "text", widths: tuple[int, int] = (8, 8), flush: int = FLUSH_KEYS) -> DataFrame:
    """``owner`` and ``found`` (its packed 64-bit keys, distinct) for rows with keys that the rule finds.

    ``keys`` yields, per slice of a batch (cut by its column ``text``, if named) and with the task's own ``reader()``, the
    owner, low and high half of each key (an empty high half: 64-bit keys). ``widths`` are the bytes in use of either half; the others must be
    zero. ``flush`` keys are gathered before a batch is packed. The number of buckets, and of the groups of owners that answers are gathered in, is the session's number of
    shuffle partitions; a bucket is worked in one task.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, held = reader(), [], 0
        for batch in batches:
            for piece in slices(batch, text, SLICE_BYTES) if text else [batch]:
                for owner, lo, hi in keys(piece, own):
                    parts.append((owner, lo, hi))
                    held += len(lo)
                if held >= flush:
                    if (packed := _flushed(parts, buckets, rule, widths)) is not None:
                        yield packed
                    parts, held = [], 0
        if parts and (packed := _flushed(parts, buckets, rule, widths)) is not None:
            yield packed
        del parts
        pa.default_memory_pool().release_unused()  # workers serve many stages: what one took for a moment goes back

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answered(batches, rule, buckets, widths)
        pa.default_memory_pool().release_unused()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _gathered(batches)
        pa.default_memory_pool().release_unused()

    found = rows.mapInArrow(ask, _DDL).groupBy("bucket").applyInArrow(answer, "part int, owners binary, keys binary")
    return found.groupBy("part").applyInArrow(gather, "owner bigint, found binary")


def unpacked(found: pa.Array) -> np.ndarray:
    """All keys of a column of packed keys."""
    return np.frombuffer(b"".join(x for x in found.to_pylist() if x), np.uint64)
