"""The elements of JSON arrays, read by byte ranges, however large one file is.

Where a range begins inside a text or how deep, only the bytes before it can say. So each range first tells what it does to any state it may be
entered in (behind an odd run of backslashes or not, inside a text or not): the state it leaves and how the depth changes. These maps compose,
so one small row a range gives every range its state. Then each range gives out the elements whose separator (the opening bracket, or a
comma at depth one) lies in it, and reads past its end to finish the last one.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, bytes a task looks at a time, and bytes of elements it hands on at a time.
RANGE, BLOCK, HANDED = 1 << 25, 1 << 20, 1 << 23
_QUOTE, _BACK, _COMMA = b'"\\,'
_OPEN, _CLOSE = b"[{", b"]}"


class State(NamedTuple):
    """What precedes a byte: an odd run of backslashes, an open text, and so many open brackets."""

    odd: int = 0
    inside: int = 0
    depth: int = 0


def scan(block: bytes, entered: State) -> tuple[State, np.ndarray]:
    """The state behind a block, and where in it the separators of a top-level array stand."""
    a = np.frombuffer(block, np.uint8)
    n = len(a)
    if not n:
        return entered, np.zeros(0, np.int64)
    at = np.arange(n)
    plain = np.maximum.accumulate(np.where(a != _BACK, at, -1 - entered.odd))  # the last byte up to here that is no backslash
    quotes = np.flatnonzero(a == _QUOTE)
    before = np.where(quotes > 0, plain[quotes - 1], -1 - entered.odd)
    real = quotes[(quotes - 1 - before) % 2 == 0]
    turned = np.zeros(n, np.int8)
    turned[real] = 1
    inside = (entered.inside + np.cumsum(turned, dtype=np.int64)) % 2
    outside = inside == 0
    change = (np.isin(a, list(_OPEN)) & outside).astype(np.int64) - (np.isin(a, list(_CLOSE)) & outside)
    depth = entered.depth + np.cumsum(change)
    cuts = ((depth == 1) & ((change == 1) | (outside & (a == _COMMA)))) | ((depth == 0) & (change == -1))
    return State(int((n - 1 - plain[-1]) % 2), int(inside[-1]), int(depth[-1])), np.flatnonzero(cuts)


def _opened(path: str) -> pa.NativeFile:
    system, place = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    return system.open_input_file(posixpath.normpath(place))


def _blocks(file: pa.NativeFile, start: int, end: int, block: int) -> Iterator[tuple[int, bytes]]:
    file.seek(start)
    while start < end and (data := file.read(min(block, end - start))):
        yield start, data
        start += len(data)


def effect(path: str, start: int, end: int, block: int = BLOCK) -> list[int]:
    """``odd, inside, depth`` that a range leaves behind for each state it may be entered in, depth from 0: twelve numbers."""
    states = [State(odd, inside) for odd in (0, 1) for inside in (0, 1)]
    with _opened(path) as file:
        for _, data in _blocks(file, start, end, block):
            states = [scan(data, s)[0] for s in states]
    return [x for s in states for x in s]


def after(state: State, effect: list[int]) -> State:
    """The state behind a range that is entered in ``state``."""
    odd, inside, change = effect[3 * (2 * state.odd + state.inside):][:3]
    return State(int(odd), int(inside), state.depth + int(change))


def elements(path: str, start: int, end: int, size: int, entered: State, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """The elements whose separator lies in the range, with their places; beyond the range only the last one is finished."""
    state, begun, held = entered, None, []
    with _opened(path) as file:
        for at, data in _blocks(file, start, size, block):
            if state.depth == 0 and begun is None and start == 0 and not held and (text := data.lstrip(b"\xef\xbb\xbf \t\r\n")) and at == 0 and text[:1] != b"[":
                raise ValueError(f"{path}: not a JSON array")
            state, cuts = scan(data, state)
            left = 0
            for cut in cuts.tolist():
                if begun is not None:
                    text = b"".join([*held, data[left:cut]]).strip(b" \t\r\n")
                    if text:
                        yield begun, text
                if at + cut >= end or data[cut:cut + 1] == b"]":
                    begun, held = None, []
                    if at + cut >= end:
                        return
                else:
                    begun, held = at + cut + 1, []
                left = cut + 1
            if begun is not None:
                held.append(data[left:])
            elif at + len(data) >= end:
                break
        else:
            if state != State() and start < end:
                raise ValueError(f"{path}: the array has no end")


def read_array(spark: SparkSession, path: str, span: int = RANGE, block: int = BLOCK) -> DataFrame:
    """``_file``, ``_at`` (the byte an element starts behind) and ``value``, its JSON text, for the arrays in the files under ``path``.

    ``path`` is a file, a folder or a pattern. An empty array has no rows; a file that holds something else, or whose array has no end, raises.
    Elements of any kind come out as they are written. The files of a listing and a row for each range are all that the driver handles.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    files = sorted((r["path"], r["length"]) for r in listed)
    counts = [max(1, -(-size // span)) for _, size in files]
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if files else 0

    def place(i: int) -> tuple[int, int, int]:
        f = int(np.searchsorted(ends, i, side="right"))
        start = (i - int(ends[f]) + counts[f]) * span
        return f, start, min(start + span, files[f][1])

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            told = [effect(files[f][0], start, end, block) for f, start, end in map(place, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([place(i)[0] for i in ids], pa.int64()), pa.array(told, pa.list_(pa.int64()))],
                                             ["id", "file", "effect"])

    def entered(ranges: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        ranges = ranges.sort_values("id")
        for i, change in zip(ranges["id"], ranges["effect"], strict=True):
            out.append((i, *state))
            state = after(state, list(change))
        return pd.DataFrame(out, columns=["id", "odd", "inside", "depth"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i, *state in zip(*(batch.column(c).to_pylist() for c in ("id", "odd", "inside", "depth")), strict=True):
                f, start, end = place(i)
                for at, text in elements(files[f][0], start, end, files[f][1], State(*state), block):
                    rows.append((files[f][0], at, text.decode()))
                    size += len(text)
                    if size >= HANDED:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    ids = spark.range(0, total, 1, numPartitions=max(1, total))
    if all(n == 1 for n in counts):
        ranges = ids.select("id", *[F.lit(0).cast("bigint").alias(c) for c in State._fields])
    else:
        told = ids.mapInArrow(effects, "id BIGINT, file BIGINT, effect ARRAY<BIGINT>")
        ranges = told.groupBy("file").applyInPandas(entered, "id BIGINT, odd BIGINT, inside BIGINT, depth BIGINT").repartition(max(1, total), "id")
    return ranges.mapInArrow(found, "_file STRING, _at BIGINT, value STRING")


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)],
                                      ["_file", "_at", "value"])
