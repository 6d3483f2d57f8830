"""Nearest neighbours by a blocked matrix join with int8 product tiles.

Vectors are packed in blocks: int8 codes with a scale per vector, the length of the rounding error, and the originals. A grid
deals each query block to every column of candidate blocks and each candidate block to every row of query blocks by
plain equality of the grid cell. For a tile of two blocks one product of the codes gives approximate distances; by
the triangle inequality the true one differs by at most the two rounding errors. Only pairs that this bound
cannot rule out are computed on the originals, in double precision, and each query keeps a heap of its nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAREST = 10
#: Vectors of a block; a tile holds the square of it.
BLOCK = 1024
#: Columns of the grid: copies of each query block. Queries are few against the candidates.
COLUMNS = 32
#: Relative room for the rounding of single-precision scales and of the bound itself.
SLACK = 1e-6
_BLOCK = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary()),
                    ("vectors", pa.binary())])
_BLOCK_DDL = "dim int, ids binary, codes binary, scales binary, errors binary, vectors binary"


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale per vector, and the length of what rounding leaves out."""
    scales = np.abs(vectors).max(1) / 127
    codes = np.rint(vectors / np.where(scales > 0, scales, 1)[:, None]).astype(np.int8)
    return codes, scales, np.sqrt(((vectors - codes * scales[:, None]) ** 2).sum(1))


def _packed(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    codes, scales, errors = quantised(vectors)
    row = [vectors.shape[1], ids.tobytes(), codes.tobytes(), scales.tobytes(), errors.tobytes(), vectors.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Packed blocks of the usable vectors, by number of components."""
    held: dict[int, list] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        column = batch.column("vector").cast(pa.list_(pa.float64()))
        sizes = np.diff(column.offsets.to_numpy())
        nulls = ~column.is_valid().to_numpy(zero_copy_only=False) | ~batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(nulls, 0, sizes)
        ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
        values = column.values.to_numpy(zero_copy_only=False)
        at = column.offsets.to_numpy()[:-1]
        for dim in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == dim)
            found = values[at[rows][:, None] + np.arange(dim)]
            good = np.isfinite(found).all(1) & (found != 0).any(1)
            held.setdefault(int(dim), []).append((ids[rows[good]], found[good]))
            counts[int(dim)] = counts.get(int(dim), 0) + int(good.sum())
            while counts[int(dim)] >= size:
                every, many = np.concatenate([h[0] for h in held[int(dim)]]), np.concatenate([h[1] for h in held[int(dim)]])
                yield _packed(every[:size], many[:size])
                held[int(dim)], counts[int(dim)] = [(every[size:], many[size:])], len(every) - size
    for dim, parts in held.items():
        if counts[dim]:
            yield _packed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class _Block:
    def __init__(self, row: dict, prefix: str, dim: int):
        read = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.ids = read("ids", np.int64)
        n = len(self.ids)
        self.codes = read("codes", np.int8).reshape(n, dim).astype(np.float32)
        self.scales, self.errors = read("scales", np.float64), read("errors", np.float64)
        self.vectors = read("vectors", np.float64).reshape(n, dim)
        self.squares = (self.codes ** 2).sum(1, dtype=np.float64) * self.scales ** 2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed component after component in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        total += d * d
    return np.sqrt(total)


def _tile(q: _Block, c: _Block, k: int, heaps: dict[int, list]) -> None:
    """Adds a tile's possible neighbours to the heaps: per query the k nearest ids as (-distance, -id), each id once."""
    product = (q.codes @ c.codes.T).astype(np.float64)  # whole numbers below 2^24 up to 1040 components: exact
    approx = np.sqrt(np.maximum(q.squares[:, None] + c.squares[None, :] - 2 * q.scales[:, None] * c.scales[None, :] * product, 0))
    slack = SLACK * (1 + approx.max(initial=0.0)) * max(1, q.codes.shape[1] / 1024)
    low = approx - q.errors[:, None] - c.errors[None, :] - slack
    high = approx + q.errors[:, None] + c.errors[None, :] + slack
    high[q.ids[:, None] == c.ids[None, :]] = np.inf
    order = np.argsort(c.ids, kind="stable")
    first = np.flatnonzero(np.diff(c.ids[order], prepend=c.ids[order[0]] - 1))
    if len(first) < len(order):  # rows under one id are one neighbour: the nearest of them
        high = np.minimum.reduceat(high[:, order], first, axis=1)
    if high.shape[1] > k:
        limit = np.partition(high, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(q.ids), np.inf)
    known = np.array([-heaps[i][0][0] if len(heaps.get(i, ())) == k else np.inf for i in q.ids.tolist()])
    at_q, at_c = np.nonzero((low <= np.minimum(limit, known)[:, None]) & (q.ids[:, None] != c.ids[None, :]))
    exact = distances(q.vectors[at_q], c.vectors[at_c])
    for query, vec, d in zip(q.ids[at_q].tolist(), c.ids[at_c].tolist(), exact.tolist(), strict=True):
        heap = heaps.setdefault(query, [])
        if len(heap) == k and (-d, -vec) <= heap[0]:
            continue
        held = next((i for i, entry in enumerate(heap) if entry[1] == -vec), None)
        if held is not None:
            if -d > heap[held][0]:
                heap[held] = (-d, -vec)
                heapq.heapify(heap)
        elif len(heap) < k:
            heapq.heappush(heap, (-d, -vec))
        else:
            heapq.heapreplace(heap, (-d, -vec))


def nearest(rows: DataFrame, is_query: Column, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding",
            block: int = BLOCK, columns: int = COLUMNS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k nearest other rows, exactly.

    Rows without a key, and vectors that are null, zero, or hold null or non-finite components, take no part; vectors of
    another number of components are no candidates. Rows under the query's own key are left out; candidates repeated
    under one key count once (their nearest row). Ties go to the smaller key. No usable row: no result.
    """
    usable = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("_q"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, block)

    candidates = usable.select("id", "vector").mapInArrow(pack, _BLOCK_DDL)
    # queries are gathered in full blocks first: a scan task alone may hold few of them
    queries = usable.filter("_q").select("id", "vector").repartition(F.floor(F.xxhash64("id") / F.lit(1 << 58)))
    queries = queries.mapInArrow(pack, _BLOCK_DDL)
    cell = F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int")
    left = queries.select(*[F.col(f.name).alias(f"q_{f.name}") for f in _BLOCK], F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("q_cell"))
    right = candidates.select("*", cell.alias("cell"))
    tiles = left.join(right, (F.col("q_cell") == F.col("cell")) & (F.col("q_dim") == F.col("dim")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        last: tuple[bytes, _Block] | None = None
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if last is None or last[0] != row["q_ids"]:
                    last = row["q_ids"], _Block(row, "q_", row["dim"])
                _tile(last[1], _Block(row, "", row["dim"]), k, heaps)
                if len(heaps) > 64 * block:
                    yield _rows(heaps)
                    heaps = {}
        yield _rows(heaps)

    near = tiles.mapInArrow(found, "query_id bigint, vec_id bigint, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _rows(heaps: dict[int, list]) -> pa.RecordBatch:
    flat = [(q, -v, -d) for q, heap in heaps.items() for d, v in heap]
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64()),
                                       pa.array([f[2] for f in flat], pa.float64())], ["query_id", "vec_id", "score"])
