"""Flat binary token shards with an index, as a Spark data source.

A shard is two flat files without a header: token ids (``uint16`` by default) and loss mask (``uint8``), one value per token. Each
write task streams its shards into a folder of its own attempt. Only when all tasks are done does the driver move the files of the
attempts that count to their places and write ``index.json`` last, so files of failed or repeated attempts are never part of a
corpus, and a corpus without an index does not exist. The reader takes its files from the index and reads byte ranges.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kolanut import tables as t
from kolanut.operators.packing import assign_shards, with_counts

FORMAT = "token_shards"
INDEX = "index.json"
WIDTHS = {"uint8": 1, "uint16": 2, "uint32": 4}
#: Tokens of a row, and of a partition, when shards are read back.
ROW_TOKENS, PART_TOKENS = 1 << 12, 1 << 23
ROWS = "shard_id BIGINT, first BIGINT, ids ARRAY<INT>, mask ARRAY<TINYINT>"


def file_names(shard: int) -> tuple[str, str]:
    return f"shard_{shard:05d}.bin", f"mask_{shard:05d}.bin"


def _placed(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; executors and driver have to reach the same one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task's attempt wrote: its folder, and per shard examples, tokens and trained tokens."""

    folder: str
    shards: list[tuple[int, int, int, int]]


class ShardWriter(DataSourceArrowWriter):
    """Rows (``shard_id``, ``ids``, ``mask``) that come sorted, with every shard in one task."""

    def __init__(self, path: str, dtype: str, facts: str):
        if dtype not in WIDTHS:
            raise ValueError(f"token type {dtype}: one of {', '.join(WIDTHS)}")
        self.path, self.dtype, self.facts = path, dtype, facts
        self.job = uuid.uuid4().hex

    def _attempts(self, root: str) -> str:
        return posixpath.join(root, f"_attempts-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _placed(self.path)
        folder = posixpath.join(self._attempts(root), uuid.uuid4().hex)
        done: dict[int, list[int]] = {}
        files: tuple = ()
        most = 1 << (8 * WIDTHS[self.dtype])
        for batch in iterator:
            ids, masks = batch.column("ids"), batch.column("mask")
            for k, shard in enumerate(batch.column("shard_id").to_pylist()):
                own, mask = ids[k].values.to_numpy(zero_copy_only=False), masks[k].values.to_numpy(zero_copy_only=False)
                if len(own) != len(mask):
                    raise ValueError(f"shard {shard}: {len(own)} ids and {len(mask)} mask values")
                if len(own) and (own.min() < 0 or own.max() >= most):
                    raise ValueError(f"shard {shard}: an id does not fit {self.dtype}")
                if shard not in done:
                    for f in files:
                        f.close()
                    system.create_dir(folder, recursive=True)
                    files = tuple(system.open_output_stream(posixpath.join(folder, n)) for n in file_names(shard))
                    done[shard] = [0, 0, 0]
                files[0].write(own.astype(f"<{np.dtype(self.dtype).str[1:]}").tobytes())
                files[1].write(mask.astype(np.uint8).tobytes())
                done[shard] = [done[shard][0] + 1, done[shard][1] + len(own), done[shard][2] + int((mask == 1).sum())]
        for f in files:
            f.close()
        return Written(folder, [(shard, *facts) for shard, facts in done.items()])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _placed(self.path)
        shards = {}
        for message in messages:
            for shard, examples, tokens, trained in message.shards if message else ():
                if shard in shards:
                    raise ValueError(f"shard {shard} was written by two tasks")
                shards[shard] = {"file": file_names(shard)[0], "n_tokens": tokens, "mask": file_names(shard)[1], "examples": examples, "n_trained": trained}
                for name in file_names(shard):
                    system.move(posixpath.join(message.folder, name), posixpath.join(root, name))
        tokens, trained = (sum(s[c] for s in shards.values()) for c in ("n_tokens", "n_trained"))
        index = {"dtype": self.dtype, "mask_dtype": "uint8", "n_response_tokens": trained, "response_frac": round(trained / max(tokens, 1), 4),
                 "shards": [shards[k] for k in sorted(shards)]} | json.loads(self.facts)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, f"{INDEX}.tmp")) as f:
            f.write(json.dumps(index, indent=1).encode())
        system.move(posixpath.join(root, f"{INDEX}.tmp"), posixpath.join(root, INDEX))
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        """Whatever attempts left behind goes; files that were moved are kept."""
        system, root = _placed(self.path)
        if system.get_file_info(self._attempts(root)).type == fs.FileType.Directory:
            system.delete_dir(self._attempts(root))


@dataclass
class Range(InputPartition):
    shard: int
    first: int
    tokens: int


def read_index(path: str) -> dict:
    system, root = _placed(path)
    with system.open_input_stream(posixpath.join(root, INDEX)) as f:
        return json.loads(f.read())


class ShardReader(DataSourceReader):
    """Ranges of the flat files that the index names."""

    def __init__(self, path: str, row_tokens: int, part_tokens: int):
        self.path, self.row_tokens = path, row_tokens
        self.part_tokens = max(row_tokens, part_tokens // row_tokens * row_tokens)
        self.index = read_index(path)

    def partitions(self) -> list[Range]:
        return [Range(k, at, min(self.part_tokens, s["n_tokens"] - at))
                for k, s in enumerate(self.index["shards"]) for at in range(0, s["n_tokens"], self.part_tokens)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a corpus without shards
            return
        system, root = _placed(self.path)
        shard, width = self.index["shards"][partition.shard], WIDTHS[self.index["dtype"]]
        with (system.open_input_file(posixpath.join(root, shard["file"])) as ids, system.open_input_file(posixpath.join(root, shard["mask"])) as masks):
            for at in range(partition.first, partition.first + partition.tokens, self.row_tokens):
                n = min(self.row_tokens, partition.first + partition.tokens - at)
                own, mask = ids.read_at(n * width, at * width), masks.read_at(n, at)
                if len(own) != n * width or len(mask) != n:
                    raise ValueError(f"{shard['file']} is shorter than its index says")
                values = np.frombuffer(own, dtype=f"<u{width}").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard["file"][6:-4])], pa.int64()), pa.array([at], pa.int64()), pa.array([values], pa.list_(pa.int32())),
                     pa.array([np.frombuffer(mask, dtype=np.int8)], pa.list_(pa.int8()))], ["shard_id", "first", "ids", "mask"])


class TokenShards(DataSource):
    """``spark.read.format("token_shards")`` and ``df.write.format("token_shards")`` once registered."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], int(self.options.get("rowtokens", ROW_TOKENS)), int(self.options.get("parttokens", PART_TOKENS)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        path = self.options["path"]
        system, root = _placed(path)
        if not overwrite and system.get_file_info(posixpath.join(root, INDEX)).type == fs.FileType.File:
            raise ValueError(f"{path} holds a corpus already")
        return ShardWriter(path, self.options.get("dtype", "uint16"), self.options.get("facts", "{}"))


def write_binary(df: DataFrame, path: str, vocab_size: int, tokenizer: bytes = b"", cap: int = t.SHARD_TOKENS, key: str = "example_id", seed: int = 18,
                 eos_id: int = t.EOS_ID, dtype: str = "uint16", counts: Mapping[str, int] | None = None,
                 unrenderable: Mapping[str, int] | None = None, dup: Mapping[str, int] | None = None) -> dict:
    """Encoded examples (``key``, ``ids``, ``mask``) as flat shards of about ``cap`` tokens in shuffled order; returns the index.

    A shard is bounded by the cap, so one task writes it whole; shards are dealt over as many tasks as there are shards. ``counts``
    and ``unrenderable`` are rows per ``type/lang``, ``dup`` the copies per type, as the caller knows them. An empty frame gives an
    index without shards.
    """
    spark = df.sparkSession
    spark.dataSource.register(TokenShards)
    placed = assign_shards(with_counts(df.select(key, "ids", "mask")), "n_tokens", key, cap, seed)
    shards = (placed.agg(F.max("shard_id").alias("s")).first()["s"] or 0) + 1
    facts = {"eos_id": eos_id, "vocab_size": vocab_size, "tokenizer_sha": hashlib.sha256(tokenizer).hexdigest()[:16] if tokenizer else "",
             "counts": dict(counts or {}), "unrenderable": dict(unrenderable or {}), "dup": dict(dup or {})}
    # ordered within the shard by the running total; rows of no tokens cannot change what is written
    dealt = placed.repartition(shards, "shard_id").sortWithinPartitions("shard_id", "shard_order", key)
    dealt.select("shard_id", "ids", "mask").write.format(FORMAT).mode("overwrite").option("dtype", dtype).option("facts", json.dumps(facts)).save(path)
    return read_index(path)


def read_binary(spark: SparkSession, path: str, row_tokens: int = ROW_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(shard_id, first, ids, mask): runs of ``row_tokens`` tokens of every shard, with their place in it."""
    spark.dataSource.register(TokenShards)
    return spark.read.format(FORMAT).option("rowTokens", row_tokens).option("partTokens", part_tokens).load(path)


def index_rows(placed: DataFrame) -> DataFrame:
    """The index's rows (``shard_id, file, mask, examples, n_tokens, n_trained, response_frac``) of examples with ``shard_id``, ``n_tokens``
    and ``n_trained``: what a corpus will hold, before or without writing it."""
    sums = placed.groupBy("shard_id").agg(F.count(F.lit(1)).alias("examples"), F.sum("n_tokens").cast("bigint").alias("n_tokens"),
                                          F.sum("n_trained").cast("bigint").alias("n_trained"))
    name = lambda kind: F.format_string(f"{kind}_%05d.bin", F.col("shard_id"))
    return sums.select("shard_id", name("shard").alias("file"), name("mask").alias("mask"), "examples", "n_tokens", "n_trained",
                       F.round(F.col("n_trained") / F.greatest(F.col("n_tokens"), F.lit(1)), 4).alias("response_frac"))
