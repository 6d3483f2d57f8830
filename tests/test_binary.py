"""Flat shards: written, read back by byte ranges, attempts that do not count, and what does not fit."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kolanut.operators import packing
from kolanut.sources import binary


def _coded(spark, n=300, biggest=60_000):
    ids = F.transform(F.sequence(F.lit(0), (F.col("id") % 13).cast("int")), lambda x: ((F.col("id") * 977 + x * 31) % biggest).cast("int"))
    df = spark.range(n).select(F.col("id").alias("example_id"), ids.alias("ids"))
    return df.withColumn("mask", F.transform("ids", lambda x: (x % 2).cast("tinyint"))).repartition(5)


def test_round_trip_by_byte_ranges(spark, tmp_path):
    coded = _coded(spark)
    index = binary.write_binary(coded, f"{tmp_path}/c", 65_536, b"tokenizer", cap=400, counts={"a/en": 300}, unrenderable={"a/en": 2}, dup={"a": 3})
    placed = packing.assign_shards(packing.with_counts(coded), "n_tokens", "example_id", 400).orderBy("shard_order").collect()
    want = {}
    for r in placed:
        ids, mask = want.setdefault(r.shard_id, ([], []))
        ids += r.ids
        mask += r["mask"]
    assert [s["n_tokens"] for s in index["shards"]] == [len(want[k][0]) for k in sorted(want)] and len(want) > 3
    for shard, s in enumerate(index["shards"]):
        assert np.fromfile(f"{tmp_path}/c/{s['file']}", dtype="<u2").tolist() == want[shard][0]
        assert np.fromfile(f"{tmp_path}/c/{s['mask']}", dtype=np.uint8).tolist() == want[shard][1]
    trained = sum(sum(m) for _, m in want.values())
    told = {k: index[k] for k in ("dtype", "mask_dtype", "eos_id", "vocab_size", "n_response_tokens", "counts", "unrenderable", "dup")}
    assert told == {"dtype": "uint16", "mask_dtype": "uint8", "eos_id": 2, "vocab_size": 65_536, "n_response_tokens": trained,
                    "counts": {"a/en": 300}, "unrenderable": {"a/en": 2}, "dup": {"a": 3}} and len(index["tokenizer_sha"]) == 16
    for row, part in ((64, 128), (7, 7), (4096, 1 << 23)):
        got = {}
        df = binary.read_binary(spark, f"{tmp_path}/c", row, part)
        for r in df.orderBy("shard_id", "first").collect():
            ids, mask = got.setdefault(r.shard_id, ([], []))
            assert r.first == len(ids) and len(r.ids) <= row
            ids += r.ids
            mask += r["mask"]
        assert got == want and (part > 400 or df.rdd.getNumPartitions() > len(want))
    rows = {r.shard_id: r for r in binary.index_rows(packing.assign_shards(packing.with_counts(coded), "n_tokens", "example_id", 400)).collect()}
    assert [(rows[k].file, rows[k]["mask"], rows[k].n_tokens, rows[k].examples) for k in sorted(rows)] == [
        (s["file"], s["mask"], s["n_tokens"], s["examples"]) for s in index["shards"]]


def test_attempts_that_do_not_count_are_left_out(spark, tmp_path):
    """A second attempt of the same task writes to a folder of its own; only the committed one's files get a place."""
    path = f"{tmp_path}/c"
    batches = packing.with_counts(_coded(spark, 20)).withColumn("shard_id", F.lit(0)).coalesce(1).select("shard_id", "ids", "mask").toArrow().to_batches()
    writer = binary.ShardWriter(path, "uint16", "{}")
    lost, kept = writer.write(iter(batches[:1])), writer.write(iter(batches))
    assert lost.folder != kept.folder and not os.path.exists(f"{path}/index.json")
    writer.commit([kept, None])
    assert sorted(os.listdir(path)) == ["index.json", "mask_00000.bin", "shard_00000.bin"]
    assert os.path.getsize(f"{path}/shard_00000.bin") == 2 * binary.read_index(path)["shards"][0]["n_tokens"]
    other = binary.ShardWriter(f"{tmp_path}/d", "uint16", "{}")
    other.write(iter(batches))
    other.abort([])
    assert os.listdir(f"{tmp_path}/d") == []
    with pytest.raises(ValueError, match="two tasks"):
        again = binary.ShardWriter(f"{tmp_path}/e", "uint16", "{}")
        again.commit([again.write(iter(batches)), again.write(iter(batches))])


def test_faults_end_the_write(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit uint16"):
        binary.write_binary(_coded(spark, 100, 70_000), f"{tmp_path}/c", 70_000, cap=400)
    assert not os.path.exists(f"{tmp_path}/c/index.json")
    index = binary.write_binary(_coded(spark, 100, 70_000), f"{tmp_path}/c", 70_000, cap=400, dtype="uint32")
    assert index["dtype"] == "uint32"
    total = binary.read_binary(spark, f"{tmp_path}/c").agg(F.sum(F.size("ids"))).first()[0]
    assert total == sum(s["n_tokens"] for s in index["shards"])
    with open(f"{tmp_path}/c/{index['shards'][0]['mask']}", "r+b") as f:
        f.truncate(1)
    with pytest.raises(Exception, match="shorter than its index"):
        binary.read_binary(spark, f"{tmp_path}/c").collect()
    empty = binary.write_binary(_coded(spark, 0), f"{tmp_path}/none", 10)
    assert empty["shards"] == [] and binary.read_binary(spark, f"{tmp_path}/none").count() == 0
    assert json.loads(open(f"{tmp_path}/none/index.json").read()) == empty
