import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherlens.llm import shard


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = shard.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    if n >= 1000:
        assert (p != np.arange(n)).mean() > 0.9 and (p != shard.permute(np.arange(n), n, 7)).any()


def rows(n):
    return [(i % 50 if i % 7 else None, ["a", None, "", "é" * i, "same"][i % 5], 3) for i in range(n)]


def check(got, data, shards=8):
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1) for d, t, _ in data), key=str)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in data)
    counts = [0] * shards
    for r in got:
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def test_digest(spark):
    data = rows(333)
    df = spark.createDataFrame(data, "doc_id long, text string, slot int")
    got = shard.shard_digest(df).collect()
    check(got, data)
    # numbers come from rows, not from their places
    again = shard.shard_digest(df.repartition(5, "text").orderBy("text")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    # order of ids, then checksum, then place: recomputed without Spark
    ids = [(i, f"t{i}", 0) for i in range(100)]
    got = {r.doc_id: (r.shard, r.slot) for r in shard.shard_digest(spark.createDataFrame(ids, "doc_id long, text string, slot int")).collect()}
    p = shard.permute(np.arange(100), 100)
    assert got == {i: (p[i] % 8, p[i] // 8) for i in range(100)}
    wide = shard.shard_documents(spark.createDataFrame(ids, "doc_id long, text string, slot int"))
    assert wide.columns == ["doc_id", "text", "shard", "slot"] and {r.doc_id: (r.shard, r.slot) for r in wide.collect()} == got


def test_rows_that_differ_elsewhere_keep_their_shards(spark):
    data = [(i % 3, "t", f"x{i}", 1, 2) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, __crc string, __n int, __shard int")
    want = sorted(map(tuple, shard.shard_documents(df).collect()))
    assert sorted(map(tuple, shard.shard_documents(df.orderBy(F.desc("__crc")).repartition(3)).collect())) == want
    assert shard.shard_documents(df).columns == [*df.columns, "shard", "slot"]


def test_empty(spark):
    assert shard.shard_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
