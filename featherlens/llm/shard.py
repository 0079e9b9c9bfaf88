"""Reproducible shuffle and sharding: a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (id, text checksum, text hash, hash of all columns), so the numbers depend on the
rows alone and not on how files or partitions hold them; only rows equal in every column are interchangeable. A keyed Feistel network permutes the smallest even-bit power of two that holds N;
cycle walking repeats it until the number is below N, which makes it a permutation of exactly 0..N-1. The shard is the
permuted number modulo the shard count and the slot the quotient: counts differ by one at most, slots have no gaps, and
both can be computed from a row number without any table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted, row_hash

SHARDS = 8
KEY = 20_240_229
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The images of numbers (all in 0..size-1) under the keyed permutation of 0..size-1."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, (key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)) & mask)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with a global number __n from 0 in the given order, and their count.

    A range shuffle sorts; equal rows are told apart by their place in the scan, so no key is too hot for one range.
    Each partition then numbers its own rows, and the partitions' offsets (one row each) are broadcast.
    """
    keys = [*order, "__scan"]
    ranged = rows.withColumn("__scan", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut(ranged.drop("__scan").withColumn("__at", F.monotonically_increasing_id()), "ranged")
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))), "offsets")
    total = offsets.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    out = ranged.withColumn("__part", part).join(F.broadcast(offsets.select("__part", "__offset")), "__part")
    return out.withColumn("__n", F.col("__offset") + local).drop("__part", "__offset", "__at"), total


def sharded(rows: DataFrame, order: list[str], shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """rows, numbered in the given order, with their __shard and __slot; nulls come first."""
    out, total = numbered(rows, order)

    @F.arrow_udf(T.LongType())
    def place(numbers: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for n in numbers:
            yield pa.array(permute(n.to_numpy(zero_copy_only=False), total, key))

    out = out.withColumn("__p", place.asNondeterministic()("__n"))
    return out.withColumns({"__shard": (F.col("__p") % shards).cast("int"), "__slot": F.floor(F.col("__p") / shards).cast("long")}).drop("__n", "__p")


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("__crc"), F.xxhash64("text").alias("__hash"))
    out = sharded(cut(narrow, "narrow"), ["doc_id", "__crc", "__hash"], shards)
    return out.select(
        "doc_id", "size", F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs' columns and their shard and slot (columns of those names are replaced), for a writer to partition by shard."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.drop("shard", "slot")
    rows = kept.select(F.col("doc_id").alias("__id"), F.crc32(text).alias("__crc"), F.xxhash64("text").alias("__hash"), row_hash(kept).alias("__all"), F.struct(*quoted(kept)).alias("__doc"))
    return sharded(rows, ["__id", "__crc", "__hash", "__all"], shards).select("__doc.*", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
