"""Benchmark decontamination by word windows.

Items become windows of WINDOW normalised words (a shorter item is one window). While the benchmark's text is at most
MAX_BROADCAST_BYTES, its windows are broadcast as a hash set and every document is scanned once, without a shuffle: words
map to vocabulary numbers, a window whose words are all known is looked up by rolling hash, and hits are verified by
their exact words. A larger benchmark takes another way with the same result: the windows of both sides meet in a join by
their digest, on salted keys, and the meetings are verified by their exact words too.

Rows with a null or empty text have no words. Callers' columns stay as they are, whatever their names. Items whose id or text is null take no part; items without words have no
window. Repeated items count once by id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, quoted, raw_bytes

WINDOW = 13
#: Broadcast bound for the benchmark's texts; its windows take about ten times as much in a worker.
MAX_BROADCAST_BYTES = 16 << 20
#: Copies of a benchmark window in the join, so that a passage of very many documents is no hot key.
SALTS = 8
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEEP else 0x20 for c in bytes(range(256)).lower())

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    size = min(WINDOW, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


class WindowSet:
    """Windows of the benchmark with the items that hold them."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = {}
        hashes: dict[int, set[int]] = {}
        rng = np.random.default_rng(13)
        self.factors = rng.integers(0, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
        for item, text in items:
            for window in windows_of(words_of(text)):
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window], np.int64)
                self.items.setdefault(ids.tobytes(), set()).add(item)
                hashes.setdefault(len(ids), set()).add(int((ids.view(np.uint64) * self.factors[: len(ids)]).sum(dtype=np.uint64)))
        self.hashes = {n: np.array(sorted(h), np.uint64) for n, h in sorted(hashes.items())}

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, number of words) of every occurrence, and the items met."""
        n, spans, met = len(words), [], set()
        if not self.hashes or n < next(iter(self.hashes)):
            return spans, met
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, n)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, hashes in self.hashes.items():
            if n < size:
                break
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            for j in range(size):
                h += ids[starts + j].view(np.uint64) * self.factors[j]
            found = np.searchsorted(hashes, h)
            found[found == len(hashes)] = 0
            for i in starts[hashes[found] == h].tolist():
                if items := self.items.get(ids[i : i + size].tobytes()):
                    spans.append((i, size))
                    met |= items
        return spans, met


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint [first, stop) runs of hit words, in order."""
    out: list[list[int]] = []
    for i, size in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], i + size)
        else:
            out.append([i, i + size])
    return [(a, b) for a, b in out]


def without_spans(text: bytes, runs: list[tuple[int, int]]) -> str:
    """The text without its hit words and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_TABLE))]
    kept, last = [], 0
    for a, b in runs:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]]).decode("utf-8", "replace")


def judged(text: bytes, n_words: int, spans: list[tuple[int, int]], met: set[str], clean: bool) -> dict:
    runs = merged(spans)
    hit = sum(b - a for a, b in runs)
    return {
        "n_words": n_words,
        "n_hit": hit,
        "n_items": len(met),
        "items_sha256": hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(),
        "contaminated": hit > 0 and SHARE * hit >= n_words,
        "clean_text": without_spans(text, runs) if clean and runs else None,
    }


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()


def _by_broadcast(docs: DataFrame, items: DataFrame, clean: bool, name: str) -> DataFrame:
    # bounded: the caller has checked the size of the texts
    windows = docs.sparkSession.sparkContext.broadcast(WindowSet([(r.item_id, r.text.encode()) for r in items.toLocalIterator()]))

    @F.arrow_udf(RESULT)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = windows.value
        for column in texts:
            rows = []
            for text in raw_bytes(column):
                words = words_of(text)
                rows.append(judged(text, len(words), *known.spans(words), clean))
            yield pa.array(rows, RESULT_ARROW)

    return docs.withColumn(name, judge.asNondeterministic()("text"))


RESULT_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("clean_text", pa.string())])


def _digest(words: list[bytes]) -> bytes:
    joined = b" ".join(words)
    return xxhash.xxh3_128_digest(joined) + xxhash.xxh64_digest(joined, 7)


def _by_join(docs: DataFrame, items: DataFrame, clean: bool, name: str) -> DataFrame:
    """For a benchmark of any size: windows of both sides meet by a 192-bit digest of their words, then are verified.

    A window is one row of its own side, with its words, however many items hold it; the items join the distinct windows of
    each document afterwards. Each window has SALTS copies for the documents' rows to choose from by their place.
    """

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(_digest(list(w)), item, len(w), b" ".join(w)) for item, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True) for w in windows_of(words_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in ((0, pa.binary()), (1, pa.string()), (2, pa.int32()), (3, pa.binary()))], ["key", "item_id", "size", "win"])

    rows = cut(docs.select(F.expr("uuid()").alias("row"), "text", F.struct(*quoted(docs)).alias("doc")), "rows")
    theirs = cut(items.mapInArrow(item_windows, "key binary, item_id string, size int, win binary").distinct(), "windows")
    sizes = sorted(r["size"] for r in theirs.select("size").distinct().collect())  # at most WINDOW values
    # two texts with one digest are two rows, and only the one with the document's words survives
    windows = theirs.select("key", "size", "win").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                words, start = words_of(text), zlib.crc32(row.encode())
                for size in sizes:
                    n = len(words) - size + 1
                    for a in range(0, max(0, n), 50_000):
                        at = range(a, min(n, a + 50_000))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row] * len(at)), pa.array([_digest(words[i : i + size]) for i in at]), pa.array(at, pa.int64()), pa.array([start + i for i in at], pa.int64())],
                            ["row", "key", "at", "turn"],
                        )

    ours = rows.select("row", "text").mapInArrow(doc_windows, "row string, key binary, at long, turn long").withColumn("salt", F.pmod("turn", F.lit(SALTS)).cast("int")).drop("turn")
    met = cut(ours.join(windows, ["key", "salt"]).select("row", "key", "at", "size", "win"), "met")
    spans = met.groupBy("row").agg(F.collect_list(F.struct("at", "size", "win")).alias("spans"))
    of_row = met.select("row", "key", "win").distinct().join(theirs.select("key", "win", "item_id"), ["key", "win"])
    items_of = of_row.groupBy("row").agg(F.collect_set(F.struct("win", "item_id")).alias("items"))

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for text, s, m in zip(raw_bytes(texts), spans.to_pylist(), items.to_pylist(), strict=True):
            words = words_of(text)
            real = [x for x in s or () if b" ".join(words[x["at"] : x["at"] + x["size"]]) == x["win"]]
            seen = {x["win"] for x in real}
            out.append(judged(text, len(words), [(x["at"], x["size"]) for x in real], {x["item_id"] for x in m or () if x["win"] in seen}, clean))
        return pa.array(out, RESULT_ARROW)

    joined = rows.join(spans, "row", "left").join(items_of, "row", "left")
    return joined.select("doc", judge.asNondeterministic()("text", "spans", "items").alias("hit")).select("doc.*", F.col("hit").alias(name))


def scan(docs: DataFrame, benchmark: DataFrame, clean: bool = False, max_bytes: int = MAX_BROADCAST_BYTES, name: str | None = None) -> DataFrame:
    """docs with a struct column __hit, or the given name (see RESULT); clean: also the text without its hit spans."""
    items = _items(benchmark)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    return (_by_broadcast if size <= max_bytes else _by_join)(docs, items, clean, name or free_name(docs, "hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs.select("doc_id", "text"), benchmark, name="hit", **options).select("doc_id", *[f"hit.{f.name}" for f in RESULT.fields[:-1]])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    name = free_name(docs, "hit")
    return scan(docs, benchmark, name=name, **options).filter(~F.col(name)["contaminated"]).select(*quoted(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, hit spans cut out of their text."""
    name = free_name(docs, "hit")
    out = scan(docs, benchmark, clean=True, name=name, **options)
    return out.withColumn("text", F.coalesce(F.col(name)["clean_text"], "text")).select(*quoted(docs))
