"""Ranked lexical search: integer BM25-like scores of all documents for each item, by windows of document ids.

One pass over the texts counts the items' terms in every document and writes them as postings. These are dealt by windows of
WINDOW consecutive ids. A task goes through its windows one by one: it orders a window's postings by term, and for each item
adds the terms' scores into an array with one slot a document, small enough for a processor's cache, marks the slots in use,
harvests them into the item's heap of the k best and clears them again. The heaps of all tasks are merged by two ranks, first
in parts of an item.

Items whose texts are over BLOCK_BYTES in all are answered in blocks, each with its own pass, so that the vocabulary that goes
to every task is bounded. Terms, counts and scores are over whole texts; no document is skipped.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, raw_bytes

TOP = 50
#: Ids of one window, and the most rows that are scored at once.
WINDOW = 2048
BLOCK_BYTES = 8 << 20
#: Bytes of a text that are split into terms at once.
PIECE = 4 << 20
#: Parts an item's hits are ranked in first.
PARTS = 16
#: Terms are runs of ASCII letters, digits and all bytes of characters beyond ASCII; A-Z are lower-cased.
TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a bounded part at a time."""
    plain, at = text.translate(TERM_BYTES), 0
    while len(plain) - at > PIECE:
        end = plain.rfind(b" ", at, at + PIECE)
        end = end if end > at else plain.find(b" ", at + PIECE)
        if end < 0:
            break
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


class Query:
    """A block of items: their ids' places, their distinct terms as numbers, and the numbers of all terms."""

    def __init__(self, texts: list[bytes]) -> None:
        self.number: dict[bytes, int] = {}
        self.terms = [sorted({self.number.setdefault(t, len(self.number)) for part in pieces(x) for t in part}) for x in texts]


def postings(docs: DataFrame, query: Query) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and the counts of the query's terms in it."""
    number = docs.sparkSession.sparkContext.broadcast(query.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        known = of.__contains__
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in raw_bytes(batch.column(1)):
                n, found = 0, Counter()
                for part in pieces(text):
                    n += len(part)
                    found.update(filter(known, part))
                sizes.append(n)
                terms.append([of[t] for t in found])
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The k highest (score, then smaller id) of one item; rows without an id come last among ties."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def add(self, scores: np.ndarray, ids: list[int | None], slots: np.ndarray) -> None:
        if len(self.heap) == self.k:
            keep = scores >= self.heap[0][0]
            scores, slots = scores[keep], slots[keep]
        if len(scores) > self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            scores, slots = scores[keep], slots[keep]
        for score, slot in zip(scores.tolist(), slots.tolist(), strict=True):
            entry = (score, -math.inf if ids[slot] is None else -ids[slot])
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def length_terms(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """50 + 50 n N div L; in Python's integers where 64 bits would not hold the product."""
    if int(n.max(initial=0)) * 50 * docs < 1 << 63:
        return 50 + 50 * n * docs // terms
    return np.array([50 + 50 * x * docs // terms for x in n.tolist()], np.int64)


def score_window(ids: list, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, wanted: list[list[int]], weight: np.ndarray, docs: int, total: int, best: list[Best]) -> None:
    """Adds one window's documents to the items' heaps. lengths: how many of terms and tfs each document has."""
    slots = np.repeat(np.arange(len(ids)), lengths)
    part = 1_000_000_000 * tfs // (1000 * tfs + 20 * length_terms(n, docs, total)[slots])
    order = np.argsort(terms, kind="stable")
    slots, part = slots[order], (part * weight[terms])[order]
    starts = np.searchsorted(terms[order], np.arange(len(weight) + 1))
    sums, used = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    for own, heap in zip(wanted, best, strict=True):
        for t in own:
            a, b = starts[t], starts[t + 1]
            if a < b:
                sums[slots[a:b]] += part[a:b]
                used[slots[a:b]] = True
        found = np.flatnonzero(used)
        if len(found):
            scores = sums[found]
            heap.add(scores[scores > 0], ids, found[scores > 0])
            sums[found], used[found] = 0, False


def search_block(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of one block of items."""
    spark = docs.sparkSession
    query = Query(raw_bytes(items["text"]))
    written = cut(postings(docs, query), "postings")
    size = written.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counts = written.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row a term of the block at most
    df = np.zeros(len(query.number), np.int64)
    df[counts["t"].to_numpy()] = counts["count"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((query.terms, weight, size.docs, size.terms))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, n_docs, n_terms = shared.value
        best = [Best(k) for _ in wanted]
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(at, prepend=at[:1] - 1, append=at[-1:] + 1)).tolist()
            for low, high in zip(edges, edges[1:]):
                for a in range(low, high, WINDOW):
                    b = min(high, a + WINDOW)
                    terms, tfs = batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)
                    score_window(
                        batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_numpy(), terms.value_lengths().to_numpy(),
                        terms.flatten().to_numpy(), tfs.flatten().to_numpy(), wanted, weights, n_docs, n_terms, best,
                    )
        rows = [(i, None if -d == math.inf else int(-d), s) for i, x in enumerate(best) for s, d in x.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    window = F.coalesce(F.floor(F.col("doc_id") / WINDOW), F.lit(-1)).cast("long").alias("window")
    dealt = written.filter(F.size("terms") > 0).select(window, "doc_id", "n", "terms", "tfs").repartition("window").sortWithinPartitions("window", "doc_id")
    hits = dealt.mapInArrow(score, "item int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    parts = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    hits = hits.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int32()), "item_id": items["item_id"]}))
    return hits.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents with the highest scores above 0, ties by ascending doc_id.

    docs: doc_id (taken as a long), text. items: item_id, text. Other columns are ignored, whatever their names. A null or empty
    text has no terms. Rows count and rank each by itself, repeated ones too; a null doc_id comes last among ties. Rows of
    items are answered each by itself. Items without a document that scores, and an empty table, give no rows.
    """
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        found = search_block(docs, own.toArrow(), k)
        out = found if out is None else out.unionByName(found)
    return out
