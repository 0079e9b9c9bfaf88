"""Exact top-k inner-product search by distributed histogram selection.

Every query's scores against all rows are counted in a histogram of BINS equal bins over the possible range; the counts
of all tasks are summed, and the bin that holds the k-th highest score becomes the range of the next pass. Bin widths are
powers of two, so the passes are few (about log(range)/log(BINS)) and end either when the bin can't be split, its rows
then being ties, or when few rows more than k lie at or above its lower edge for every query. A last pass keeps what is at
or above the edge; each task reduces its own rows to the first k by (score, smaller id), which loses none of the global
first k however many rows tie, and the final order is taken over those few.

Queries go in blocks of BLOCK, so that what is broadcast, and what the driver holds (a range per query), is bounded. A
block's rows are written as they are found, and the final order is one pass over all of them.

Inner products are exact whatever the size of the components. Vectors whose products with one another stay below 2**53
take part in the histograms, as doubles. Any larger vectors of the table (wide ones, one outlier or all of them) are kept
apart and scored in integers as long as needed; each task keeps its first k of them for each query. A score beyond a long
integer is returned as the nearest one, but ranks by its exact value.

Vectors that are null or hold null or non-finite components take no part. A query's own row is every row with its id; a
query row that is repeated is answered once, repeated candidate rows are candidates each. Only vectors of the query's
length are compared; an id with vectors of two lengths is two queries. Null ids are no queries and rank last among ties.
Ids are taken as long integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path

K = 10
SCALE = 1024
QUERY_STEP = 100
BLOCK = 16_384
BINS = 128
#: Scores that a task computes at once.
CHUNK = 2_000_000
#: Refinement ends once no query has more than this many rows at or above its bin's edge beyond k.
SPARE = 64
NO_ID = np.iinfo(np.int64).max
LONG = (-(1 << 63), (1 << 63) - 1)
#: Bytes of an exact score in an order-keeping form: products of two doubles scaled by SCALE, and room for their sum.
WIDE_BYTES = 272
FOUND = "block int, q long, query_id long, vec_id long, score long, exact binary"


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x, wide): x times SCALE is the vector in integers, components floor(SCALE * x); wide: too large for doubles."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def floored(c):
        y = c * SCALE
        down = F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)
        return F.when(F.abs(c) < float(1 << 52), down / SCALE).otherwise(c)  # from there on all doubles are whole

    rows = table.filter(x.isNotNull() & finite).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: floored(c.cast("double"))).alias("x"))
    largest = F.coalesce(F.array_max(F.transform("x", lambda c: F.abs(c))), F.lit(0.0)) * SCALE
    return rows.withColumn("wide", F.size("x") * largest * largest >= float(1 << 53))


def integers(vectors: list[list[float]]) -> np.ndarray:
    """Exact components, as Python integers."""
    out = np.empty((len(vectors), len(vectors[0]) if vectors else 0), object)
    for i, v in enumerate(vectors):
        out[i] = [int(c * SCALE) if abs(c) < 1e300 else int(c) * SCALE for c in v]
    return out


class Queries:
    """A block of queries of one length, and how to score rows against it."""

    def __init__(self, number: int, ids: list[int], vectors: list[list[float]], wide: bool, largest: float) -> None:
        """largest: of the absolute components of rows that aren't wide, scaled."""
        self.number, self.ids, self.dim, self.wide = number, np.array(ids, np.int64), len(vectors[0]), wide
        self.vectors = vectors
        if not wide:
            self.matrix = np.array(vectors, np.float64).reshape(len(ids), self.dim) * SCALE
            self.bound = int(np.abs(self.matrix).max(initial=0) * largest) * max(1, self.dim)

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            x = batch.column("x")
            ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), self.dim)
            step = max(1, CHUNK // len(self.ids))
            for a in range(0, len(ids), step):
                yield ids[a : a + step], rows[a : a + step]

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row ids, scores of queries x rows, which pairs count), in doubles."""
        for ids, rows in self._rows(batches):
            yield ids, self.matrix @ (rows * SCALE).T, self.ids[:, None] != ids[None, :]

    def exact_blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same in Python integers."""
        mine = integers(self.vectors)
        for ids, rows in self._rows(batches):
            yield ids, mine @ integers(rows.tolist()).T, self.ids[:, None] != ids[None, :]


def _count(rows: DataFrame, block, low: np.ndarray, width: int) -> DataFrame:
    """For each query the number of scores in each of BINS bins from low, of all tasks together: (q, bin, n, upto)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        counts = np.zeros(len(q.ids) * BINS, np.int64)
        base = np.arange(len(q.ids), dtype=np.int64)[:, None] * BINS
        for _, scores, mask in q.blocks(batches):
            bins = ((scores - low.astype(np.float64)[:, None]) // width).astype(np.int64)
            at = (base + bins)[mask & (bins >= 0) & (bins < BINS)]
            counts += np.bincount(at, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at // BINS), pa.array(at % BINS), pa.array(counts[at])], ["q", "bin", "n"])

    sums = rows.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    return sums.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))


def lower_edges(rows: DataFrame, block, k: int) -> np.ndarray:
    """For each query a score at or below its k-th highest, with few rows or only ties from there to it."""
    q = block.value
    width = 1
    while width * BINS < 2 * q.bound + 2:
        width *= 2
    low, need = np.full(len(q.ids), -q.bound - 1, np.int64), np.full(len(q.ids), k, np.int64)
    while True:
        needed = rows.sparkSession.createDataFrame(pa.table({"q": np.arange(len(need)), "need": need}))
        found = _count(rows, block, low, width).join(F.broadcast(needed), "q")
        # the highest bin that reaches need; if all rows are fewer than k there is none, the range stays and everything counts
        hits = found.filter("upto >= need").groupBy("q").agg(F.max(F.struct("bin", "n", "upto")).alias("hit")).select("q", "hit.*").toArrow()  # one row a query of the block
        at, n = hits["q"].to_numpy(), hits["n"].to_numpy()
        low[at] += hits["bin"].to_numpy() * width
        need[at] -= hits["upto"].to_numpy() - n
        if width == 1 or (n - need[at]).max(initial=0) <= SPARE:
            return low
        width = max(1, width // BINS)


def ordered(score: int) -> bytes:
    """Bytes that compare as the scores do."""
    return (score + (1 << (8 * WIDE_BYTES - 1))).to_bytes(WIDE_BYTES, "big")


def _first(rows: DataFrame, block, k: int, low: np.ndarray | None, exact: bool) -> DataFrame:
    """Each task's first k rows for each query; low: at or above it, scored in doubles; exact: with the order-keeping form."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64 if low is not None else object), np.zeros(0, np.int64)]
        for ids, scores, mask in q.blocks(batches) if low is not None else q.exact_blocks(batches):
            at, j = np.nonzero((scores >= low.astype(np.float64)[:, None]) & mask if low is not None else mask)
            found = scores[at, j]
            at, score, row = (np.concatenate(x) for x in zip(best, (at, found.astype(best[1].dtype), ids[j]), strict=True))
            order = np.lexsort((row, -score, at)) if low is not None else np.array(sorted(range(len(at)), key=lambda i: (at[i], -score[i], row[i])), np.int64)
            at = at[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            best = [at[first], score[order][first], row[order][first]]
        at, score, row = best
        plain = [min(max(int(s), LONG[0]), LONG[1]) for s in score.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at), q.number, np.int32)),
                pa.array(at),
                pa.array(q.ids[at]),
                pa.array(row, mask=row == NO_ID),
                pa.array(plain, pa.int64()),
                pa.array([ordered(int(s)) if exact else None for s in score.tolist()], pa.binary()),
            ],
            ["block", "q", "query_id", "vec_id", "score", "exact"],
        )

    return rows.select("vec_id", "x").mapInArrow(keep, FOUND)


def top_k(table: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by query_step its k best other rows."""
    spark = table.sparkSession
    rows = cut(integer_vectors(table), "vectors")
    largest = rows.filter("not wide").agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))) * SCALE).first()[0] or 0.0
    queries = cut(rows.filter(F.col("vec_id") % query_step == 0).distinct(), "queries")
    wide_rows = {r.dim for r in rows.filter("wide").select(F.size("x").alias("dim")).distinct().collect()}  # one row a vector length
    paths, number = [], 0

    def kept(found: DataFrame) -> None:
        paths.append(fresh_path(spark, "found"))
        found.write.parquet(paths[-1])

    for dim, wide, n in sorted(map(tuple, queries.groupBy(F.size("x").alias("dim"), "wide").count().collect())):
        same = rows.filter(F.size("x") == dim)
        blocks = -(-n // BLOCK)
        for b in range(blocks):
            mine = queries.filter((F.size("x") == dim) & (F.col("wide") == wide) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "x").toArrow()  # about BLOCK rows
            if not mine.num_rows:
                continue
            block = spark.sparkContext.broadcast(Queries(number, mine["vec_id"].to_pylist(), mine["x"].to_pylist(), wide, largest))
            number += 1
            if wide:
                kept(_first(same, block, k, None, True))
                continue
            narrow = same.filter("not wide").select("vec_id", "x")
            kept(_first(narrow, block, k, lower_edges(narrow, block, k), dim in wide_rows))
            if dim in wide_rows:
                kept(_first(same.filter("wide"), block, k, None, True))
    if not paths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(FOUND).parquet(*paths)
    # exact is there for all rows of a query or for none
    order = Window.partitionBy("block", "q").orderBy(F.desc("exact"), F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
