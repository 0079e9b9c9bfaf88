"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """About per_class[y] rows (doc_id, text, y) of each label y chosen by the hash of their id, and how many ids carry y.

    labels: the rows that may be learned from. Null ids and labels other than 0 and 1 are left out; of an id with both
    labels, 1 counts. Null texts count as empty. The id alone decides, whatever the text's length. The ids (at most about
    sum(per_class)) are broadcast. Repeated rows of an id and text count once; should ids with many texts make the sample
    larger than twice sum(per_class), its rows are thinned to about that by the hash of id and text.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    part = lambda y: int((1 << 30) * min(1.0, per_class[y] / max(1, counts.get(y, 0))))
    ids = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("y") == 1, F.lit(part(1))).otherwise(F.lit(part(0))))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
    most, row = 2 * sum(per_class), F.xxhash64("doc_id", "text")
    n = rows.select(row.alias("h")).distinct().count()
    if n > most:
        rows = rows.filter(F.pmod(row, F.lit(1 << 30)) < (1 << 30) * most // n)
    return rows.dropDuplicates(), counts


def measured(sample: DataFrame, measure: Callable[[bytes], bytes]) -> list[tuple[bytes, int]]:
    """(measure(text), y) of each sampled text, in the order of the texts' hashes; ids only order equal texts of one label.

    Whole texts are measured by the executors; the driver gets the measures alone, whose size measure() has to bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *(batch.column(i) for i in (2, 0, 3))], ["m", "y", "id", "hash"])

    rows = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y", F.xxhash64("text").alias("hash")).mapInArrow(run, "m binary, y int, id string, hash long")
    got = rows.toArrow()
    return [(m, y) for _, y, _, m in sorted(zip(*(got[c].to_pylist() for c in ("hash", "y", "id", "m")), strict=True))]
