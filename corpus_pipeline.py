"""A training corpus from documents in five stages; each takes what the one before kept.

Quality classifier (documents scored under 0.5 go), SimHash near-dedup (one document of each group stays), benchmark
decontamination (contaminated documents go), mixing sources to target weights (budgeted copies), sharding (shuffled shard
and slot of every row). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featherlens.llm import decontaminate, mix, quality, shard, simhash
from featherlens.llm.common import cut, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled rows of all documents, as its own query does; it scores docs."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By op2's rule: fingerprints of 4-word shingles that differ in at most 4 of 64 bits, linked to components.

    Of pairs at a Jaccard similarity of 0.8, 0.9 and 0.95 it links 3 %, 15 % and 65 % (see the README).
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard.shard_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("sharding", sharding),
]

#: Classifier, components and permutation aren't SQL; tests/llm/test_pipeline.py holds a plain version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
