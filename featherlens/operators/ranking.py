"""Ranks under declared tie rules, K rules and top-K selection.

Every window is partitioned by the view's keys; ties are broken by a column, never by the order of input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks


def rank_column(keys: list[str], score: str, tie: str = "name", name: str = "feature", descending: bool = True) -> Column:
    """tie: 'name' (1..n by name), 'min', 'dense', 'average'."""
    order = F.desc(score) if descending else F.asc(score)
    by = Window.partitionBy(*keys)
    if tie == "name":
        return F.row_number().over(by.orderBy(order, name)).cast("long")
    if tie == "min":
        return F.rank().over(by.orderBy(order)).cast("long")
    if tie == "dense":
        return F.dense_rank().over(by.orderBy(order)).cast("long")
    if tie == "average":
        return F.rank().over(by.orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, score)) - 1) / 2
    raise ValueError(f"unknown tie rule {tie!r}")


def ranked(scores: DataFrame, keys: list[str], score: str, tie: str = "name", out: str = "rank", name: str = "feature", descending: bool = True) -> DataFrame:
    return scores.withColumn(out, rank_column(keys, score, tie, name, descending))


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with their place, from 1, in a total order of the whole table, which no single task sorts.

    A range shuffle sorts and is written; each partition numbers its own rows, and the partitions' offsets, a row each, are
    broadcast.
    """
    spark = rows.sparkSession
    path = sinks.workspace(spark, "ranged")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    ranged = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


def ranked_whole(scores: DataFrame, score: str, tie: str = "name", out: str = "rank", name: str = "feature", descending: bool = True) -> DataFrame:
    """ranked() without keys, for tables of any size: ranks over the whole table by a range shuffle."""
    order = F.desc(score) if descending else F.asc(score)
    if tie == "name":
        return numbered(scores, [order, F.asc(name)], out)
    if tie not in ("min", "dense", "average"):
        raise ValueError(f"unknown tie rule {tie!r}")
    places = numbered(scores, [order, F.asc(name)], "_place").groupBy(score).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    if tie == "dense":
        ranks = numbered(places, [order], "_rank").select(F.col(score).alias("_s"), "_rank")
    else:
        ranks = places.select(F.col(score).alias("_s"), (F.col("_first") + ((F.col("_n") - 1) / 2 if tie == "average" else F.lit(0))).alias("_rank"))
    return scores.join(ranks, F.col(score).eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("_rank", out)


def average_ranks(rows: DataFrame, keys: list[str], score: str, times: str | None = None) -> DataFrame:
    """keys, score, _rank, _n of the distinct scores of each key: mean ascending rank, and how many rows the key has.

    times: a column of how often a row counts.

    Rows are counted by score first; one range shuffle of the counts by keys and score gives the rows below each, so neither a
    key's rows nor its scores meet in one task.
    """
    spark = rows.sparkSession
    path, order = sinks.workspace(spark, "counted"), [*keys, score]
    counts = rows.groupBy(*keys, score).agg((F.sum(times) if times else F.count("*")).alias("_rows"))
    counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    ranged = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    below = lambda by: F.coalesce(F.sum("_rows").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranged.groupBy("_part").agg(F.sum("_rows").alias("_rows")).select("_part", below(Window.orderBy("_part")).alias("_before"))  # a row a part
    placed = ranged.withColumn("_below", below(Window.partitionBy("_part").orderBy("_at"))).join(F.broadcast(before), "_part")
    placed = placed.select(*order, "_rows", (F.col("_below") + F.col("_before")).alias("_below"))
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_below").alias("_first"), F.sum("_rows").alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    placed = placed.join(first, same) if keys else placed.crossJoin(F.broadcast(first))
    return placed.select(*order, (F.col("_below") - F.col("_first") + (F.col("_rows") + 1) / 2).alias("_rank"), "_n")


def percentile_from_rank(keys: list[str], rank: str) -> Column:
    """1 for the first, 0 for the last of ranks 1..n; 1 when n is 1."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(n <= 1, 1.0).otherwise(1 - (F.col(rank) - 1) / (n - 1))


def rank_share(keys: list[str], rank: str) -> Column:
    """rank / n."""
    return F.col(rank) / F.count("*").over(Window.partitionBy(*keys))


def rescaled(keys: list[str], x: str) -> Column:
    """0..100 between a view's minimum and maximum; 50 for a constant."""
    by = Window.partitionBy(*keys)
    lo, hi = F.min(x).over(by), F.max(x).over(by)
    return F.when(hi == lo, 50.0).otherwise((F.col(x) - lo) / (hi - lo) * 100)


def k_count(n: Column, k_pct: Column, rule: str = "floor") -> Column:
    """How many of n features K percent are, at least one and at most n."""
    raw = n.cast("double") * k_pct / 100
    if rule == "floor":
        k = F.floor(raw)
    elif rule == "ceil":
        k = F.ceil(raw)
    elif rule == "round":
        k = F.bround(raw)  # half to even
    else:
        raise ValueError(f"unknown K rule {rule!r}")
    return F.least(n.cast("long"), F.greatest(F.lit(1), k.cast("long")))


def with_k(df: DataFrame, k_pcts: list[int]) -> DataFrame:
    """Each row once for each K; a fixed handful of values, so no join is needed."""
    return df.withColumn("k_pct", F.explode(F.array(*map(F.lit, k_pcts))))


def consensus(ranks: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Mean of the models' ranks of each feature, ranked again by (mean, feature)."""
    mean = ranks.groupBy(*keys, "feature").agg(F.avg(rank).alias("mean_rank"))
    return ranked(mean, keys, "mean_rank", descending=False, out="consensus_rank")


def dedup_max(rows: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """The row with the highest score of each feature (first by ordinal among ties), ranked again with its share."""
    order = Window.partitionBy(*keys, "feature").orderBy(F.desc(score), ordinal)
    kept = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    kept = ranked(kept, keys, score)
    return kept.withColumn("rank_pct", rank_share(keys, "rank"))


def top_n(rows: DataFrame, keys: list[str], score: str, n: int, name: str = "feature") -> DataFrame:
    """The first n of each view; a literal bound, so partial windows drop the rest before the shuffle."""
    return ranked(rows, keys, score, name=name).filter(F.col("rank") <= n)
