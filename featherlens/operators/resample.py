"""Draws by hash order: the order of md5(seed, draw, id) is the same in any engine and any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the text of parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_order(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def capped(rows: DataFrame, keys: list[str], name: str, n: int, seed: int) -> DataFrame:
    """n rows of each view, without replacement."""
    order = Window.partitionBy(*keys).orderBy(hash_order(seed, F.col(name)), name)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def random_sets(names: DataFrame, keys: list[str], name: str, k: int, draws: int, seed: int) -> DataFrame:
    """draws sets of k names each, as rows with draw."""
    rows = names.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = Window.partitionBy(*keys, "draw").orderBy(hash_order(seed, F.col("draw"), F.col(name)), name)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def permuted(samples: DataFrame, within: list[str], label: str, perms: int, seed: int, sample: str = "sample_id") -> DataFrame:
    """sample, perm, label: the labels shuffled over all samples, or within groups.

    Two numberings of all rows, by sample and by hash, both by (perm, group) first: so the n-th of one and of the other are of
    one group, which may span tasks.
    """
    rows = samples.select(sample, label, *within).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    group = [F.col("perm"), *map(F.col, within)]
    slots = ranking.numbered(rows.select(sample, "perm", *within), [*group, F.col(sample)], "_n")
    dealt = rows.select(F.col(sample).alias("_s"), "perm", *within, F.col(label).alias("_l"), hash_order(seed, F.col("perm"), F.col(sample)).alias("_h"))
    order = ranking.numbered(dealt, [*group, F.col("_h"), F.col("_s")], "_n").select("_n", F.col("_l").alias(label))
    return slots.join(order, "_n").select("perm", *within, sample, label)


def bootstrap(rows: DataFrame, strata: list[str], draws: int, seed: int, sample: str = "sample_id") -> DataFrame:
    """draws resamples with replacement of the size of each stratum: rows' columns and draw. A stratum may span tasks."""
    placed = ranking.numbered(rows, [*map(F.col, strata), F.col(sample)], "_place")
    own = [f"_of{i}" for i in range(len(strata))]
    ends = placed.groupBy(*[F.col(s).alias(o) for s, o in zip(strata, own, strict=True)]).agg(F.min("_place").alias("_first"), F.count("*").alias("_m"))
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(o)) for s, o in zip(strata, own, strict=True)], F.lit(True))
    slots = placed.select(*strata, "_place").join(ends, same).withColumn("_i", (F.col("_place") - F.col("_first") + 1).cast("int"))
    picks = slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = F.floor(unit(F.lit(str(seed)), F.col("draw").cast("string"), F.col("_i").cast("string"), *[F.col(s).cast("string") for s in strata]) * F.col("_m"))
    return picks.select(*strata, "draw", (F.col("_first") + place).alias("_place")).join(placed.drop(*strata), "_place").drop("_place")
