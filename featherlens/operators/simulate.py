"""Synthetic matrices with known decoupling: the ground truth of the whole chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import moments, overlap, ranking


@dataclass(frozen=True)
class Scenario:
    """Four kinds of features: share of all features, variance between classes, variance within."""

    name: str
    kinds: tuple[tuple[float, float, float], ...]
    samples: int = 200
    features: int = 400
    classes: int = 2

    def __post_init__(self) -> None:
        if abs(sum(k[0] for k in self.kinds) - 1) > 1e-9 or any(min(k) < 0 for k in self.kinds):
            raise ValueError("shares must sum to one and nothing may be negative")


SCENARIOS = {
    "coupled": Scenario("coupled", ((0.1, 4.0, 1.0), (0.2, 0.5, 1.0), (0.2, 0.05, 1.0), (0.5, 0.0, 0.5))),
    "decoupled": Scenario("decoupled", ((0.1, 0.5, 1.0), (0.2, 0.2, 1.0), (0.2, 0.0, 1.2), (0.5, 0.0, 1.0))),
    "anti_aligned": Scenario("anti_aligned", ((0.1, 0.3, 0.2), (0.2, 0.0, 4.0), (0.2, 0.0, 2.0), (0.5, 0.0, 1.0))),
}


def _normal(*parts) -> object:
    """A standard normal number from the hash of parts, so that draws don't hang on partitions (Box-Muller)."""
    u = [(F.pmod(F.xxhash64(F.lit(i), *parts), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40) for i in (1, 2)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * 3.141592653589793 * u[1])


def matrix(spark: SparkSession, s: Scenario, seed: int) -> DataFrame:
    """view, sample_id, feature, x, label: class means N(0, between), centred; values N(mean, within), jittered by feature."""
    f = spark.range(s.features).withColumnRenamed("id", "feature_ord")
    bounds, start = [], 0.0
    for share, b, w in s.kinds:
        bounds.append((start * s.features, (start + share) * s.features, b, w))
        start += share
    pick = lambda i: F.coalesce(*[F.when((F.col("feature_ord") >= lo) & (F.col("feature_ord") < hi), F.lit(v[i])) for lo, hi, *v in bounds], F.lit(s.kinds[-1][i + 1]))
    jitter = 0.8 + 0.4 * F.pmod(F.xxhash64(F.lit(seed), F.lit("j"), "feature_ord"), F.lit(1 << 20)) / float(1 << 20)
    f = f.select("feature_ord", F.format_string("f%05d", "feature_ord").alias("feature"), (pick(0) * jitter).alias("between"), (pick(1) * jitter).alias("within"))
    means = f.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(s.classes - 1)))).withColumn("m", _normal(F.lit(seed), F.lit("m"), F.col("feature_ord"), F.col("c")))
    centre = means.groupBy("feature_ord").agg(F.avg("m").alias("mm"))
    means = means.join(centre, "feature_ord").select("feature_ord", "feature", "within", F.col("c").cast("long").alias("label"), ((F.col("m") - F.col("mm")) * F.sqrt("between")).alias("mu"))
    samples = spark.range(s.samples).select(F.col("id").alias("sample_id"), (F.col("id") % s.classes).alias("label"))
    x = F.col("mu") + F.sqrt("within") * _normal(F.lit(seed), F.lit("x"), F.col("feature_ord"), F.col("sample_id"))
    return samples.join(means, "label").select(F.lit(s.name).alias("view"), "sample_id", "feature", x.alias("x"), "label")


def di_curve(values: DataFrame, k_pcts: list[int]) -> DataFrame:
    """K grid of the variance rank against the Fisher rank."""
    v = moments.marginal_variance(values, ["view"]).select("view", "feature", "variance")
    j = v.join(moments.fisher(values, ["view"]), ["view", "feature"])
    j = ranking.ranked(ranking.ranked(j, ["view"], "variance", out="v"), ["view"], "score", out="p")
    return overlap.k_grid(j, ["view"], "v", "p", k_pcts)


def sweep(spark: SparkSession, ratios: list[float], seeds: int, k_pct: int = 10) -> DataFrame:
    """ratio, di_mean, di_sd: DI over seeds as the noise features' variance grows against the signal's; one plan for all."""
    parts = None
    for r in ratios:
        s = Scenario(f"r{r:g}", ((0.1, 1.0, 0.5), (0.3, 0.0, 0.5 + r), (0.6, 0.0, 0.5), (0.0, 0.0, 0.0)), samples=60, features=100)
        for seed in range(seeds):
            m = matrix(spark, s, seed).withColumn("view", F.lit(f"{r:g}|{seed}"))
            parts = m if parts is None else parts.unionByName(m)
    g = di_curve(parts, [k_pct])
    return g.groupBy(F.split_part("view", F.lit("|"), F.lit(1)).cast("double").alias("ratio")).agg(F.avg("di").alias("di_mean"), F.stddev_samp("di").alias("di_sd"))
