"""Set overlap of top-K features and the decoupling index (DI).

Sets are flags on ranked rows, so intersections and unions are conditional counts in one aggregate; no set is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import k_count, with_k


def jaccard(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    """Aggregate: |A and B| / |A or B| of two flags; empty: what two empty sets give (1, 0 or NULL)."""
    both, either = F.sum((a & b).cast("long")), F.sum((a | b).cast("long"))
    return F.when(either == 0, F.lit(empty).cast("double")).otherwise(both / either)


def j_rand(q: Column) -> Column:
    """Expected Jaccard of two random subsets with share q."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))
    return q / (2 - q)


def expected_jaccard(n: Column, ka: Column, kb: Column) -> Column:
    """Expected Jaccard of random subsets of ka and kb out of n; NULL without elements."""
    both = ka * kb / n
    return F.try_divide(both, ka + kb - both)


def delta_j(j: Column, q: Column) -> Column:
    return j - j_rand(q)


def j_tilde(j: Column, q: Column) -> Column:
    """Chance-corrected Jaccard; 0 where nothing is left to gain."""
    r = j_rand(q)
    return F.when(1 - r <= 0, 0.0).otherwise((j - r) / (1 - r))


def di(j: Column, q: Column) -> Column:
    return 1 - j_tilde(j, q)


def di_stable(j: Column, q: Column) -> Column:
    """The same without cancellation: (1 - J) / (1 - J_rand); 0, not 1, where nothing is left to gain."""
    r = j_rand(q)
    return F.when(1 - r <= 0, 0.0).otherwise((1 - j) / (1 - r))


def k_grid(joined: DataFrame, keys: list[str], v_rank: str, p_rank: str, k_pcts: list[int], k_rule: str = "floor", q_rule: str = "nominal", empty: float | None = 1.0) -> DataFrame:
    """k_n, q, j_obs, j_rand, delta_j, tilde_j, di for each K; ranks may tie, sets are rank <= k."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = with_k(joined.withColumn("_n", n), k_pcts).withColumn("k_n", k_count(F.col("_n"), F.col("k_pct"), k_rule))
    a, b = F.col(v_rank) <= F.col("k_n"), F.col(p_rank) <= F.col("k_n")
    out = rows.groupBy(*keys, "k_pct").agg(F.max("k_n").alias("k_n"), F.max("_n").alias("n"), F.sum((a & b).cast("long")).alias("overlap"), jaccard(a, b, empty).alias("j_obs"))
    q = F.col("k_pct") / 100.0 if q_rule == "nominal" else F.col("k_n") / F.col("n")
    j, q = F.col("j_obs"), F.col("q")
    return out.withColumn("q", F.col("k_pct") / 100.0 if q_rule == "nominal" else F.col("k_n") / F.col("n")).withColumns(
        {"j_rand": j_rand(q), "delta_j": delta_j(j, q), "tilde_j": j_tilde(j, q), "di": di(j, q)}
    )


def f_di(joined: DataFrame, keys: list[str], v_rank: str, p_rank: str, k_pct: int) -> DataFrame:
    """keys, f_di: DI with the realised share; 0 if all features are in, NULL for fewer than three."""
    g = k_grid(joined, keys, v_rank, p_rank, [k_pct], q_rule="realised")
    return g.select(*keys, F.when(F.col("n") < 3, None).when(F.col("k_n") >= F.col("n"), 0.0).otherwise(F.col("di")).alias("f_di"))


def trapezoid(curve: DataFrame, keys: list[str], x: str, y: str, out: str = "auc") -> DataFrame:
    """Area under y over x by neighbours; NULL for fewer than two points."""
    w = Window.partitionBy(*keys).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias(out))


def quadrants(rows: DataFrame, v_rank: str, p_rank: str, k: Column) -> DataFrame:
    """in_v, in_p and the four quadrants."""
    v, p = F.col(v_rank) <= k, F.col(p_rank) <= k
    return rows.withColumns({"in_v": v, "in_p": p, "q1_both": v & p, "q2_v_only": v & ~p, "q3_neither": ~v & ~p, "q4_p_only": ~v & p})


def pairwise_jaccard(flags: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Jaccard of each two units' (repeats', models') sets; flags: keys, unit, feature, in_set."""
    sets = flags.filter("in_set").select(*keys, unit, "feature")
    sizes = sets.groupBy(*keys, unit).count()
    a, b = sets.withColumnRenamed(unit, "a"), sets.withColumnRenamed(unit, "b")
    both = a.join(b, [*keys, "feature"]).filter("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("both"))
    sa, sb = sizes.withColumnsRenamed({unit: "a", "count": "na"}), sizes.withColumnsRenamed({unit: "b", "count": "nb"})
    pairs = (sa.join(sb, keys) if keys else sa.join(sb)).filter("a < b")
    both_n = F.coalesce("both", F.lit(0))
    return pairs.join(both, [*keys, "a", "b"], "left").select(*keys, "a", "b", (both_n / (F.col("na") + F.col("nb") - both_n)).alias("jaccard"))


def group_leakage(folds: DataFrame, keys: list[str], group: str = "group_id") -> DataFrame:
    """Groups whose samples are in more than one fold."""
    return folds.groupBy(*keys, group).agg(F.countDistinct("fold").alias("n_folds")).filter("n_folds > 1")
