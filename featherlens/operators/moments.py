"""Per-feature and per-class moments of a long matrix (sample_id, feature_ord, feature, x, label).

keys are any further grouping columns (view, repeat, fold, permutation): folds and permutations are more keys of one
plan, never a loop. Missing values are NULL; NaN is turned into NULL on entry, because Spark's aggregates keep it. All
aggregates combine on the map side, so a feature with a third of all rows costs no more than its partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def clean(x: Column) -> Column:
    """NULL for NaN and infinities."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def marginal_variance(values: DataFrame, keys: list[str], ddof: int = 1) -> DataFrame:
    """n, mean, variance by keys and feature; variance 0 for fewer than two observed values."""
    x = clean(F.col("x"))
    var = F.var_samp(x) if ddof else F.var_pop(x)
    return values.groupBy(*keys, "feature").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(F.count(x) < 2, 0.0).otherwise(var).alias("variance"))


def class_moments(values: DataFrame, keys: list[str]) -> DataFrame:
    """rows, n (observed), mu, var_pop and var_samp by keys, feature and label."""
    x = clean(F.col("x"))
    return values.groupBy(*keys, "feature", "label").agg(
        F.count("*").alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mu"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("var_pop"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var_samp")
    )


def eta2(values: DataFrame, keys: list[str], weights: str = "rows") -> DataFrame:
    """v_total, v_between, v_within, eta_sq by keys and feature.

    Everything follows from class moments, so the matrix is aggregated once: total variance is the pooled second moment.
    weights: 'rows' counts missing values in the class weights, 'observed' doesn't. A feature without any value has
    NULL moments and an eta_sq of 0.
    """
    c = class_moments(values, keys)
    by = [*keys, "feature"]
    w = F.col("rows" if weights == "rows" else "n")
    overall = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(w).alias("weight"), (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("mean"))
    j = c.join(overall.withColumnsRenamed({"n": "n_all"}), by)
    gap = (F.col("mu") - F.col("mean")) ** 2
    share = F.try_divide(w, F.col("weight"))
    parts = {
        "v_total": F.try_divide(F.sum(F.col("n") * (F.col("var_pop") + gap)), F.first("n_all")),
        "v_between": F.sum(share * gap),
        "v_within": F.sum(share * F.col("var_pop")),
    }
    out = j.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])
    return out.withColumn("eta_sq", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("v_between") / (F.col("v_total") + EPS), F.lit(0.0)))))


def decomposition(values: DataFrame, keys: list[str]) -> DataFrame:
    """var_total, var_between, var_within, signal ratio r_snr, share r_frac and the identity's residual."""
    e = eta2(values, keys, "observed")
    return e.select(
        *keys,
        "feature",
        F.col("v_total").alias("var_total"),
        F.col("v_between").alias("var_between"),
        F.col("v_within").alias("var_within"),
        (F.col("v_between") / (F.col("v_within") + EPS)).alias("r_snr"),
        (F.col("v_between") / (F.col("v_total") + EPS)).alias("r_frac"),
        F.abs(F.col("v_total") - F.col("v_between") - F.col("v_within")).alias("residual"),
    )


def fisher(values: DataFrame, keys: list[str], floor: float = 1e-10) -> DataFrame:
    """Class-count-weighted between over pooled within variance (classes of two and more)."""
    c = class_moments(values, keys)
    by = [*keys, "feature"]
    mean = c.groupBy(*by).agg((F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("mean"), F.sum("n").alias("total"))
    j = c.join(mean, by)
    between = F.sum(F.col("n") * (F.col("mu") - F.col("mean")) ** 2) / F.first("total")
    within = F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("var_samp")).otherwise(0.0)) / F.first("total")
    return j.groupBy(*by).agg((between / F.greatest(within, F.lit(floor))).alias("score"))


def eta2_and_fisher(values: DataFrame, keys: list[str], floor: float = 1e-10) -> DataFrame:
    """eta2 (weights 'rows') and fisher's score as fis, from one pass over the matrix.

    Class moments are the only aggregate of the matrix; each feature's few classes are then gathered in a row, where all
    sums over them are taken.
    """
    c = class_moments(values, keys)
    rows = c.groupBy(*keys, "feature").agg(F.collect_list(F.struct("rows", "n", "mu", "var_pop", "var_samp")).alias("c"))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda acc, x: acc + F.coalesce(f(x).cast("double"), F.lit(0.0)))
    rows = rows.withColumns({"n_all": total(lambda x: x["n"]), "weight": total(lambda x: x["rows"])}).withColumn("mean", F.try_divide(total(lambda x: x["n"] * x["mu"]), F.col("n_all")))
    gap = lambda x: (x["mu"] - F.col("mean")) * (x["mu"] - F.col("mean"))
    share = lambda x: F.try_divide(x["rows"], F.col("weight"))
    out = rows.select(
        *keys,
        "feature",
        F.try_divide(total(lambda x: x["n"] * (x["var_pop"] + gap(x))), F.col("n_all")).alias("v_total"),
        F.when(F.col("n_all") > 0, total(lambda x: share(x) * gap(x))).alias("v_between"),
        F.when(F.col("n_all") > 0, total(lambda x: share(x) * x["var_pop"])).alias("v_within"),
        (total(lambda x: x["n"] * gap(x)) / F.nullif(F.col("n_all"), F.lit(0.0)) / F.greatest(total(lambda x: F.when(x["n"] > 1, x["n"] * x["var_samp"])) / F.nullif(F.col("n_all"), F.lit(0.0)), F.lit(floor))).alias("fis"),
    )
    return out.withColumn("eta_sq", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("v_between") / (F.col("v_total") + EPS), F.lit(0.0)))))


def class_mean_variance(values: DataFrame, keys: list[str]) -> DataFrame:
    """Importance as the variance of the class means."""
    return class_moments(values, keys).groupBy(*keys, "feature").agg(F.var_pop("mu").alias("score"))


def scale_check(values: DataFrame, keys: list[str]) -> DataFrame:
    """One row a view: what scale the matrix seems to be on, from feature and sample aggregates."""
    x = clean(F.col("x"))
    f = values.groupBy(*keys, "feature").agg(F.var_pop(x).alias("v"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    a = f.groupBy(*keys).agg(F.avg("v").alias("mean_var"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("sd_var"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    s = values.groupBy(*keys, "sample_id").agg(F.sum(x).alias("total")).groupBy(*keys).agg(F.avg("total").alias("mean_row_sum"))
    out = a.join(s, keys).withColumn("max_abs", F.greatest(F.abs("lo"), F.abs("hi")))
    return out.withColumns(
        {
            "is_standardized": (F.abs(F.col("mean_var") - 1) < 0.1) & (F.col("sd_var") < 0.1),
            "is_log": F.col("max_abs") < 50,
            "is_compositional": (F.col("lo") >= 0) & (F.abs(F.col("mean_row_sum") - 1) < 0.05),
        }
    )
