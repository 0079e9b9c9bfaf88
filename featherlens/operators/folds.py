"""Cross-validation folds as tables of (repeat, sample_id, fold)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import hash_order


def stratified(samples: DataFrame, k: int, repeats: int, seed: int) -> DataFrame:
    """Within each class, samples in hash order take the folds in turn."""
    rows = samples.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy("repeat", "label").orderBy(hash_order(seed, F.col("repeat"), F.col("sample_id")), "sample_id")
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("long"))


def effective_splits(samples: DataFrame, requested: int) -> DataFrame:
    """At least 2, at most the smallest class."""
    c = samples.groupBy("label").count()
    return c.agg(F.greatest(F.lit(2), F.least(F.lit(requested), F.min("count"))).cast("long").alias("n_splits"))


def invalid_folds(folds: DataFrame) -> DataFrame:
    """(repeat, fold) that is empty of a class in its training rows."""
    total = folds.groupBy("repeat", "label").agg(F.count("*").alias("n"))
    inside = folds.groupBy("repeat", "fold", "label").agg(F.count("*").alias("m"))
    return inside.join(total, ["repeat", "label"]).filter("m = n").select("repeat", "fold", "label")


def feasible_group_splits(samples: DataFrame, requested: int) -> DataFrame:
    """n_splits: the most folds, up to requested, none empty, that all leave every class in training; NULL if not even 2.

    Groups take fold group_id modulo k. All k are tried at once on the table of groups and classes.
    """
    pairs = samples.select("group_id", "label").distinct()
    classes = pairs.agg(F.count_distinct("label").alias("classes"))
    tried = pairs.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(max(2, requested))))).withColumn("mine", F.col("group_id") % F.col("k"))
    left = tried.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    each = left.groupBy("k", "fold").agg(F.count_distinct(F.when(F.col("mine") != F.col("fold"), F.col("label"))).alias("n"), F.max(F.col("mine") == F.col("fold")).alias("held"))
    worst = each.groupBy("k").agg(F.min("n").alias("n"), F.min("held").alias("held")).filter("held")
    return worst.join(F.broadcast(classes), F.col("n") == F.col("classes"), "left_semi").agg(F.max("k").cast("long").alias("n_splits"))


def class_weights(samples: DataFrame) -> DataFrame:
    """n / (classes * n_class)."""
    c = samples.groupBy("label").agg(F.count("*").alias("n_class"))
    by = Window.partitionBy(F.lit(0))
    return c.withColumn("weight", F.sum("n_class").over(by) / (F.count("*").over(by) * F.col("n_class")))


def grouped_greedy(samples: DataFrame, k: int) -> DataFrame:
    """(group_id, fold): groups, largest first, go to the fold that keeps class shares most even.

    The contingency table of groups and classes is gathered, so groups are a small dimension (a few per sample site).
    """
    table = samples.groupBy("group_id", "label").count().toPandas()
    wide = table.pivot(index="group_id", columns="label", values="count").fillna(0).sort_index()
    m = wide.to_numpy(float)
    share, folds, out = m.sum(0) / max(m.sum(), 1), np.zeros((k, m.shape[1])), {}
    for g in sorted(range(len(m)), key=lambda i: (-m[i].sum(), i)):
        costs = []
        for f in range(k):
            after = folds.copy()
            after[f] += m[g]
            costs.append((((after - m.sum(0) / k) ** 2).sum() + ((after.sum(1) - m.sum() / k) ** 2).sum() * float(share @ share), f))
        f = min(costs)[1]
        folds[f] += m[g]
        out[wide.index[g]] = f
    rows = [(int(g), int(f)) for g, f in out.items()]
    return samples.sparkSession.createDataFrame(rows, "group_id long, fold long")


def confusion_metrics(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """accuracy, balanced_accuracy (mean recall of the classes that occur) and macro_f1."""
    c = pred.groupBy(*keys, y, p).agg(F.count("*").alias("n"))
    each = (
        c.select(*keys, F.col(y).alias("c"), F.col("n").alias("act"), F.lit(0).alias("prd"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).alias("hit"))
        .unionByName(c.select(*keys, F.col(p).alias("c"), F.lit(0).alias("act"), F.col("n").alias("prd"), F.lit(0).alias("hit")))
        .groupBy(*keys, "c")
        .agg(F.sum("act").alias("act"), F.sum("prd").alias("prd"), F.sum("hit").alias("hit"))
    )
    return each.groupBy(*keys).agg(
        (F.sum("hit") / F.sum("act")).alias("accuracy"),
        F.avg(F.when(F.col("act") > 0, F.col("hit") / F.nullif("act", F.lit(0)))).alias("balanced_accuracy"),
        F.avg(2 * F.col("hit") / (F.col("act") + F.col("prd"))).alias("macro_f1"),
    )


def ari_nmi(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings."""
    c = pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").cast("double").alias("n"))
    c = c.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "t": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    two = lambda x: x * (x - 1) / 2
    n, na, nb, t = F.col("n"), F.col("na"), F.col("nb"), F.col("t")
    s = c.agg(
        F.sum(two(n)).alias("sij"), F.sum(n / na * two(na)).alias("sa"), F.sum(n / nb * two(nb)).alias("sb"), F.first("t").alias("t"),
        F.sum(n / t * F.ln(n * t / (na * nb))).alias("mi"), (-F.sum(n / t * F.ln(na / t))).alias("ha"), (-F.sum(n / t * F.ln(nb / t))).alias("hb"),
    )
    expected = F.col("sa") * F.col("sb") / two(F.col("t"))
    top = (F.col("sa") + F.col("sb")) / 2
    return s.select(F.coalesce(F.try_divide(F.col("sij") - expected, top - expected), F.lit(1.0)).alias("ari"), F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"))
