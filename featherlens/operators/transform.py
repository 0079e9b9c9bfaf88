"""Cleaning and transforms of a long matrix; one column expression or one window over a view's key each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .moments import clean


def log1p(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def m_value(beta: Column, eps: float = 1e-6) -> Column:
    """log2 odds of a share, clipped away from 0 and 1."""
    b = F.least(F.greatest(beta, F.lit(eps)), F.lit(1 - eps))
    return F.log2(b / (1 - b))


def clr(values: DataFrame, keys: list[str], pseudocount: float = 1e-6, out: str = "x") -> DataFrame:
    """Centred log ratio: log(x + pseudocount) less the sample's mean of logs."""
    log = F.ln(F.col("x") + pseudocount)
    return values.withColumn(out, log - F.avg(log).over(Window.partitionBy(*keys, "sample_id")))


def standard_scale(values: DataFrame, keys: list[str], out: str = "x") -> DataFrame:
    """(x - mean) / population deviation of the feature; constants become 0."""
    by = Window.partitionBy(*keys, "feature")
    sd = F.stddev_pop("x").over(by)
    return values.withColumn(out, F.when(sd > 0, (F.col("x") - F.avg("x").over(by)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))


def mean_impute(values: DataFrame, keys: list[str], out: str = "x") -> DataFrame:
    """Missing values become the feature's mean, 0 if none is observed."""
    x = clean(F.col("x"))
    return values.withColumn(out, F.coalesce(x, F.avg(x).over(Window.partitionBy(*keys, "feature")), F.lit(0.0)))


def quantiles(values: DataFrame, keys: list[str], x: Column, probs: list[float], tie: str = "sample_id") -> DataFrame:
    """keys, q (an array): exact quantiles of x in each group, interpolated; groups without a value are left out.

    One range shuffle by keys, value and tie numbers all rows of all groups, so a group may span tasks and none holds its
    values; the rows at the places that quantiles need are fetched by a join on that number.
    """
    rows = values.select(*keys, x.alias("_x"), F.col(tie).alias("_tie")).filter("_x is not null")
    placed = ranking.numbered(rows, [*map(F.col, keys), F.col("_x"), F.col("_tie")], "_place").select(*keys, "_x", "_place")
    ends = placed.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    points = [F.struct(F.lit(i).alias("i"), (F.col("_first") + F.floor(at(q))).alias("low"), (F.col("_first") + F.ceil(at(q))).alias("high"), (at(q) - F.floor(at(q))).alias("part")) for i, q in enumerate(probs)]
    wanted = ends.select(*keys, F.explode(F.array(*points)).alias("p")).select(*keys, "p.*")
    found = placed.select("_x", "_place").join(wanted.select(F.explode(F.array("low", "high")).alias("_place")).distinct(), "_place")
    low, high = (found.select(F.col("_place").alias(c), F.col("_x").alias(f"_{c}")) for c in ("low", "high"))
    each = wanted.join(low, "low").join(high, "high").withColumn("q", (1 - F.col("part")) * F.col("_low") + F.col("part") * F.col("_high"))
    return each.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("q"))) for i in range(len(probs))]).alias("q"))


def medians(values: DataFrame, keys: list[str], out: str = "_median") -> DataFrame:
    """keys, feature and the exact median of the feature's clean values, NULL without one."""
    by = [*keys, "feature"]
    found = quantiles(values, by, clean(F.col("x")), [0.5]).select(*by, F.col("q")[0].alias(out))
    return values.select(*by).distinct().join(found, by, "left")


def median_impute(values: DataFrame, keys: list[str], out: str = "x") -> DataFrame:
    """Missing values become the feature's median, by an aggregate and a join on the feature."""
    x = clean(F.col("x"))
    med = medians(values, keys, "_m")
    return values.join(med, [*keys, "feature"]).withColumn(out, F.coalesce(x, F.col("_m"), F.lit(0.0))).drop("_m")


def missingness(values: DataFrame, keys: list[str], limit: float = 0.3, method: str = "median", drop_constant: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cleaned values, report): features with more than limit missing go, the rest is imputed, constants go."""
    x = clean(F.col("x"))
    f = values.groupBy(*keys, "feature").agg(F.avg(x.isNull().cast("double")).alias("missing"), F.avg(x).alias("mean")).join(medians(values, keys, "median"), [*keys, "feature"])
    fill = F.coalesce({"median": F.col("median"), "mean": F.col("mean"), "zero": F.lit(0.0)}[method], F.lit(0.0))
    f = f.withColumns({"_fill": fill, "_few": F.col("missing") <= limit})
    filled = values.join(f.filter("_few").select(*keys, "feature", "_fill"), [*keys, "feature"]).withColumn("x", F.coalesce(x, "_fill")).drop("_fill")
    spread = filled.groupBy(*keys, "feature").agg(F.var_pop("x").alias("_v"))
    kept = filled.join(spread.filter("_v > 0").select(*keys, "feature"), [*keys, "feature"], "left_semi") if drop_constant else filled
    n = f.groupBy(*keys).agg(F.count("*").alias("n_features"), F.count_if(~F.col("_few")).alias("n_dropped_missing"), F.sum(F.when(F.col("_few"), F.col("missing"))).alias("missing_mass"))
    constant = spread.groupBy(*keys).agg(F.count_if(F.col("_v") <= 0).alias("n_constant"))
    return kept, n.join(constant, keys, "left")


def varying_features(values: DataFrame, keys: list[str]) -> DataFrame:
    """Features with an observed value and a sample variance above 0."""
    x = clean(F.col("x"))
    return values.groupBy(*keys, "feature").agg(F.count(x).alias("n"), F.var_samp(x).alias("v")).filter("n > 0 and v > 0").select(*keys, "feature")


def melt(wide: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "x") -> DataFrame:
    return wide.unpivot(ids, columns, name, value)


def common_samples(values: DataFrame, views: list[str]) -> DataFrame:
    """Samples that every view has, in one aggregate."""
    return values.filter(F.col("view").isin(views)).groupBy("sample_id").agg(F.countDistinct("view").alias("n")).filter(F.col("n") == len(set(views))).select("sample_id")


def densify(sparse: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Every sample with every feature, 0 where sparse has none; features are a broadcast-size dimension by contract."""
    return samples.join(features).join(sparse, ["sample_id", "feature"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def resolve(columns: list[str], candidates: list[str], default: str | None = None) -> str:
    """The first candidate among columns, at plan time; an error without one and without a default."""
    found = next((c for c in candidates if c in columns), default)
    if found is None:
        raise KeyError(f"none of {candidates} among {columns}")
    return found


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing; one aggregate decides."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])


def union_tagged(parts: dict[str, DataFrame], tag: str = "table_source") -> DataFrame:
    """Tables of different columns under each other, with where they come from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: of rows with the same keys the newest stays."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v")))).filter("_n = 1").drop("_n", "_v")


def impute_by_policy(values: DataFrame, keys: list[str], policy: dict[str, str], default: str = "zero", limit: float = 0.3) -> DataFrame:
    """Features with more than limit missing go; the rest is filled as the view's policy says: 'median', 'mean' or 'zero'."""
    x = clean(F.col("x"))
    f = values.groupBy(*keys, "feature").agg(F.avg(x.isNull().cast("double")).alias("_missing"), F.avg(x).alias("_mean")).join(medians(values, keys), [*keys, "feature"])
    how = F.lit(default)
    for view, method in sorted(policy.items()):
        how = F.when(F.col("view") == view, method).otherwise(how)
    fill = F.when(how == "median", F.col("_median")).when(how == "mean", F.col("_mean")).otherwise(0.0)
    kept = f.filter(F.col("_missing") <= limit).select(*keys, "feature", F.coalesce(fill, F.lit(0.0)).alias("_fill"))
    return values.join(kept, [*keys, "feature"]).withColumn("x", F.coalesce(x, "_fill")).drop("_fill")


def m_values_where_shares(values: DataFrame, keys: list[str]) -> DataFrame:
    """M-values for the matrices whose values all lie in 0..1; others as they are.

    Their ends, a row a matrix, are broadcast: values are never shuffled, however large one matrix is.
    """
    ends = values.groupBy(*keys).agg(((F.min("x") >= 0) & (F.max("x") <= 1)).alias("_share"))
    return values.join(F.broadcast(ends), keys).withColumn("x", F.when(F.col("_share"), m_value(F.col("x"))).otherwise(F.col("x"))).drop("_share")


def projected(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Those of columns that df has; no rows if they are fewer than least."""
    have = [c for c in columns if c in df.columns]
    return df.select(*have) if len(have) >= least else df.select(*have).limit(0)
