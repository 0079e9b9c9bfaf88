"""Correlation, tests and regression as aggregates; undefined results are NULL, never NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import hypergeometric_upper, mann_whitney_exact, normal_two_sided, student_two_sided
from ..sources import sinks
from . import transform
from .ranking import average_ranks, k_count, rank_column


def pearson(a: Column, b: Column, least: int = 3) -> Column:
    """Aggregate over pairs with both values; NULL for fewer than least pairs or a constant side."""
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a.cast("double")), F.when(ok, b.cast("double"))
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= least) & (sd > 0), F.covar_pop(x, y) / F.nullif(sd, F.lit(0.0)))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str, method: str = "average", name: str = "feature") -> DataFrame:
    """keys, n, rho over rows where both values are there; method: 'average' or 'ordinal' (ties by name).

    Average ranks come from counts of the distinct values, and pairs of values are counted before they get their ranks, so a
    key of any size is spread over tasks. The counted pairs are written and read again: sums over a shuffle may differ in
    their last bits when they are taken anew, and values join their ranks only as they are. Ordinal ranks sort a key in one task.
    """
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if method != "average":
        ranks = both.select(*keys, rank_column(keys, a, "name", name).alias("_a"), rank_column(keys, b, "name", name).alias("_b"))
        return ranks.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("_a"), F.col("_b")).alias("rho"))
    path = sinks.workspace(rows.sparkSession, "pairs")
    both.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_c")).write.parquet(path)
    pairs = rows.sparkSession.read.parquet(path)
    mine = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = lambda c: [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(c).eqNullSafe(F.col("_v"))]
    ra, rb = (average_ranks(pairs.select(*keys, F.col(c).alias("_v"), "_c"), keys, "_v", "_c") for c in ("_a", "_b"))
    # ranks less their mean, (n + 1) / 2
    middle = F.col("_rank") - (F.col("_n") + 1) / 2
    placed = pairs.join(ra.select(*mine, "_v", middle.alias("_x")), same("_a")).drop("_v", *[f"_k{i}" for i in range(len(keys))])
    placed = placed.join(rb.select(*mine, "_v", middle.alias("_y")), same("_b"))
    total = lambda u, v: F.sum(F.col("_c") * F.col(u) * F.col(v))
    spread = F.sqrt(total("_x", "_x")) * F.sqrt(total("_y", "_y"))
    n = F.sum("_c")
    rho = F.when((n >= 3) & (spread > 0), total("_x", "_y") / F.nullif(spread, F.lit(0.0)))
    return placed.groupBy(*keys).agg(n.alias("n"), rho.alias("rho"))


def spearman_p(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, rho, p: two-sided by Student's t with n - 2 degrees; 0 for a perfect order, NULL for fewer than three rows."""
    r = spearman(rows, keys, a, b)
    rho, df = F.col("rho"), F.col("n") - 2
    t = rho * F.sqrt(F.try_divide(df, F.greatest(1 - rho * rho, F.lit(0.0))))
    return r.withColumn("p", F.when(F.abs(rho) >= 1 - 1e-15, 0.0).otherwise(student_two_sided(t, df)))


def vsa(features: DataFrame, keys: list[str], k_pct: int, k_rule: str = "floor") -> DataFrame:
    """Mann-Whitney AUROC of eta_sq, top-K by variance against the rest, less one half; 0 if no rest is left, NULL for fewer than three features."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = features.withColumns({"_top": rank_column(keys, "v_total") <= k_count(n, F.lit(k_pct), k_rule), "_r": rank_column(keys, "eta_sq", "average", descending=False)})
    n1, n0 = F.count_if("_top"), F.count_if(~F.col("_top"))
    u = F.sum(F.when(F.col("_top"), F.col("_r"))) - n1 * (n1 + 1) / 2
    return rows.groupBy(*keys).agg(F.when(n1 + n0 < 3, None).when(n0 == 0, 0.0).otherwise(F.try_divide(u, n1 * n0) - 0.5).alias("vsa"))


def eta_enrichment(features: DataFrame, keys: list[str], k_pct: int, k_rule: str = "floor", eps: float = 1e-12) -> DataFrame:
    """Mean eta_sq of the top-K by variance over the mean of all."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = features.withColumn("_top", rank_column(keys, "v_total") <= k_count(n, F.lit(k_pct), k_rule))
    top, mean = F.avg(F.when(F.col("_top"), F.col("eta_sq"))), F.avg("eta_sq")
    return rows.groupBy(*keys).agg(top.alias("eta_topv"), mean.alias("eta_all"), (top / (mean + eps)).alias("eta_es"))


def bh_fdr(rows: DataFrame, keys: list[str], p: str = "p", name: str = "id", out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg q; NULL p-values stay NULL and don't count."""
    tested = rows.filter(F.col(p).isNotNull())
    by = Window.partitionBy(*keys)
    q = F.col(p) * F.count("*").over(by) / F.row_number().over(by.orderBy(p, name))
    tested = tested.withColumn("_q", q)
    upward = by.orderBy(F.asc(p), F.asc(name)).rowsBetween(0, Window.unboundedFollowing)
    tested = tested.withColumn(out, F.least(F.lit(1.0), F.min("_q").over(upward))).drop("_q")
    return tested.unionByName(rows.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def hypergeometric_tail(rows: DataFrame, id_cols: list[str]) -> DataFrame:
    """p = P[X >= hits] for hits of drawn from a population with marked; rows: id_cols, population, marked, drawn, hits.

    A row's terms are added up where it is, so nothing is shuffled. A count over its population gives NULL.
    """
    p = hypergeometric_upper(F.col("population"), F.col("marked"), F.col("drawn"), F.col("hits"))
    return rows.select(*id_cols, "hits", "marked", "drawn", "population", p.alias("p"))


def ols(x: Column, y: Column) -> list[Column]:
    """Aggregates: n, intercept, slope, r2, rmse of y on x; slope 0 for a constant x."""
    n, mx, my = F.count(x), F.avg(x), F.avg(y)
    sxx, sxy, syy = F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)
    slope = F.when(sxx > 0, sxy / F.nullif(sxx, F.lit(0.0))).otherwise(0.0)
    left = F.greatest(F.lit(0.0), syy - slope * sxy)
    return [n.alias("n"), (my - slope * mx).alias("intercept"), slope.alias("slope"), F.when(syy > 0, 1 - left / F.nullif(syy, F.lit(0.0))).alias("r2"), F.sqrt(left).alias("rmse")]


def ols_2d(a: Column, b: Column, y: Column) -> list[Column]:
    """Aggregates: coefficients and r2 of y on a and b, from centred second moments."""
    saa, sbb, sab = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    say, sby, syy = F.covar_pop(a, y), F.covar_pop(b, y), F.var_pop(y)
    det = F.nullif(saa * sbb - sab * sab, F.lit(0.0))
    ca, cb = (say * sbb - sby * sab) / det, (sby * saa - say * sab) / det
    return [(F.avg(y) - ca * F.avg(a) - cb * F.avg(b)).alias("intercept"), ca.alias("coef_a"), cb.alias("coef_b"), ((ca * say + cb * sby) / F.nullif(syy, F.lit(0.0))).alias("r2")]


def loo_ols(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """rows with the prediction for each from a line fitted to all others: window sums less its own part."""
    by = Window.partitionBy(*keys)
    s = {k: F.sum(e).over(by) - e for k, e in {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y)}.items()}
    den = s["n"] * s["sxx"] - s["sx"] * s["sx"]
    slope = F.try_divide(s["n"] * s["sxy"] - s["sx"] * s["sy"], den)
    return rows.withColumn("_b", slope).withColumn("pred", F.try_divide(s["sy"] - F.col("_b") * s["sx"], s["n"])).drop("_b")


def cohens_d(values: DataFrame, keys: list[str], a, b) -> DataFrame:
    """Means, deviations and Cohen's d of classes a and b of each feature."""
    xa, xb = F.when(F.col("label") == a, F.col("x")), F.when(F.col("label") == b, F.col("x"))
    na, nb = F.count(xa), F.count(xb)
    pooled = F.sqrt(((na - 1) * F.var_samp(xa) + (nb - 1) * F.var_samp(xb)) / F.nullif(na + nb - 2, F.lit(0)))
    return values.groupBy(*keys, "feature").agg(
        na.alias("n_a"), nb.alias("n_b"), F.avg(xa).alias("mean_a"), F.avg(xb).alias("mean_b"), F.stddev_samp(xa).alias("sd_a"), F.stddev_samp(xb).alias("sd_b"),
        ((F.avg(xa) - F.avg(xb)) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"), F.min("x").alias("lo"), F.max("x").alias("hi"),
    )


#: A density's tests allow the error that so many bins over the range would make; the density itself is the direct sum.
KDE_BINS = 4096


def kde(rows: DataFrame, keys: list[str], x: str, points: int, bandwidth: float = 0.15) -> DataFrame:
    """Gaussian density on a grid over the range of x; width bandwidth * range / n**0.2; NULL for a single value.

    The direct sum over all rows at every point: each row's points are added up within its task, so a group sends a row a task.
    """
    known = rows.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    lim = known.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n"))
    lim = lim.withColumn("h", F.nullif(F.lit(bandwidth) * (F.col("hi") - F.col("lo")) / F.pow(F.col("n").cast("double"), F.lit(0.2)), F.lit(0.0)))
    ends = ["lo", "hi", "h"]
    at = [F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(i) / (points - 1) for i in range(points)]
    term = lambda x_at: F.exp(-(((x_at - F.col("_x")) / F.col("h")) ** 2) / 2) / (F.col("h") * 2.5066282746310002)
    placed = known.join(lim, keys) if keys else known.crossJoin(F.broadcast(lim))
    sums = placed.groupBy(*keys, *ends).agg(*[F.avg(term(p)).alias(f"_{i}") for i, p in enumerate(at)])
    grid = F.array(*[F.struct(F.lit(i).alias("i"), p.alias("x_at"), F.col(f"_{i}").alias("density")) for i, p in enumerate(at)])
    return sums.select(*keys, F.explode(grid).alias("e")).select(*keys, "e.*")


def mann_whitney(rows: DataFrame, keys: list[str], x: str, flag: str) -> DataFrame:
    """U of the flagged rows, AUROC, and the normal approximation's z."""
    r = rows.withColumn("_r", rank_column(keys, x, "average", descending=False))
    n1, n0 = F.count_if(flag).cast("double"), F.count_if(~F.col(flag)).cast("double")
    u = F.sum(F.when(F.col(flag), F.col("_r"))) - n1 * (n1 + 1) / 2
    z = F.try_divide(u - n1 * n0 / 2, F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12))
    return r.groupBy(*keys).agg(u.alias("u"), F.try_divide(u, n1 * n0).alias("auroc"), z.alias("z"))


#: The smaller side up to which the rank test's law is exact if there are no ties.
EXACT_SIDE = 8


def mann_whitney_p(rows: DataFrame, keys: list[str], x: str, flag: str) -> DataFrame:
    """keys, u, auroc, p: two-sided; NULL for an empty side.

    The exact law where a side has at most EXACT_SIDE rows and no value is repeated, else the normal approximation with
    corrections for ties and continuity.
    """
    u = mann_whitney(rows, keys, x, flag).select(*keys, "u", "auroc")
    # ties: sum of t**3 - t over the values, from counts of each value
    same = rows.groupBy(*keys, x).agg(F.count("*").cast("double").alias("t"), F.count_if(flag).alias("f"))
    ties = same.groupBy(*keys).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("_ties"), F.sum("t").alias("_n"), F.sum("f").cast("double").alias("_n1"))
    n, n1 = F.col("_n"), F.col("_n1")
    n0 = n - n1
    variance = n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0)), F.sqrt(variance))
    both = (n1 > 0) & (n0 > 0)
    small = both & (F.col("_ties") == 0) & (F.least(n1, n0) <= EXACT_SIDE)
    exact = mann_whitney_exact(F.when(small, F.col("u")), n1, n0)
    return u.join(ties, keys).select(*keys, "u", "auroc", F.when(small, exact).otherwise(normal_two_sided(F.when(both, z))).alias("p"))


def class_robustness(values: DataFrame, keys: list[str], a, b) -> DataFrame:
    """Of classes a and b of each feature: medians, 10 and 90 % quantiles, rank test, and the largest distance from the own
    class's mean in mean class deviations."""
    two = values.filter(F.col("label").isin(a, b) & F.col("x").isNotNull()).withColumn("_b", F.col("label") == b)
    by = [*keys, "feature"]
    far = F.abs(F.col("x") - F.avg("x").over(Window.partitionBy(*by, "label")))
    xa, xb = F.when(~F.col("_b"), F.col("x")), F.when(F.col("_b"), F.col("x"))
    sd = (F.stddev_samp(xa) + F.stddev_samp(xb)) / 2
    s = two.withColumn("_far", far).groupBy(*by).agg((F.max("_far") / F.nullif(sd, F.lit(0.0))).alias("outlier_score"))
    q = transform.quantiles(two, [*by, "_b"], F.col("x"), [0.1, 0.5, 0.9])
    side = lambda b: F.max(F.when(F.col("_b") == b, F.col("q")))
    s = s.join(q.groupBy(*by).agg(side(False).alias("qa"), side(True).alias("qb")), by)
    names = {"q10": 0, "median": 1, "q90": 2}
    cols = [F.col(f"q{side}")[i].alias(f"{n}_{side}") for side in "ab" for n, i in names.items()]
    return s.select(*by, *cols, "outlier_score").join(mann_whitney_p(two, by, "x", "_b"), by)
