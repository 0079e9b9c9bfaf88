"""Kinds and levels of a table's columns, and catalogues of matrices; one aggregate each."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = r"^\d{4}-\d{2}-\d{2}"


def infer_kinds(df: DataFrame) -> DataFrame:
    """column, kind: by type, and for text by its share of dates, its distinct values and its mean length.

    empty, datetime_like (over 80 % begin with a date), categorical (at most a twentieth distinct, within 10 and 50), text
    (30 characters and more on average) or categorical_highcard. Distinct values are counted by 64-bit hashes, so long
    texts aren't shuffled.
    """
    typed = {T.BooleanType: "bool", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "datetime", T.DoubleType: "float", T.FloatType: "float", T.DecimalType: "float"}
    known, text = [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            text.append(f.name)
        else:
            known.append((f.name, typed.get(type(f.dataType), "int" if isinstance(f.dataType, T.IntegralType) else "other")))
    parts = []
    if known:
        parts.append(df.sparkSession.createDataFrame(known, "column string, kind string"))
    if text:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.length(f"`{c}`").alias("size"), F.xxhash64(f"`{c}`").alias("h"), F.col(f"`{c}`").rlike(DAY).alias("day")) for c in text])
        long = df.select(F.explode(pairs).alias("z")).select("z.column", "z.size", F.when(F.col("z.size").isNotNull(), F.col("z.h")).alias("h"), "z.day")
        s = long.groupBy("column").agg(F.count("size").alias("n"), F.countDistinct("h").alias("d"), F.avg("size").alias("size"), F.avg(F.col("day").cast("double")).alias("day"))
        few = F.least(F.lit(50), F.greatest(F.lit(10), F.floor(0.05 * F.col("n"))))
        kind = F.when(F.col("n") == 0, "empty").when(F.col("day") > 0.8, "datetime_like").when(F.col("d") <= few, "categorical").when(F.col("size") >= 30, "text").otherwise("categorical_highcard")
        found = s.select("column", kind.alias("kind"))
        # a table without rows has no groups
        every = df.sparkSession.createDataFrame([(c,) for c in text], "column string")
        parts.append(every.join(found, "column", "left").select("column", F.coalesce("kind", F.lit("empty")).alias("kind")))
    return reduce(DataFrame.unionByName, parts)


def level_summary(df: DataFrame, column: str, k: int) -> DataFrame:
    """level, n, n_levels: the k most frequent values (ties by name), with how many there are."""
    n = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    total = n.agg(F.count("*").alias("n_levels"))
    return n.orderBy(F.desc("n"), "level").limit(k).join(F.broadcast(total))


def catalogue(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_features, n_samples, n_values of each matrix there is."""
    return values.groupBy(*keys).agg(F.countDistinct("feature").alias("n_features"), F.countDistinct("sample_id").alias("n_samples"), F.count("*").alias("n_values"))


def set_comparison(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """a, b, n_a_only, n_b_only, equal for each two tables' sets of a column's values, from one grouped pass."""
    sets = reduce(DataFrame.unionByName, [df.select(F.col(column).alias("v")).distinct().withColumn("t", F.lit(name)) for name, df in parts.items()])
    names = sorted(parts)
    has = sets.groupBy("v").pivot("t", names).agg(F.lit(True))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = has.agg(*[F.count_if(F.col(p).isNotNull() & F.col(q).isNull()).alias(f"{p}|{q}") for a, b in pairs for p, q in ((a, b), (b, a))])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("n_a_only"), F.col(f"`{b}|{a}`").alias("n_b_only")) for a, b in pairs]
    return counts.select(F.explode(F.array(*rows)).alias("z")).select("z.*").withColumn("equal", (F.col("n_a_only") == 0) & (F.col("n_b_only") == 0))


def membership(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """value, tables (sorted, comma-joined), everywhere: where each value of a column occurs."""
    sets = reduce(DataFrame.unionByName, [df.select(F.col(column).alias("value")).distinct().withColumn("t", F.lit(name)) for name, df in parts.items()])
    g = sets.groupBy("value").agg(F.array_sort(F.collect_set("t")).alias("ts"))  # as many as there are tables
    return g.select("value", F.array_join("ts", ",").alias("tables"), (F.size("ts") == len(parts)).alias("everywhere"))


def claims(row: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """claim, observed, expected, passed: each named column of a one-row table against (value, tolerance)."""
    items = [F.struct(F.lit(c).alias("claim"), F.col(c).cast("double").alias("observed"), F.lit(float(v)).alias("expected"), F.lit(float(tol)).alias("tol")) for c, (v, tol) in expected.items()]
    out = row.select(F.explode(F.array(*items)).alias("z")).select("z.*")
    return out.select("claim", "observed", "expected", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= F.col("tol"), F.lit(False)).alias("passed"))


def with_total(rows: DataFrame, keys: list[str], group: str, value: str, total: str = "__ALL__") -> DataFrame:
    """keys, group, n, mean, and one more row for each of keys over all groups, by grouping sets in one pass."""
    cols = [*keys, group]
    g = rows.rollup(*cols).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.grouping_id().alias("_g"))
    return g.filter(F.col("_g") <= 1).select(*keys, F.when(F.col("_g") == 1, total).otherwise(F.col(group)).alias(group), "n", "mean")


def ordinal_ranks(rows: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """rank 1..n by score, equal scores in the order of ordinal (where they were in the file)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), ordinal)))


def flatten_manifests(rows: DataFrame, column: str) -> DataFrame:
    """dataset, view, n_samples from manifests in JSON, whichever of four layouts each has.

    A list of views, or a map of them, below 'dataset' and 'views'; maps below 'datasets'; or keys 'dataset/view' below
    'n_samples'. Layouts that don't apply parse to NULL and give no rows.
    """
    c = F.col(column)
    view = "struct<n_samples: bigint>"
    listed = F.from_json(c, "struct<dataset: string, views: array<struct<view: string, n_samples: bigint>>>")
    mapped = F.from_json(c, f"struct<dataset: string, views: map<string, {view}>>")
    nested = F.from_json(c, f"struct<datasets: map<string, map<string, {view}>>>")
    flat = F.from_json(c, "struct<n_samples: map<string, bigint>>")
    array = F.get_json_object(c, "$.views").startswith("[")
    one = rows.filter(array).select(listed.alias("m")).select("m.dataset", F.explode("m.views").alias("v")).select("dataset", "v.view", "v.n_samples")
    two = rows.filter(~array).select(mapped.alias("m")).select("m.dataset", F.explode("m.views").alias("view", "v")).select("dataset", "view", "v.n_samples")
    three = rows.select(nested.alias("m")).select(F.explode("m.datasets").alias("dataset", "views")).select("dataset", F.explode("views").alias("view", "v")).select("dataset", "view", "v.n_samples")
    four = rows.select(flat.alias("m")).select(F.explode("m.n_samples").alias("key", "n_samples"))
    four = four.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("dataset"), F.split_part("key", F.lit("/"), F.lit(2)).alias("view"), "n_samples")
    return one.unionByName(two).unionByName(three).unionByName(four)


def timed(spark, steps: dict, runs: int) -> DataFrame:
    """step, runs, median_seconds of what each step returns, computed to the end."""
    rows = []
    for name, step in steps.items():
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            step().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        rows.append((name, runs, sorted(took)[runs // 2]))
    return spark.createDataFrame(rows, "step string, runs int, median_seconds double")


def importance_by_feature(rows: DataFrame, key: str, column: str, n_features: int) -> DataFrame:
    """key, feature_ord, mean_abs of nested arrays of importances, repeats first or features first.

    The axis as long as the features is theirs; if both are, the inner one. A single inner array is one repeat.
    """
    inner_first = F.exists(column, lambda x: F.size(x) != n_features)
    outer = rows.select(key, inner_first.alias("turned"), F.posexplode(column).alias("a", "xs")).select(key, "turned", "a", F.posexplode("xs").alias("b", "v"))
    return outer.groupBy(key, F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("feature_ord")).agg(F.avg(F.abs("v")).alias("mean_abs"))


def bundle_checks(values: DataFrame, samples: DataFrame, expected: dict[str, int], min_samples: int, min_classes: int, sensitivity: tuple[str, ...] = ()) -> DataFrame:
    """view, check, value, level (OK, WARN or ERROR) of every check of a bundle of views.

    values: (view, sample_id, feature, x); samples: (sample_id, label); expected: the views that should be there and the least
    features of each; views that end in one of sensitivity are welcome beside them. Rows of view '' are about the bundle.
    Missing values over a half are an error and over a hundredth a warning, infinite ones an error; samples of a view must be
    as many as the bundle's; more than half constant features, too few features and features without a name are warnings.
    """
    spark = values.sparkSession
    x = F.col("x").cast("double")
    gone = x.isNull() | F.isnan(x)
    each = values.groupBy("view", "feature").agg(
        F.count("*").alias("cells"), F.count_if(gone).alias("gone"), F.count_if(~gone & (F.abs(x) == float("inf"))).alias("endless"),
        F.count_if(F.col("feature").isNull() | (F.col("feature") == "")).alias("nameless"), (F.min(F.when(~gone, x)).eqNullSafe(F.max(F.when(~gone, x)))).cast("int").alias("constant"),
    )
    views = each.groupBy("view").agg(F.count("*").alias("features"), F.sum("cells").alias("cells"), F.sum("gone").alias("gone"), F.sum("endless").alias("endless"), F.count_if(F.col("nameless") > 0).alias("nameless"), F.sum("constant").alias("constant"))
    held = values.select("view", "sample_id").distinct().groupBy("view").agg(F.count("*").alias("held"))
    bundle = samples.agg(F.count_distinct("sample_id").alias("samples"), F.count_distinct("label").alias("classes"), (F.count("*") - F.count_distinct("sample_id")).alias("twice"))
    wanted = spark.createDataFrame(sorted(expected.items()), "view string, least int")
    found = wanted.join(views.join(held, "view"), "view", "full").crossJoin(F.broadcast(bundle.select("samples")))
    welcome = F.lit(False)
    for end in sensitivity:
        welcome = welcome | F.col("view").endswith(end)
    c, there = F.col, F.col("features").isNotNull()
    level = lambda error, warn: F.when(F.coalesce(error, F.lit(False)), "ERROR").when(F.coalesce(warn, F.lit(False)), "WARN").otherwise("OK")
    no, share, constant = F.lit(False), F.try_divide(c("gone"), c("cells")), F.try_divide(c("constant"), c("features"))
    checks = [("present", there.cast("int"), level(no, ~there)), ("expected", c("least").isNotNull().cast("int"), level(no, c("least").isNull() & ~welcome))]
    checks += [("samples", c("held"), level(there & (c("held") != c("samples")), no)), ("features", c("features"), level(no, c("features") < c("least")))]
    checks += [("missing", share, level(share > 0.5, share > 0.01)), ("infinite", c("endless"), level(c("endless") > 0, no))]
    checks += [("constant", constant, level(no, constant > 0.5)), ("nameless", c("nameless"), level(no, c("nameless") > 0))]
    row = lambda name, value, lvl: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), lvl.alias("level"))
    of_views = found.select("view", F.explode(F.array(*[row(*k) for k in checks])).alias("r")).select("view", "r.*").filter("value is not null")
    whole = [("bundle_samples", c("samples"), level(no, c("samples") < min_samples)), ("bundle_classes", c("classes"), level(no, c("classes") < min_classes)), ("repeated_samples", c("twice"), level(c("twice") > 0, no))]
    return of_views.unionByName(bundle.select(F.lit("").alias("view"), F.explode(F.array(*[row(*k) for k in whole])).alias("r")).select("view", "r.*"))


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_errors, n_warnings, status: FAIL with an error, WARN with a warning, else PASS."""
    n = checks.groupBy(*keys).agg(F.count_if(F.col("level") == "ERROR").alias("n_errors"), F.count_if(F.col("level") == "WARN").alias("n_warnings"))
    return n.withColumn("status", F.when(F.col("n_errors") > 0, "FAIL").when(F.col("n_warnings") > 0, "WARN").otherwise("PASS"))
