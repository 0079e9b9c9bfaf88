"""The tables the queries start from, in Spark and as SQL.

emb: the embeddings as a long matrix, 64 features, ten classes. line: four measures of line items by return flag, many
samples. brand: suppliers by brand, money per pair, compositional. The others are derived: feature tables (moments, ranks),
importances by repeat, folds, and a results table of deterministic pseudo-scores by region, nation, model, repeat and K.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moments, ranking, resample

K_PCTS = [1, 5, 10, 20]
REPEATS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", (F.col("vec_id") % 7).alias("group_id"), F.posexplode("embedding").alias("feature_ord", "x"))
    return e.select(F.lit("emb").alias("view"), "sample_id", "feature_ord", F.format_string("f%03d", "feature_ord").alias("feature"), F.col("x").cast("double").alias("x"), "label", "group_id")


EMB = """emb AS (SELECT 'emb' AS view, vec_id AS sample_id, i - 1 AS feature_ord, 'f' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS x, label, vec_id % 7 AS group_id
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    ids = [(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("group_id")]
    return li.select(*ids, *measures).unpivot(["sample_id", "label", "group_id"], measures, "feature", "x").withColumn("view", F.lit("line"))


LINE = """line AS (SELECT 'line' AS view, l_orderkey * 10 + l_linenumber AS sample_id, l_returnflag AS label, l_orderkey AS group_id, feature, x FROM lineitem
  UNPIVOT (x FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"""


def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    money = li.select("l_partkey", "l_suppkey", "l_extendedprice").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    sums = money.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature")).agg(F.sum("l_extendedprice").alias("x"))
    return sums.join(s.select(F.col("s_suppkey").alias("sample_id"), (F.col("s_nationkey") % 4).alias("label")), "sample_id").withColumn("view", F.lit("brand"))


BRAND = """brand AS (SELECT 'brand' AS view, l_suppkey AS sample_id, p_brand AS feature, sum(l_extendedprice) AS x, any_value(s_nationkey % 4) AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, p_brand)"""

VIEW = ["view"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, feature, v_total, v_between, v_within, eta_sq, and fis, the Fisher ratio."""
    return moments.eta2_and_fisher(emb(spark, sf_dir), VIEW)


MOMENTS = """cls AS (SELECT view, feature, label, count(*) AS rws, count(x) AS n, avg(x) AS mu, coalesce(var_pop(x), 0) AS vp, coalesce(var_samp(x), 0) AS vs FROM emb GROUP BY ALL),
tot AS (SELECT view, feature, count(x) AS n, avg(x) AS mean, var_pop(x) AS vp, var_samp(x) AS vs FROM emb GROUP BY ALL),
ft AS (SELECT view, feature, any_value(t.vp) AS v_total, sum(c.n / CAST(t.n AS DOUBLE) * (c.mu - t.mean) ** 2) AS v_between, sum(c.n / CAST(t.n AS DOUBLE) * c.vp) AS v_within,
  greatest(0.0, least(1.0, sum(c.n / CAST(t.n AS DOUBLE) * (c.mu - t.mean) ** 2) / (any_value(t.vp) + 1e-12))) AS eta_sq,
  sum(c.n * (c.mu - t.mean) ** 2) / any_value(t.n) / greatest(sum(CASE WHEN c.n > 1 THEN c.n * c.vs ELSE 0 END) / any_value(t.n), 1e-10) AS fis
  FROM cls c JOIN tot t USING (view, feature) GROUP BY view, feature)"""


def vp(spark: SparkSession, sf_dir: str, ranks: str = "v_rank eta_rank fis_rank") -> DataFrame:
    """features with the ranks asked for (ties by name)."""
    f = features(spark, sf_dir)
    for score, out in (("v_total", "v_rank"), ("eta_sq", "eta_rank"), ("fis", "fis_rank")):
        if out in ranks.split():
            f = ranking.ranked(f, VIEW, score, out=out)
    return f


VP = """vp AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY v_total DESC, feature) AS v_rank, row_number() OVER (PARTITION BY view ORDER BY eta_sq DESC, feature) AS eta_rank,
  row_number() OVER (PARTITION BY view ORDER BY fis DESC, feature) AS fis_rank FROM ft)"""
FEATURES_SQL = f"{EMB},\n{MOMENTS},\n{VP}"


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, repeat, feature, imp (eta_sq without every fifth sample), v_total, imp_rank, v_rank: repeats are a key."""
    long = emb(spark, sf_dir)
    out = long.withColumn("repeat", F.explode(F.array(*map(F.lit, range(REPEATS))))).filter("sample_id % 5 <> repeat")
    imp = moments.eta2(out, ["view", "repeat"]).select("view", "repeat", "feature", F.col("eta_sq").alias("imp"))
    rows = imp.join(features(spark, sf_dir).select("view", "feature", "v_total"), ["view", "feature"])
    keys = ["view", "repeat"]
    return ranking.ranked(ranking.ranked(rows, keys, "imp", out="imp_rank"), keys, "v_total", out="v_rank")


REPEATS_SQL = f"""{FEATURES_SQL},
re AS (SELECT emb.*, r AS repeat FROM emb, range(0, {REPEATS}) t(r) WHERE sample_id % 5 <> r),
rc AS (SELECT view, repeat, feature, label, count(*) AS n, avg(x) AS mu FROM re GROUP BY ALL),
rt AS (SELECT view, repeat, feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS vp FROM re GROUP BY ALL),
ri AS (SELECT view, repeat, feature, greatest(0.0, least(1.0, sum(rc.n / CAST(rt.n AS DOUBLE) * (mu - mean) ** 2) / (any_value(vp) + 1e-12))) AS imp FROM rc JOIN rt USING (view, repeat, feature) GROUP BY ALL),
rep AS (SELECT *, row_number() OVER (PARTITION BY view, repeat ORDER BY imp DESC, feature) AS imp_rank, row_number() OVER (PARTITION BY view, repeat ORDER BY v_total DESC, feature) AS v_rank
  FROM ri JOIN (SELECT view, feature, v_total FROM ft) USING (view, feature))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", (F.col("vec_id") % 7).alias("group_id"))


SAMPLES = "samples AS (SELECT vec_id AS sample_id, label, vec_id % 7 AS group_id FROM embeddings)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, view, model, k_pct, repeat, fold, strategy, value: pseudo-scores from 0.5 to 0.9."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("r_name").alias("dataset"), F.col("n_name").alias("view"))
    for name, values in (("model", ["rf", "xgb"]), ("k_pct", K_PCTS), ("repeat", list(range(3))), ("fold", [0, 1]), ("strategy", ["all", "var", "shap", "random", "saf"])):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    u = resample.unit(*[F.col(c).cast("string") for c in ("view", "model", "k_pct", "repeat", "fold", "strategy")])
    return rows.withColumn("value", 0.5 + 0.4 * u)


UNIT = "CAST(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
RESULTS = f"""res AS (SELECT dataset, view, model, k_pct, repeat, fold, strategy, 0.5 + 0.4 * ({UNIT.format("concat_ws('|', view, model, k_pct, repeat, fold, strategy)")}) AS value
  FROM (SELECT r_name AS dataset, n_name AS view FROM nation JOIN region ON n_regionkey = r_regionkey), unnest(['rf', 'xgb']) a(model), unnest([1, 5, 10, 20]) b(k_pct), range(0, 3) c(repeat), range(0, 2) d(fold), unnest(['all', 'var', 'shap', 'random', 'saf']) e(strategy))"""


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, view, di, di_lo, di_hi, delta: one point a view at K = 10 and model rf."""
    r = results(spark, sf_dir).filter("k_pct = 10 and model = 'rf'")
    d = r.groupBy("dataset", "view").agg((F.avg(F.when(F.col("strategy") == "var", F.col("value"))) - F.avg(F.when(F.col("strategy") == "random", F.col("value")))).alias("delta"))
    u = resample.unit(F.lit("di"), F.col("view"))
    return d.withColumn("di", F.round(0.6 + 0.6 * u, 2)).withColumns({"di_lo": F.col("di") - 0.05, "di_hi": F.col("di") + 0.07})


SCATTER = f"""{RESULTS},
sc AS (SELECT *, di - 0.05 AS di_lo, di + 0.07 AS di_hi FROM (SELECT dataset, view, avg(value) FILTER (strategy = 'var') - avg(value) FILTER (strategy = 'random') AS delta, round(0.6 + 0.6 * ({UNIT.format("'di|' || view")}), 2) AS di
  FROM res WHERE k_pct = 10 AND model = 'rf' GROUP BY dataset, view))"""
