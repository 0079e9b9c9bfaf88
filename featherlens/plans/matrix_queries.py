"""Queries of moments, ranks, top-K sets and transforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import moments, overlap, ranking, stats, transform
from . import fixtures as fx
from .fixtures import BRAND, EMB, FEATURES_SQL, K_PCTS, LINE, REPEATS_SQL, VIEW
from .registry import query

# ---- aggregates over features and classes


@query("agg_marginal_variance", f"WITH {EMB} SELECT view, feature, count(x) AS n, avg(x) AS mean, CASE WHEN count(x) < 2 THEN 0 ELSE var_samp(x) END AS variance FROM emb GROUP BY view, feature", "mean variance", "n")
def _(spark, sf):
    return moments.marginal_variance(fx.emb(spark, sf), VIEW)


@query("agg_eta2_features", f"WITH {FEATURES_SQL} SELECT view, feature, v_total, v_between, v_within, eta_sq FROM ft", "v_total v_between v_within eta_sq")
def _(spark, sf):
    return moments.eta2(fx.emb(spark, sf), VIEW)


@query("agg_eta2_line", f"WITH {LINE}, {fx.MOMENTS.replace('FROM emb', 'FROM line')} SELECT view, feature, v_total / 1e6 AS v_total, v_between / 1e6 AS v_between, eta_sq FROM ft", "v_total v_between eta_sq")
def _(spark, sf):
    e = moments.eta2(fx.line(spark, sf), VIEW)
    return e.select("view", "feature", (F.col("v_total") / 1e6).alias("v_total"), (F.col("v_between") / 1e6).alias("v_between"), "eta_sq")


@query("agg_eta2_1d", f"WITH {EMB}, {fx.MOMENTS} SELECT feature, CASE WHEN v_total <= 0 THEN 0 ELSE eta_sq END AS eta_sq FROM ft WHERE feature = 'f000'", "eta_sq")
def _(spark, sf):
    e = moments.eta2(fx.emb(spark, sf).filter("feature = 'f000'"), [])
    return e.select("feature", F.when(F.col("v_total") <= 0, 0.0).otherwise(F.col("eta_sq")).alias("eta_sq"))


@query(
    "agg_variance_decomposition",
    f"""WITH {FEATURES_SQL} SELECT view, feature, v_total AS var_total, v_between AS var_between, v_within AS var_within, v_between / (v_within + 1e-12) AS r_snr, v_between / (v_total + 1e-12) AS r_frac,
    abs(v_total - v_between - v_within) AS residual FROM ft""",
    "var_total var_between var_within r_snr r_frac residual",
)
def _(spark, sf):
    return moments.decomposition(fx.emb(spark, sf), VIEW)


@query("agg_between_within_bundle", f"WITH {FEATURES_SQL} SELECT view, max(abs(v_total - v_between - v_within)) AS max_residual, avg(abs(v_total - v_between - v_within)) AS mean_residual, count(*) AS n_features FROM ft GROUP BY view", "max_residual mean_residual", "n_features")
def _(spark, sf):
    d = moments.decomposition(fx.emb(spark, sf), VIEW)
    return d.groupBy("view").agg(F.max("residual").alias("max_residual"), F.avg("residual").alias("mean_residual"), F.count("*").alias("n_features"))


@query("agg_fisher", f"WITH {FEATURES_SQL} SELECT view, feature, fis AS score FROM ft", "score")
def _(spark, sf):
    return moments.fisher(fx.emb(spark, sf), VIEW)


@query("agg_mean_var_importance", f"WITH {EMB}, {fx.MOMENTS} SELECT view, feature, var_pop(mu) AS score FROM cls GROUP BY view, feature", "score")
def _(spark, sf):
    return moments.class_mean_variance(fx.emb(spark, sf), VIEW)


@query(
    "agg_check_scale",
    f"""WITH {BRAND}, f AS (SELECT view, feature, var_pop(x) AS v, min(x) AS lo, max(x) AS hi FROM brand GROUP BY ALL), a AS (SELECT view, avg(v) AS mean_var, stddev_pop(v) AS sd_var, min(lo) AS lo, max(hi) AS hi FROM f GROUP BY view),
    s AS (SELECT view, avg(t) AS mean_row_sum FROM (SELECT view, sample_id, sum(x) AS t FROM brand GROUP BY ALL) GROUP BY view)
    SELECT view, mean_var / 1e9 AS mean_var, sd_var / 1e9 AS sd_var, lo, hi, mean_row_sum, greatest(abs(lo), abs(hi)) AS max_abs, abs(mean_var - 1) < 0.1 AND sd_var < 0.1 AS is_standardized, greatest(abs(lo), abs(hi)) < 50 AS is_log,
    lo >= 0 AND abs(mean_row_sum - 1) < 0.05 AS is_compositional FROM a JOIN s USING (view)""",
    "mean_var sd_var lo hi mean_row_sum max_abs",
)
def _(spark, sf):
    return moments.scale_check(fx.brand(spark, sf), VIEW).withColumns({"mean_var": F.col("mean_var") / 1e9, "sd_var": F.col("sd_var") / 1e9})


_HOLES = "h AS (SELECT view, sample_id, feature, label, CASE WHEN (sample_id + feature_ord) % 10 < feature_ord % 6 THEN NULL ELSE x END AS x FROM emb)"


def _holes(spark, sf):
    """emb with missing values: none of some features, half of others."""
    e = fx.emb(spark, sf)
    return e.withColumn("x", F.when((F.col("sample_id") + F.col("feature_ord")) % 10 < F.col("feature_ord") % 6, None).otherwise(F.col("x"))).select("view", "sample_id", "feature", "label", "x")


@query(
    "agg_median_impute_stat",
    f"""WITH {EMB}, {_HOLES}, f AS (SELECT view, feature, avg(CAST(x IS NULL AS INT)) AS miss, quantile_cont(x, 0.5) AS med FROM h GROUP BY ALL),
    k AS (SELECT h.view, h.feature, coalesce(h.x, f.med, 0) AS x FROM h JOIN f USING (view, feature) WHERE miss <= 0.3), s AS (SELECT view, feature, var_pop(x) AS v FROM k GROUP BY ALL)
    SELECT f.view, count(*) AS n_features, count(*) FILTER (miss > 0.3) AS n_dropped_missing, sum(miss) FILTER (miss <= 0.3) AS missing_mass, (SELECT count(*) FROM s WHERE v <= 0) AS n_constant FROM f GROUP BY f.view""",
    "missing_mass",
    "n_features n_dropped_missing n_constant",
)
def _(spark, sf):
    return transform.missingness(_holes(spark, sf), VIEW)[1]


@query("mat_median_impute_on_load", f"WITH {EMB}, {_HOLES}, f AS (SELECT view, feature, quantile_cont(x, 0.5) AS med FROM h GROUP BY ALL) SELECT view, feature, sum(coalesce(x, med)) AS total FROM h JOIN f USING (view, feature) GROUP BY view, feature", "total")
def _(spark, sf):
    return transform.median_impute(_holes(spark, sf), VIEW).groupBy("view", "feature").agg(F.sum("x").alias("total"))


@query("mat_mean_impute", f"WITH {EMB}, {_HOLES} SELECT view, feature, sum(y) AS total FROM (SELECT view, feature, coalesce(x, avg(x) OVER (PARTITION BY view, feature), 0) AS y FROM h) GROUP BY view, feature", "total")
def _(spark, sf):
    return transform.mean_impute(_holes(spark, sf), VIEW).groupBy("view", "feature").agg(F.sum("x").alias("total"))


@query("pred_drop_allnan_zero_var", f"WITH {EMB}, {_HOLES}, z AS (SELECT view, feature, CASE WHEN feature < 'f004' THEN 1.0 WHEN feature < 'f008' THEN NULL ELSE x END AS x FROM h) SELECT view, feature FROM z GROUP BY view, feature HAVING count(x) > 0 AND var_samp(x) > 0")
def _(spark, sf):
    z = _holes(spark, sf).withColumn("x", F.when(F.col("feature") < "f004", 1.0).when(F.col("feature") < "f008", None).otherwise(F.col("x")))
    return transform.varying_features(z, VIEW)


@query("agg_class_distribution", "SELECT sum(n) AS n, count(*) AS n_classes, max(n) / CAST(sum(n) AS DOUBLE) AS max_share FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)", "max_share", "n n_classes")
def _(spark, sf):
    c = fx.samples(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.sum("n").alias("n"), F.count("*").alias("n_classes"), (F.max("n") / F.sum("n")).alias("max_share"))


@query("agg_group_label_counts", f"WITH {fx.SAMPLES} SELECT group_id, " + ", ".join(f"count(*) FILTER (label = {i}) AS c{i}" for i in range(10)) + " FROM samples GROUP BY group_id", "", "group_id " + " ".join(f"c{i}" for i in range(10)))
def _(spark, sf):
    p = fx.samples(spark, sf).groupBy("group_id").pivot("label", list(range(10))).count().fillna(0)
    return p.withColumnsRenamed({str(i): f"c{i}" for i in range(10)})


@query("agg_repeat_level_stats", f"WITH {REPEATS_SQL} SELECT view, feature, avg(imp) AS mean, stddev_samp(imp) AS sd, quantile_cont(imp, 0.025) AS lo, quantile_cont(imp, 0.975) AS hi, count(*) AS n FROM rep GROUP BY view, feature", "mean sd lo hi", "n")
def _(spark, sf):
    p = F.percentile("imp", F.array(F.lit(0.025), F.lit(0.975)))
    return fx.repeats(spark, sf).groupBy("view", "feature").agg(F.avg("imp").alias("mean"), F.stddev_samp("imp").alias("sd"), p[0].alias("lo"), p[1].alias("hi"), F.count("*").alias("n"))


@query("agg_mean_abs_shap", f"WITH {EMB} SELECT view, feature, avg(abs(x)) AS mean_abs FROM emb GROUP BY view, feature", "mean_abs")
def _(spark, sf):
    return fx.emb(spark, sf).groupBy("view", "feature").agg(F.avg(F.abs("x")).alias("mean_abs"))


@query("agg_shap_fold_weighting", f"WITH {EMB}, f AS (SELECT view, feature, sample_id % 5 AS fold, avg(abs(x)) AS m, count(*) AS n FROM emb GROUP BY ALL) SELECT view, feature, sum(m * n) / sum(n) AS weighted FROM f GROUP BY view, feature", "weighted")
def _(spark, sf):
    f = fx.emb(spark, sf).groupBy("view", "feature", (F.col("sample_id") % 5).alias("fold")).agg(F.avg(F.abs("x")).alias("m"), F.count("*").alias("n"))
    return f.groupBy("view", "feature").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"))


@query("agg_gene_max", "SELECT p_brand AS gene, max(p_retailprice) AS score FROM part GROUP BY p_brand", "score")
def _(spark, sf):
    return fx.table(spark, sf, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.max("p_retailprice").alias("score"))


@query("agg_first_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return fx.table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).filter("n = 1").select("o_custkey", "o_orderkey")


@query("agg_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag", "", "n_suppliers n_parts")
def _(spark, sf):
    return fx.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_partkey").alias("n_parts"))


@query("agg_grouping_sets", "SELECT coalesce(l_returnflag, '__ALL__') AS flag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))", "qty", "n")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    g = li.groupingSets([["l_returnflag", "l_linestatus"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return g.select(F.coalesce("l_returnflag", F.lit("__ALL__")).alias("flag"), "l_linestatus", "n", "qty")


@query("agg_welford_merge", "SELECT count(l_quantity) AS n, avg(l_quantity) AS mean, var_samp(l_quantity) AS variance, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem", "mean variance lo hi", "n")
def _(spark, sf):
    x = F.col("l_quantity")
    parts = fx.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 16).alias("batch")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    w = Window.partitionBy(F.lit(0))
    parts = parts.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    m2 = F.sum(F.col("m2") + F.col("n") * (F.col("m") - F.col("mean")) ** 2)
    return parts.agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), (m2 / (F.sum("n") - 1)).alias("variance"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


# ---- transforms


@query("mat_log1p", f"WITH {EMB} SELECT view, feature, sum(ln(1 + greatest(x, 0))) AS total FROM emb GROUP BY view, feature", "total")
def _(spark, sf):
    return fx.emb(spark, sf).groupBy("view", "feature").agg(F.sum(transform.log1p(F.col("x"))).alias("total"))


@query("mat_clr", f"WITH {BRAND} SELECT view, sample_id, feature, ln(x + 1e-6) - avg(ln(x + 1e-6)) OVER (PARTITION BY view, sample_id) AS x FROM brand", "x")
def _(spark, sf):
    return transform.clr(fx.brand(spark, sf), VIEW).select("view", "sample_id", "feature", "x")


@query("mat_mvalue", f"WITH {LINE} SELECT feature, sum(log2(least(greatest(x, 1e-6), 1 - 1e-6) / (1 - least(greatest(x, 1e-6), 1 - 1e-6)))) AS total FROM line WHERE feature IN ('l_discount', 'l_tax') GROUP BY feature", "total")
def _(spark, sf):
    return fx.line(spark, sf).filter("feature in ('l_discount', 'l_tax')").groupBy("feature").agg(F.sum(transform.m_value(F.col("x"))).alias("total"))


@query("mat_standard_scale", f"WITH {BRAND} SELECT sample_id, feature, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM brand WINDOW w AS (PARTITION BY feature)", "x")
def _(spark, sf):
    return transform.standard_scale(fx.brand(spark, sf), VIEW).select("sample_id", "feature", "x")


@query("mat_float_cast", f"WITH {LINE} SELECT feature, sum(CAST(CAST(x AS FLOAT) AS DOUBLE)) / 1000 AS total FROM line GROUP BY feature", "total")
def _(spark, sf):
    return fx.line(spark, sf).groupBy("feature").agg((F.sum(F.col("x").cast("float").cast("double")) / 1000).alias("total"))


@query("mat_normalize_compositional", f"""WITH {BRAND}, c AS (SELECT sample_id, feature, x / sum(x) OVER (PARTITION BY sample_id) AS x FROM brand)
  SELECT 'brand' AS view, feature, sum(ln(1 + x)) AS total FROM brand GROUP BY feature UNION ALL SELECT 'brand_clr', feature, sum(y) FROM (SELECT feature, ln(x + 1e-6) - avg(ln(x + 1e-6)) OVER (PARTITION BY sample_id) AS y FROM c) GROUP BY feature""", "total")  # fmt: skip
def _(spark, sf):
    b = fx.brand(spark, sf)
    shares = b.withColumn("x", F.col("x") / F.sum("x").over(Window.partitionBy("sample_id")))
    views = b.withColumn("x", transform.log1p(F.col("x"))).unionByName(transform.clr(shares, VIEW).withColumn("view", F.lit("brand_clr")))
    return views.groupBy("view", "feature").agg(F.sum("x").alias("total"))


@query("scan_bundle_view", f"WITH {EMB}, {BRAND}, v AS (SELECT view, sample_id, feature, x FROM emb UNION ALL SELECT view, sample_id, feature, x FROM brand) SELECT sample_id, feature, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM v WHERE lower(view) = lower('BRAND')", "x")
def _(spark, sf):
    cols = ["view", "sample_id", "feature", "x"]
    v = fx.emb(spark, sf).select(cols).unionByName(fx.brand(spark, sf).select(cols))
    return v.filter(F.lower("view") == "brand").select("sample_id", "feature", F.col("x").cast("float").cast("double").alias("x"))


@query("scan_bundle_inventory", f"WITH {fx.SAMPLES}, c AS (SELECT label, count(*) AS n FROM samples GROUP BY label) SELECT sum(n) AS n_samples, count(*) AS n_classes, min(n) AS min_class_n, string_agg(label || ':' || n, ',' ORDER BY label) AS classes FROM c", "", "n_samples n_classes min_class_n")
def _(spark, sf):
    c = fx.samples(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "n"))), lambda s: F.concat_ws(":", s["label"].cast("string"), s["n"].cast("string"))), ",")
    return c.agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_classes"), F.min("n").alias("min_class_n"), text.alias("classes"))


@query("shape_melt", f"WITH {LINE} SELECT feature, count(*) AS n, sum(x) / 1000 AS total FROM line GROUP BY feature", "total", "n")
def _(spark, sf):
    return fx.line(spark, sf).groupBy("feature").agg(F.count("*").alias("n"), (F.sum("x") / 1000).alias("total"))


@query("set_intersect_samples", f"WITH {EMB}, {BRAND}, v AS (SELECT DISTINCT view, sample_id FROM emb UNION ALL SELECT DISTINCT view, sample_id FROM brand) SELECT sample_id FROM v GROUP BY sample_id HAVING count(DISTINCT view) = 2")
def _(spark, sf):
    v = fx.emb(spark, sf).select("view", "sample_id").unionByName(fx.brand(spark, sf).select("view", "sample_id"))
    return transform.common_samples(v, ["emb", "brand"])


@query("join_densify", f"WITH {BRAND}, s AS (SELECT s_suppkey AS sample_id FROM supplier), f AS (SELECT DISTINCT p_brand AS feature FROM part) SELECT s.sample_id, f.feature, coalesce(x, 0) AS x FROM s CROSS JOIN f LEFT JOIN brand b ON s.sample_id = b.sample_id AND f.feature = b.feature", "x")
def _(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    f = fx.table(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()
    return transform.densify(fx.brand(spark, sf).select("sample_id", "feature", "x"), s, f).select("sample_id", "feature", "x")


# ---- ranks


def _rank_query(name, tie, expr):
    @query(name, f"WITH {LINE}, c AS (SELECT l_partkey AS feature, count(*) AS score FROM lineitem GROUP BY l_partkey) SELECT feature, score, {expr} AS rank FROM c", *(("rank", "score") if tie == "average" else ("", "score rank")))
    def _(spark, sf):
        c = fx.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.count("*").alias("score"))
        out = ranking.ranked_whole(c, "score", "name" if tie == "zero" else tie)
        return out.withColumn("rank", F.col("rank") - 1) if tie == "zero" else out


for _name, _tie, _expr in (
    ("win_rank_name_tiebreak", "name", "row_number() OVER (ORDER BY score DESC, feature)"),
    ("win_rank_desc_zero_based", "zero", "row_number() OVER (ORDER BY score DESC, feature) - 1"),
    ("win_rank_min", "min", "rank() OVER (ORDER BY score DESC)"),
    ("win_rank_dense", "dense", "dense_rank() OVER (ORDER BY score DESC)"),
    ("win_rank_average", "average", "rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0"),
):
    _rank_query(_name, _tie, _expr)


@query("win_rank_desc_stable", f"WITH {FEATURES_SQL} SELECT view, feature, row_number() OVER (PARTITION BY view ORDER BY v_total DESC, feature) AS rank FROM ft", "", "rank")
def _(spark, sf):
    return ranking.ranked(fx.features(spark, sf), VIEW, "v_total").select("view", "feature", "rank")


@query("win_percentile_from_rank", f"WITH {FEATURES_SQL} SELECT view, feature, 1 - (v_rank - 1) / (count(*) OVER (PARTITION BY view) - 1.0) AS percentile FROM vp", "percentile")
def _(spark, sf):
    return fx.vp(spark, sf).select("view", "feature", ranking.percentile_from_rank(VIEW, "v_rank").alias("percentile"))


@query("win_rank_pct_average", f"""WITH {FEATURES_SQL}, r AS (SELECT view, feature, (rank() OVER (PARTITION BY view ORDER BY v_total) + (count(*) OVER (PARTITION BY view, v_total) - 1) / 2.0) / count(*) OVER (PARTITION BY view) * 100 AS v,
  (rank() OVER (PARTITION BY view ORDER BY eta_sq) + (count(*) OVER (PARTITION BY view, eta_sq) - 1) / 2.0) / count(*) OVER (PARTITION BY view) * 100 AS p FROM ft)
  SELECT view, feature, v, p, CASE WHEN v > 50 AND p > 50 THEN 'Q1' WHEN v > 50 THEN 'Q2' WHEN p > 50 THEN 'Q4' ELSE 'Q3' END AS quadrant FROM r""", "v p")  # fmt: skip
def _(spark, sf):
    f = fx.features(spark, sf)
    n = F.count("*").over(Window.partitionBy("view"))
    pct = lambda c: ranking.rank_column(VIEW, c, "average", descending=False) / n * 100
    r = f.select("view", "feature", pct("v_total").alias("v"), pct("eta_sq").alias("p"))
    v, p = F.col("v") > 50, F.col("p") > 50
    return r.withColumn("quadrant", F.when(v & p, "Q1").when(v, "Q2").when(p, "Q4").otherwise("Q3"))


@query("win_consensus_rank", f"WITH {FEATURES_SQL}, m AS (SELECT view, feature, (eta_rank + fis_rank) / 2.0 AS mean_rank FROM vp) SELECT view, feature, mean_rank, row_number() OVER (PARTITION BY view ORDER BY mean_rank, feature) AS consensus_rank FROM m", "mean_rank", "consensus_rank")
def _(spark, sf):
    vp = fx.vp(spark, sf)
    ranks = vp.select("view", "feature", F.col("eta_rank").alias("rank")).unionByName(vp.select("view", "feature", F.col("fis_rank").alias("rank")))
    return ranking.consensus(ranks, VIEW)


@query("win_dedup_max", """WITH d AS (SELECT 'parts' AS view, p_brand AS feature, p_retailprice AS score, p_partkey AS ord FROM part),
  k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY feature ORDER BY score DESC, ord) = 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM k)
  SELECT *, rank / CAST(count(*) OVER () AS DOUBLE) AS rank_pct FROM r""", "score rank_pct", "rank")  # fmt: skip
def _(spark, sf):
    d = fx.table(spark, sf, "part").select(F.lit("parts").alias("view"), F.col("p_brand").alias("feature"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("ord"))
    return ranking.dedup_max(d, VIEW, "score", "ord")


@query("proj_rank_to_pct", f"WITH {FEATURES_SQL} SELECT view, feature, (v_total - min(v_total) OVER (PARTITION BY view)) / (max(v_total) OVER (PARTITION BY view) - min(v_total) OVER (PARTITION BY view)) * 100 AS pct FROM ft", "pct")
def _(spark, sf):
    return fx.features(spark, sf).select("view", "feature", ranking.rescaled(VIEW, "v_total").alias("pct"))


for _rule, _fn in (("floor", "floor"), ("ceil", "ceil"), ("round", "round_even")):
    _raw = "count(*) OVER (PARTITION BY view) * CAST(k_pct AS DOUBLE) / 100"
    _k = f"greatest(1, CAST({f'round_even({_raw}, 0)' if _rule == 'round' else f'{_fn}({_raw})'} AS BIGINT))"

    @query(f"topk_{_rule}", f"WITH {FEATURES_SQL}, g AS (SELECT view, feature, v_rank, k_pct FROM vp, unnest([1, 5, 10, 20]) t(k_pct)), h AS (SELECT *, {_k.replace('PARTITION BY view', 'PARTITION BY view, k_pct')} AS k_n FROM g) SELECT view, k_pct, feature FROM h WHERE v_rank <= k_n", "", "k_pct")
    def _(spark, sf, rule=_rule):
        n = F.count("*").over(Window.partitionBy("view"))
        rows = ranking.with_k(fx.vp(spark, sf).withColumn("n", n), K_PCTS)
        return rows.filter(F.col("v_rank") <= ranking.k_count(F.col("n"), F.col("k_pct"), rule)).select("view", "k_pct", "feature")


@query("topk_eta_enrichment", f"WITH {FEATURES_SQL} SELECT view, avg(eta_sq) FILTER (v_rank <= 6) AS eta_topv, avg(eta_sq) AS eta_all, avg(eta_sq) FILTER (v_rank <= 6) / (avg(eta_sq) + 1e-12) AS eta_es FROM vp GROUP BY view", "eta_topv eta_all eta_es")
def _(spark, sf):
    return stats.eta_enrichment(fx.features(spark, sf), VIEW, 10)


@query("topk_per_view_topn", f"WITH {FEATURES_SQL} SELECT view, feature, v_total, v_rank AS rank FROM vp WHERE v_rank <= 15", "v_total", "rank")
def _(spark, sf):
    return ranking.top_n(fx.features(spark, sf), VIEW, "v_total", 15).select("view", "feature", "v_total", "rank")


@query("topk_by_rank", f"WITH {FEATURES_SQL} SELECT view, feature FROM vp WHERE eta_rank <= 12")
def _(spark, sf):
    return ranking.top_n(fx.features(spark, sf), VIEW, "eta_sq", 12).select("view", "feature")


@query("topk_top_sets_json", f"WITH {FEATURES_SQL} SELECT view, k, string_agg(feature, ',' ORDER BY v_rank) AS features FROM vp, unnest([10, 20, 50]) t(k) WHERE v_rank <= k GROUP BY view, k", "", "k")
def _(spark, sf):
    rows = fx.vp(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, (10, 20, 50))))).filter("v_rank <= k")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("v_rank", "feature"))), lambda s: s["feature"]), ",")
    return rows.groupBy("view", "k").agg(listed.alias("features"))


@query("topk_exemplars", f"""WITH {FEATURES_SQL}, q AS (SELECT view, feature, v_rank, eta_rank, CASE WHEN v_rank <= 32 AND eta_rank <= 32 THEN 'Q1' WHEN v_rank <= 32 THEN 'Q2' WHEN eta_rank <= 32 THEN 'Q4' ELSE 'Q3' END AS quadrant FROM vp)
  SELECT view, quadrant, feature FROM q QUALIFY row_number() OVER (PARTITION BY view, quadrant ORDER BY CASE quadrant WHEN 'Q1' THEN v_rank + eta_rank WHEN 'Q2' THEN v_rank - eta_rank WHEN 'Q4' THEN eta_rank - v_rank ELSE -v_rank - eta_rank END, feature) <= 3""")  # fmt: skip
def _(spark, sf):
    v, e = F.col("v_rank"), F.col("eta_rank")
    q = F.when((v <= 32) & (e <= 32), "Q1").when(v <= 32, "Q2").when(e <= 32, "Q4").otherwise("Q3")
    order = F.when(F.col("quadrant") == "Q1", v + e).when(F.col("quadrant") == "Q2", v - e).when(F.col("quadrant") == "Q4", e - v).otherwise(-v - e)
    rows = fx.vp(spark, sf).withColumn("quadrant", q).withColumn("o", order)
    return ranking.ranked(rows, ["view", "quadrant"], "o", descending=False).filter("rank <= 3").select("view", "quadrant", "feature")


@query("topk_from_rank_table", f"WITH {FEATURES_SQL}, k AS (SELECT view, feature FROM emb GROUP BY ALL HAVING min(feature_ord) % 2 = 0) SELECT view, feature FROM vp JOIN k USING (view, feature) QUALIFY row_number() OVER (PARTITION BY view ORDER BY eta_rank) <= 10")
def _(spark, sf):
    have = fx.emb(spark, sf).filter("feature_ord % 2 = 0").select("view", "feature").distinct()
    rows = fx.vp(spark, sf).join(have, ["view", "feature"], "left_semi")
    return ranking.ranked(rows, VIEW, "eta_rank", descending=False).filter("rank <= 10").select("view", "feature")


@query("topk_variance_view", f"WITH {FEATURES_SQL} SELECT view, feature, v_total AS score, v_rank AS rank, 1 - (v_rank - 1) / 63.0 AS percentile, t.vs AS marginal_variance, row_number() OVER (PARTITION BY view ORDER BY t.vs DESC, feature) AS marginal_rank FROM vp JOIN tot t USING (view, feature)", "score percentile marginal_variance", "rank marginal_rank")
def _(spark, sf):
    m = moments.marginal_variance(fx.emb(spark, sf), VIEW).select("view", "feature", F.col("variance").alias("marginal_variance"))
    rows = fx.vp(spark, sf).join(m, ["view", "feature"])
    rows = ranking.ranked(rows, VIEW, "marginal_variance", out="marginal_rank")
    return rows.select("view", "feature", F.col("v_total").alias("score"), F.col("v_rank").alias("rank"), ranking.percentile_from_rank(VIEW, "v_rank").alias("percentile"), "marginal_variance", "marginal_rank")


@query("shape_explode_k", f"WITH {FEATURES_SQL} SELECT view, k_pct, avg(eta_sq) FILTER (v_rank <= greatest(1, CAST(floor(64 * CAST(k_pct AS DOUBLE) / 100) AS BIGINT))) AS eta_topv FROM vp, unnest([1, 5, 10, 20]) t(k_pct) GROUP BY view, k_pct", "eta_topv", "k_pct")
def _(spark, sf):
    rows = ranking.with_k(fx.vp(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("view"))), K_PCTS)
    top = F.col("v_rank") <= ranking.k_count(F.col("n"), F.col("k_pct"))
    return rows.groupBy("view", "k_pct").agg(F.avg(F.when(top, F.col("eta_sq"))).alias("eta_topv"))


# ---- overlap

_GRID = """kg AS (SELECT {keys}, k_pct, greatest(1, CAST(floor(64 * CAST(k_pct AS DOUBLE) / 100) AS BIGINT)) AS k_n, v_rank, {p} AS p_rank FROM {src}, unnest([1, 5, 10, 20]) t(k_pct)),
jg AS (SELECT {keys}, k_pct, k_n, 64 AS n, k_pct / 100.0 AS q, count(*) FILTER (v_rank <= k_n AND p_rank <= k_n) AS overlap, count(*) FILTER (v_rank <= k_n AND p_rank <= k_n) / CAST(count(*) FILTER (v_rank <= k_n OR p_rank <= k_n) AS DOUBLE) AS j_obs FROM kg GROUP BY ALL),
grid AS (SELECT *, q / (2 - q) AS j_rand, j_obs - q / (2 - q) AS delta_j, (j_obs - q / (2 - q)) / (1 - q / (2 - q)) AS tilde_j, (1 - j_obs) / (1 - q / (2 - q)) AS di FROM jg)"""
GRID_SQL = f"{FEATURES_SQL}, {_GRID.format(keys='view', p='eta_rank', src='vp')}"
REPEAT_GRID_SQL = f"{REPEATS_SQL}, {_GRID.format(keys='view, repeat', p='imp_rank', src='rep')}"
_G = "q j_obs j_rand delta_j tilde_j di"


def grid(spark, sf):
    return overlap.k_grid(fx.vp(spark, sf, "v_rank eta_rank"), VIEW, "v_rank", "eta_rank", K_PCTS)


def repeat_grid(spark, sf):
    return overlap.k_grid(fx.repeats(spark, sf), ["view", "repeat"], "v_rank", "imp_rank", K_PCTS)


@query("set_kgrid_metrics", f"WITH {GRID_SQL} SELECT * FROM grid", _G, "k_pct k_n n overlap")
def _(spark, sf):
    return grid(spark, sf)


@query("set_di_across_repeats", f"WITH {REPEAT_GRID_SQL} SELECT * FROM grid", _G, "repeat k_pct k_n n overlap")
def _(spark, sf):
    return repeat_grid(spark, sf)


for _name, _col, _sql in (("set_j_rand", "j_rand", "q / (2 - q)"), ("set_delta_j", "delta_j", "j_obs - q / (2 - q)"), ("set_j_tilde", "tilde_j", "(j_obs - q / (2 - q)) / (1 - q / (2 - q))"), ("set_di_stable", "di", "(1 - j_obs) / (1 - q / (2 - q))")):

    @query(_name, f"WITH {GRID_SQL} SELECT view, k_pct, {_sql} AS {_col} FROM jg", _col, "k_pct")
    def _(spark, sf, col=_col):
        return grid(spark, sf).select("view", "k_pct", col)


@query("set_di", f"WITH {GRID_SQL} SELECT view, k_pct, 1 - tilde_j AS di FROM grid", "di", "k_pct")
def _(spark, sf):
    return grid(spark, sf).select("view", "k_pct", overlap.di(F.col("j_obs"), F.col("q")).alias("di"))


for _name, _empty in (("set_jaccard", 1.0), ("set_jaccard_nan", None), ("set_jaccard_zero", 0.0), ("set_jaccard_safe", None)):

    @query(_name, f"WITH {FEATURES_SQL} SELECT view, k, CASE WHEN count(*) FILTER (v_rank <= k OR fis_rank <= k) = 0 THEN {'NULL' if _empty is None else _empty} ELSE count(*) FILTER (v_rank <= k AND fis_rank <= k) / CAST(count(*) FILTER (v_rank <= k OR fis_rank <= k) AS DOUBLE) END AS j FROM vp, unnest([0, 3, 9]) t(k) GROUP BY view, k", "j", "k")
    def _(spark, sf, empty=_empty):
        rows = fx.vp(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, (0, 3, 9)))))
        return rows.groupBy("view", "k").agg(overlap.jaccard(F.col("v_rank") <= F.col("k"), F.col("fis_rank") <= F.col("k"), empty).alias("j"))


@query("set_expected_jaccard_ab", "SELECT n, a, b, (a * b / CAST(n AS DOUBLE)) / (a + b - a * b / CAST(n AS DOUBLE)) AS expected FROM unnest([100, 1000]) x(n), unnest([5, 10]) y(a), unnest([10, 50]) z(b)", "expected", "n a b")
def _(spark, sf):
    rows = spark.range(1)
    for c, v in (("n", (100, 1000)), ("a", (5, 10)), ("b", (10, 50))):
        rows = rows.withColumn(c, F.explode(F.array(*map(F.lit, v))))
    return rows.select("n", "a", "b", overlap.expected_jaccard(F.col("n"), F.col("a"), F.col("b")).alias("expected"))


@query("set_di_one_repeat", f"""WITH {REPEATS_SQL}, a AS (SELECT view, feature, rank() OVER (PARTITION BY view ORDER BY v_total DESC) + (count(*) OVER (PARTITION BY view, v_total) - 1) / 2.0 AS vr, rank() OVER (PARTITION BY view ORDER BY imp DESC) + (count(*) OVER (PARTITION BY view, imp) - 1) / 2.0 AS pr FROM rep WHERE repeat = 0)
  SELECT view, count(*) FILTER (vr <= 6 AND pr <= 6) / CAST(count(*) FILTER (vr <= 6 OR pr <= 6) AS DOUBLE) AS j FROM a GROUP BY view""", "j")  # fmt: skip
def _(spark, sf):
    r = fx.repeats(spark, sf).filter("repeat = 0")
    r = ranking.ranked(ranking.ranked(r, VIEW, "v_total", "average", "vr"), VIEW, "imp", "average", "pr")
    return r.groupBy("view").agg(overlap.jaccard(F.col("vr") <= 6, F.col("pr") <= 6).alias("j"))


@query("set_f_di", f"WITH {FEATURES_SQL} SELECT view, (1 - j) / (1 - (6 / 64.0) / (2 - 6 / 64.0)) AS f_di FROM (SELECT view, count(*) FILTER (v_rank <= 6 AND eta_rank <= 6) / CAST(count(*) FILTER (v_rank <= 6 OR eta_rank <= 6) AS DOUBLE) AS j FROM vp GROUP BY view)", "f_di")
def _(spark, sf):
    g = overlap.k_grid(fx.vp(spark, sf), VIEW, "v_rank", "eta_rank", [10], q_rule="realised")
    return g.select("view", F.col("di").alias("f_di"))


for _name, _x in (("set_di_auc", "k_pct"), ("set_trapezoid", "q")):

    @query(_name, f"WITH {GRID_SQL}, l AS (SELECT view, ({_x} - lag({_x}) OVER (PARTITION BY view ORDER BY k_pct)) * (di + lag(di) OVER (PARTITION BY view ORDER BY k_pct)) / 2 AS a FROM grid) SELECT view, sum(a) AS auc FROM l GROUP BY view", "auc")
    def _(spark, sf, x=_x):
        return overlap.trapezoid(grid(spark, sf), VIEW, x, "di")


@query("set_decoupling_eval", f"WITH {GRID_SQL}, s AS (SELECT view, corr(v_rank, eta_rank) AS rho FROM vp GROUP BY view), l AS (SELECT view, (q - lag(q) OVER (PARTITION BY view ORDER BY q)) * (j_obs + lag(j_obs) OVER (PARTITION BY view ORDER BY q)) / 2 AS a FROM grid) SELECT s.view, rho, (SELECT sum(a) FROM l) AS auc FROM s", "rho auc")
def _(spark, sf):
    rho = fx.vp(spark, sf).groupBy("view").agg(stats.pearson(F.col("v_rank"), F.col("eta_rank")).alias("rho"))
    return rho.join(overlap.trapezoid(grid(spark, sf), VIEW, "q", "j_obs"), "view")


@query("set_quadrant_flags", f"WITH {FEATURES_SQL} SELECT view, feature, v_rank <= 12 AS in_v, eta_rank <= 12 AS in_p, v_rank <= 12 AND eta_rank <= 12 AS q1_both, v_rank <= 12 AND eta_rank > 12 AS q2_v_only, v_rank > 12 AND eta_rank > 12 AS q3_neither, v_rank > 12 AND eta_rank <= 12 AS q4_p_only FROM vp")
def _(spark, sf):
    return overlap.quadrants(fx.vp(spark, sf), "v_rank", "eta_rank", F.lit(12)).select("view", "feature", "in_v", "in_p", "q1_both", "q2_v_only", "q3_neither", "q4_p_only")


@query("set_hidden_median", f"WITH {FEATURES_SQL} SELECT view, count(*) FILTER (v_rank / 64.0 * 100 >= 50 AND eta_rank / 64.0 * 100 <= 50) AS n_hidden, count(*) FILTER (v_rank / 64.0 * 100 >= 50 AND eta_rank / 64.0 * 100 <= 50) * 100.0 / count(*) AS pct_hidden FROM vp GROUP BY view", "pct_hidden", "n_hidden")
def _(spark, sf):
    pct = fx.vp(spark, sf).select("view", (ranking.rank_share(VIEW, "v_rank") * 100).alias("v"), (ranking.rank_share(VIEW, "eta_rank") * 100).alias("p"))
    hidden = F.count_if((F.col("v") >= 50) & (F.col("p") <= 50))
    return pct.groupBy("view").agg(hidden.alias("n_hidden"), (hidden * 100.0 / F.count("*")).alias("pct_hidden"))


@query("set_hidden_topk", f"WITH {FEATURES_SQL}, v AS (SELECT unnest(['emb', 'brand']) AS view) SELECT v.view, count(feature) AS n_hidden FROM v LEFT JOIN (SELECT view, feature FROM vp WHERE v_rank / 64.0 > 0.5 AND eta_rank <= 12) h USING (view) GROUP BY v.view", "", "n_hidden")
def _(spark, sf):
    hidden = fx.vp(spark, sf).withColumn("share", ranking.rank_share(VIEW, "v_rank")).filter("share > 0.5 and eta_rank <= 12").groupBy("view").agg(F.count("*").alias("n"))
    views = spark.createDataFrame([("emb",), ("brand",)], "view string")
    return views.join(hidden, "view", "left").select("view", F.coalesce("n", F.lit(0)).alias("n_hidden"))


@query("set_gene_lists", f"WITH {FEATURES_SQL} SELECT k_pct, count(*) FILTER (v_rank <= k) AS top_v, count(*) FILTER (eta_rank <= k) AS top_p, count(*) FILTER (v_rank > 64 - k) AS low_v, count(*) FILTER (v_rank > k AND eta_rank <= k) AS q4 FROM (SELECT *, greatest(1, CAST(floor(64 * CAST(k_pct AS DOUBLE) / 100) AS BIGINT)) AS k FROM vp, unnest([1, 5, 10, 20]) t(k_pct)) GROUP BY k_pct", "", "k_pct top_v top_p low_v q4")
def _(spark, sf):
    rows = ranking.with_k(fx.vp(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("view"))), K_PCTS)
    rows = rows.withColumn("k", ranking.k_count(F.col("n"), F.col("k_pct")))
    v, p = F.col("v_rank") <= F.col("k"), F.col("eta_rank") <= F.col("k")
    return rows.groupBy("k_pct").agg(F.count_if(v).alias("top_v"), F.count_if(p).alias("top_p"), F.count_if(F.col("v_rank") > F.col("n") - F.col("k")).alias("low_v"), F.count_if(~v & p).alias("q4"))


@query("set_selection_prob", f"WITH {REPEATS_SQL} SELECT view, feature, avg(CAST(imp_rank <= 12 AS INT)) AS prob FROM rep GROUP BY view, feature", "prob")
def _(spark, sf):
    return fx.repeats(spark, sf).groupBy("view", "feature").agg(F.avg((F.col("imp_rank") <= 12).cast("double")).alias("prob"))


for _name in ("set_pairwise_jaccard", "join_cross_pairs"):

    @query(_name, f"WITH {REPEATS_SQL}, s AS (SELECT view, repeat, feature FROM rep WHERE imp_rank <= 12) SELECT a.view, a.repeat AS a, b.repeat AS b, count(*) FILTER (a.feature = b.feature) / (24.0 - count(*) FILTER (a.feature = b.feature)) AS jaccard FROM s a JOIN s b ON a.view = b.view AND a.repeat < b.repeat GROUP BY ALL", "jaccard", "a b")
    def _(spark, sf):
        return overlap.pairwise_jaccard(fx.repeats(spark, sf).withColumn("in_set", F.col("imp_rank") <= 12), VIEW, "repeat")


@query("join_cross_kgrid", f"WITH {REPEAT_GRID_SQL} SELECT view, repeat, k_pct, overlap, j_obs FROM grid", "j_obs", "repeat k_pct overlap")
def _(spark, sf):
    return repeat_grid(spark, sf).select("view", "repeat", "k_pct", "overlap", "j_obs")


@query("set_leakage", f"WITH {fx.SAMPLES} SELECT group_id, count(DISTINCT sample_id % 5) AS n_folds FROM samples GROUP BY group_id HAVING count(DISTINCT sample_id % 5) > 1", "", "n_folds")
def _(spark, sf):
    return overlap.group_leakage(fx.samples(spark, sf).withColumn("fold", F.col("sample_id") % 5), [])


@query("agg_di_uncertainty", f"""WITH {REPEAT_GRID_SQL}, r AS (SELECT *, CASE WHEN di >= 1.0 THEN 'ANTI_ALIGNED' WHEN di < 0.85 THEN 'COUPLED' ELSE 'MIXED' END AS regime FROM grid), c AS (SELECT view, k_pct, regime, count(*) AS n FROM r GROUP BY ALL),
  m AS (SELECT view, k_pct, regime AS consensus, n FROM c QUALIFY row_number() OVER (PARTITION BY view, k_pct ORDER BY n DESC, regime) = 1)
  SELECT r.view, r.k_pct, count(*) AS n_repeats, avg(di) AS di_mean, stddev_samp(di) AS di_std, quantile_cont(di, 0.025) AS di_lo, quantile_cont(di, 0.975) AS di_hi, any_value(m.consensus) AS consensus, any_value(m.n) / CAST(count(*) AS DOUBLE) AS confidence FROM r JOIN m USING (view, k_pct) GROUP BY r.view, r.k_pct""", "di_mean di_std di_lo di_hi confidence", "k_pct n_repeats")  # fmt: skip
def _(spark, sf):
    from ..operators import rules

    g = repeat_grid(spark, sf).withColumn("regime", rules.regime(F.col("di"), 0.85, 1.0, "MIXED", closed=True))
    p = F.percentile("di", F.array(F.lit(0.025), F.lit(0.975)))
    s = g.groupBy("view", "k_pct").agg(F.count("*").alias("n_repeats"), F.avg("di").alias("di_mean"), F.stddev_samp("di").alias("di_std"), p[0].alias("di_lo"), p[1].alias("di_hi"))
    c = g.groupBy("view", "k_pct", "regime").count()
    top = ranking.ranked(c, ["view", "k_pct"], "count", name="regime").filter("rank = 1")
    return s.join(top.select("view", "k_pct", F.col("regime").alias("consensus"), "count"), ["view", "k_pct"]).withColumn("confidence", F.col("count") / F.col("n_repeats")).drop("count")
