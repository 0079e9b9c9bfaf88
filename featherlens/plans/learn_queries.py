"""Queries of learners, projections, simulation and streams; stochastic ones have no SQL and are tested by invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ablate, boost, folds, learn, linear, ranking, rules, simulate, stats
from ..streaming import moments as running
from . import fixtures as fx
from .registry import query


def _data(spark, sf):
    return learn.vectors(fx.emb(spark, sf))


def _folds(spark, sf, k=2):
    return folds.stratified(fx.samples(spark, sf), k, 1, 9)


def _oof(name, predicted):
    @query(name)
    def _(spark, sf):
        return folds.confusion_metrics(predicted(spark, sf, _folds(spark, sf)), ["repeat"])


_oof("ml_baselines", lambda spark, sf, dealt: learn.out_of_fold(_data(spark, sf)[0], dealt, "logistic"))
_oof("ml_rf", lambda spark, sf, dealt: ablate.forest_out_of_fold(fx.emb(spark, sf), dealt))
_oof("ml_linearsvc", lambda spark, sf, dealt: linear.out_of_fold(_data(spark, sf)[0], dealt))
_oof("ml_xgb", lambda spark, sf, dealt: boost.out_of_fold(fx.emb(spark, sf), dealt))


@query(
    "ml_dummy",
    """WITH f AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '9', '0', vec_id)), vec_id) - 1) % 2 AS fold FROM embeddings),
    n AS (SELECT t.fold, y, count(*) FILTER (f.fold <> t.fold) AS n FROM f, (SELECT DISTINCT fold FROM f) t GROUP BY t.fold, y),
    top AS (SELECT fold, y AS p FROM n QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, y) = 1),
    o AS (SELECT y, p FROM f JOIN top USING (fold)),
    c AS (SELECT v AS c, count(*) FILTER (y = v) AS act, count(*) FILTER (p = v) AS prd, count(*) FILTER (y = v AND p = v) AS hit FROM o, (SELECT y AS v FROM o UNION SELECT p FROM o) GROUP BY v)
    SELECT 0 AS repeat, sum(hit) / sum(act) AS accuracy, avg(hit / act) FILTER (act > 0) AS balanced_accuracy, avg(2 * hit / (act + prd)) AS macro_f1 FROM c""",
    "accuracy balanced_accuracy macro_f1",
    "repeat",
)
def _(spark, sf):
    rows = learn.dummy(_data(spark, sf)[0], _folds(spark, sf))
    return folds.confusion_metrics(rows, ["repeat"])


@query("ml_tree_panel")
def _(spark, sf):
    """Five tree learners over the same folds and features: the tenth of most variance against two random tenths, and the panel's call."""
    rows = ablate.scores(fx.emb(spark, sf), _folds(spark, sf), [10], ("var", "random"), 2, rule="ceil", learners=ablate.PANEL)
    mean = lambda s: F.avg(F.when(F.col("strategy") == s, F.col("balanced_accuracy")))
    names = {"xgb4": "xgb"} | {m: m for m in ablate.PANEL[1:]}
    each = rows.groupBy("learner").agg(F.first("n_features").alias("n_features"), mean("var").alias("topvar"), mean("random").alias("random"))
    wide = each.groupBy(F.lit("emb").alias("view")).pivot("learner", list(names)).agg(F.max(100 * (F.col("topvar") - F.col("random"))))
    call = rules.panel_call({short: F.col(m) for m, short in names.items()}, F.lit(rules.INCONCLUSIVE)).alias("call")
    each = each.withColumn("learner", F.when(F.col("learner") == "xgb4", "xgb").otherwise(F.col("learner")))
    return each.withColumn("delta_pp", 100 * (F.col("topvar") - F.col("random"))).crossJoin(F.broadcast(wide.select(call)))


@query("ml_oof")
def _(spark, sf):
    return learn.out_of_fold(_data(spark, sf)[0], folds.stratified(fx.samples(spark, sf), 2, 2, 9), "logistic")


@query("stat_spearman_p")
def _(spark, sf):
    return stats.spearman_p(fx.features(spark, sf), fx.VIEW, "v_total", "eta_sq")


@query("stat_mann_whitney_p")
def _(spark, sf):
    return stats.class_robustness(fx.emb(spark, sf), fx.VIEW, 0, 1)


@query("ml_tree_driver")
def _(spark, sf):
    return ranking.ranked(ablate.forest_shap(fx.emb(spark, sf)).withColumnRenamed("mean_abs_shap", "p_score"), [], "p_score")


@query("ml_tree_shap")
def _(spark, sf):
    return ablate.forest_shap(fx.emb(spark, sf))


@query("ml_ablation_view")
def _(spark, sf):
    """All five strategies over the whole K grid, 20 random sets a fold."""
    return ablate.ablation(fx.emb(spark, sf), _folds(spark, sf), fx.K_PCTS)


@query("ml_label_perm_task")
def _(spark, sf):
    return ablate.label_permutations(fx.emb(spark, sf), _folds(spark, sf), [10, 20], 5)


@query("ml_eval_subset")
def _(spark, sf):
    return ablate.subset_scores(fx.emb(spark, sf), _folds(spark, sf), fx.K_PCTS, 20)


@query(
    "ml_feasible_group_splits",
    """WITH g AS (SELECT DISTINCT group_id, label FROM (SELECT vec_id % 7 AS group_id, label FROM embeddings)),
    k AS (SELECT k, group_id % k AS fold, label FROM g, range(2, 6) t(k)),
    ok AS (SELECT k FROM (SELECT k.k, f.fold, count(DISTINCT CASE WHEN k.fold <> f.fold THEN label END) AS n, count(CASE WHEN k.fold = f.fold THEN 1 END) AS m FROM k JOIN (SELECT k, f AS fold FROM range(2, 6) t(k), range(0, 5) u(f) WHERE f < k) f ON k.k = f.k GROUP BY ALL)
      GROUP BY k HAVING min(m) > 0 AND min(n) = (SELECT count(DISTINCT label) FROM g))
    SELECT max(k) AS n_splits FROM ok""",
    "",
    "n_splits",
)
def _(spark, sf):
    return folds.feasible_group_splits(fx.samples(spark, sf), 5)


@query("agg_pc_class_signal")
def _(spark, sf):
    return learn.pc_class_signal(_data(spark, sf)[0], 8)


@query("mat_pca_cache")
def _(spark, sf):
    return learn.pcla_of_permutations(_data(spark, sf)[0], 8, 5)


@query("mat_silhouette")
def _(spark, sf):
    data, _ = _data(spark, sf)
    return learn.silhouette(learn.scaled(data).withColumn("prediction", F.col("label").cast("int")))


@query("ml_group_kfold_greedy")
def _(spark, sf):
    return folds.grouped_greedy(fx.samples(spark, sf), 3)


@query("mat_pca_embeddings")
def _(spark, sf):
    return learn.pca(_data(spark, sf)[0], 5)[0]


@query("mat_pca_wide")
def _(spark, sf):
    """Brands as samples, suppliers as features: a matrix that grows wider with the data, never longer."""
    brand = F.regexp_extract("feature", "([0-9]+)$", 1).cast("long")
    wide = fx.brand(spark, sf).select(brand.alias("sample_id"), F.col("sample_id").cast("string").alias("feature"), "x", (brand % 4).cast("int").alias("label"))
    scores, loadings, shares = learn.wide_pca(wide, 3)
    top = ranking.ranked(loadings.withColumn("size", F.abs("loading")), ["pc"], "size").filter("rank <= 5").select("pc", F.lit("loading").alias("kind"), F.col("feature").alias("name"), F.abs("loading").alias("value"))
    share = spark.createDataFrame([(i, "share", "", s) for i, s in enumerate(shares)], "pc int, kind string, name string, value double")
    return top.unionAll(share).unionAll(scores.select("pc", F.lit("score"), F.col("sample_id").cast("string"), F.abs("score")))


@query("mat_pca_alignment")
def _(spark, sf):
    return learn.pca_alignment(_data(spark, sf)[0], 8)


@query("mat_latent_axis_score")
def _(spark, sf):
    return ranking.ranked(learn.latent_axis_scores(*_data(spark, sf), 8), [], "score")


@query("topk_top_loadings")
def _(spark, sf):
    return learn.top_loadings(*_data(spark, sf), 3, 5)


@query("mat_kmeans_ari")
def _(spark, sf):
    return learn.clusters(_data(spark, sf)[0], 10, 8)


@query("stat_huber")
def _(spark, sf):
    a, b = learn.huber_line(fx.scatter(spark, sf), "di", "delta")
    return spark.createDataFrame([(a, b)], "intercept double, slope double")


@query("gen_synthetic")
def _(spark, sf):
    return simulate.matrix(spark, simulate.SCENARIOS["coupled"], 1)


@query("gen_sim_di")
def _(spark, sf):
    out = None
    for s in simulate.SCENARIOS.values():
        m = simulate.matrix(spark, s, 1)
        out = m if out is None else out.unionByName(m)
    return simulate.di_curve(out, [1, 5, 10, 20])


@query("gen_sweep")
def _(spark, sf):
    return simulate.sweep(spark, [0.0, 1.0], 2)


@query(
    "stream_running_moments",
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS n, avg(value) AS mean, var_pop(value) AS variance FROM events GROUP BY ALL",
    "mean variance",
    "n",
)
def _(spark, sf):
    m = running.windowed(fx.table(spark, sf, "events"))
    return m.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
