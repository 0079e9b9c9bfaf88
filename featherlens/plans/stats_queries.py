"""Queries of correlations, tests, regressions, resampling and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, moments, overlap, ranking, resample, rules, stats
from . import fixtures as fx
from .fixtures import EMB, FEATURES_SQL, K_PCTS, REPEATS_SQL, RESULTS, SAMPLES, SCATTER, UNIT, VIEW
from .registry import query

# ---- correlation


_AVG = "rank() OVER (PARTITION BY view ORDER BY {0}) + (count(*) OVER (PARTITION BY view, {0}) - 1) / 2.0"

for _name, _a, _b in (("stat_spearman", "v_total", "eta_sq"), ("stat_alpha_prime", "v_total", "eta_sq"), ("pred_finite_mask", "fis", "v_within")):

    @query(_name, f"WITH {FEATURES_SQL}, r AS (SELECT view, {_AVG.format(_a)} AS a, {_AVG.format(_b)} AS b FROM ft) SELECT view, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY view", "rho", "n")
    def _(spark, sf, a=_a, b=_b):
        return stats.spearman(fx.features(spark, sf), VIEW, a, b)


@query("stat_spearman_line", "WITH r AS (SELECT l_returnflag AS view, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT view, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY view", "rho", "n")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("view"), "l_quantity", "l_discount")
    return stats.spearman(li, VIEW, "l_quantity", "l_discount")


@query("stat_spearman_ranks", f"WITH {FEATURES_SQL} SELECT view, count(*) AS n, corr(v_rank, fis_rank) AS rho FROM vp GROUP BY view", "rho", "n")
def _(spark, sf):
    return stats.spearman(fx.features(spark, sf), VIEW, "v_total", "fis", "ordinal")


@query("stat_pearson", f"WITH {SCATTER} SELECT dataset, corr(di, delta) AS r, avg(CAST((di > 0.9) = (delta > 0) AS INT)) AS agreement FROM sc GROUP BY dataset", "r agreement")
def _(spark, sf):
    agree = ((F.col("di") > 0.9) == (F.col("delta") > 0)).cast("double")
    return fx.scatter(spark, sf).groupBy("dataset").agg(stats.pearson(F.col("di"), F.col("delta")).alias("r"), F.avg(agree).alias("agreement"))


@query("stat_corr_matrix", f"WITH {FEATURES_SQL}, l AS (SELECT feature, m, v FROM (SELECT feature, v_total, v_between, v_within, eta_sq FROM ft) UNPIVOT (v FOR m IN (v_total, v_between, v_within, eta_sq))), r AS (SELECT feature, m, rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2.0 AS k FROM l) SELECT a.m AS a, b.m AS b, corr(a.k, b.k) AS rho FROM r a JOIN r b USING (feature) WHERE a.m < b.m GROUP BY ALL", "rho")
def _(spark, sf):
    cols = ["v_total", "v_between", "v_within", "eta_sq"]
    long = fx.features(spark, sf).unpivot(["feature"], cols, "m", "v")
    r = ranking.ranked(long, ["m"], "v", "average", "k", descending=False).select("feature", "m", "k")
    a, b = r.select("feature", F.col("m").alias("a"), F.col("k").alias("ka")), r.select("feature", F.col("m").alias("b"), F.col("k").alias("kb"))
    return a.join(b, "feature").filter("a < b").groupBy("a", "b").agg(stats.pearson(F.col("ka"), F.col("kb")).alias("rho"))


@query("join_merge_rate", f"WITH {FEATURES_SQL}, p AS (SELECT * FROM vp WHERE feature >= 'f004') SELECT count(p.feature) AS n_merged, count(*) AS n_left, count(p.feature) / CAST(count(*) AS DOUBLE) AS rate, corr(v.v_rank, p.eta_rank) AS rho FROM vp v LEFT JOIN p USING (view, feature)", "rate rho", "n_merged n_left")
def _(spark, sf):
    v = fx.vp(spark, sf)
    p = v.filter("feature >= 'f004'").select("view", "feature", F.col("eta_rank").alias("pr"))
    j = v.join(p, ["view", "feature"], "left")
    return j.agg(F.count("pr").alias("n_merged"), F.count("*").alias("n_left"), (F.count("pr") / F.count("*")).alias("rate"), stats.pearson(F.col("v_rank"), F.col("pr")).alias("rho"))


# ---- rank tests


@query("stat_vsa", f"WITH {FEATURES_SQL}, r AS (SELECT view, v_rank <= 6 AS top, {_AVG.format('eta_sq')} AS k FROM vp) SELECT view, (sum(k) FILTER (top) - 6 * 7 / 2.0) / (6.0 * 58) - 0.5 AS vsa FROM r GROUP BY view", "vsa")
def _(spark, sf):
    return stats.vsa(fx.features(spark, sf), VIEW, 10)


@query("stat_mann_whitney", f"WITH {EMB}, r AS (SELECT feature, label = 0 AS f, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS k FROM emb), s AS (SELECT feature, CAST(count(*) FILTER (f) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT f) AS DOUBLE) AS n0, sum(k) FILTER (f) AS w FROM r GROUP BY feature) SELECT feature, w - n1 * (n1 + 1) / 2 AS u, (w - n1 * (n1 + 1) / 2) / (n1 * n0) AS auroc, (w - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12) AS z FROM s", "u auroc z")
def _(spark, sf):
    rows = fx.emb(spark, sf).select("feature", "x", (F.col("label") == 0).alias("f"))
    return stats.mann_whitney(rows, ["feature"], "x", "f")


@query("stat_cohens_d", f"""WITH {EMB}, s AS (SELECT view, feature, count(x) FILTER (label = 0) AS n_a, count(x) FILTER (label = 1) AS n_b, avg(x) FILTER (label = 0) AS mean_a, avg(x) FILTER (label = 1) AS mean_b,
  stddev_samp(x) FILTER (label = 0) AS sd_a, stddev_samp(x) FILTER (label = 1) AS sd_b, min(x) AS lo, max(x) AS hi FROM emb GROUP BY ALL)
  SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b) / (n_a + n_b - 2)) AS cohens_d FROM s""", "mean_a mean_b sd_a sd_b cohens_d lo hi", "n_a n_b")  # fmt: skip
def _(spark, sf):
    return stats.cohens_d(fx.emb(spark, sf), VIEW, 0, 1)


_PV = f"pv AS (SELECT feature AS id, CASE WHEN feature LIKE '%7' THEN NULL ELSE ({UNIT.format(chr(39) + 'p|' + chr(39) + ' || feature')}) * ({UNIT.format(chr(39) + 'p|' + chr(39) + ' || feature')}) END AS p FROM vp)"
_BH = "t AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM pv WHERE p IS NOT NULL), b AS (SELECT id, least(1.0, min(p * n / k) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM t)"


def p_values(spark, sf):
    u = resample.unit(F.lit("p"), F.col("feature"))
    return fx.vp(spark, sf).select("view", F.col("feature").alias("id"), F.when(F.col("feature").endswith("7"), None).otherwise(u * u).alias("p"))


for _name in ("stat_bh_fdr", "win_frames"):

    @query(_name, f"WITH {FEATURES_SQL}, {_PV}, {_BH} SELECT id, p, fdr FROM pv JOIN b USING (id)", "p fdr")
    def _(spark, sf):
        return stats.bh_fdr(p_values(spark, sf).dropna(), VIEW).select("id", "p", "fdr")


@query("stat_bh_fdr_nan", f"WITH {FEATURES_SQL}, {_PV}, {_BH} SELECT id, p, fdr FROM pv LEFT JOIN b USING (id)", "p fdr")
def _(spark, sf):
    return stats.bh_fdr(p_values(spark, sf), VIEW).select("id", "p", "fdr")


@query("topk_nsmallest_fdr", f"WITH {FEATURES_SQL}, {_PV}, {_BH} SELECT id, fdr FROM b ORDER BY fdr, id LIMIT 10", "fdr")
def _(spark, sf):
    return stats.bh_fdr(p_values(spark, sf).dropna(), VIEW).select("id", "fdr").orderBy("fdr", "id").limit(10)


# ---- enrichment of gene sets: parts are genes, brands are sets, the query is the dearest tenth

_SETS = """g AS (SELECT p_partkey AS gene, p_brand AS gene_set, p_retailprice AS score FROM part), nn AS (SELECT count(*) AS population, CAST(floor(count(*) / 10.0) AS BIGINT) AS drawn FROM g),
qg AS (SELECT gene FROM g QUALIFY row_number() OVER (ORDER BY score DESC, gene) <= (SELECT drawn FROM nn)),
ct AS (SELECT gene_set AS id, population, count(*) AS marked, drawn, count(*) FILTER (gene IN (SELECT gene FROM qg)) AS hits FROM g, nn GROUP BY ALL HAVING count(*) BETWEEN 10 AND 500)"""
_TAIL = """lf AS (SELECT i, sum(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS lf FROM range(0, (SELECT population + 1 FROM nn)) t(i)), xs AS (SELECT id, population AS n, marked AS k, drawn AS d, hits, unnest(range(hits, least(marked, drawn) + 1)) AS x FROM ct),
pr AS (SELECT id, least(1.0, sum(exp(a.lf - b.lf - c.lf + e.lf - f.lf - g.lf - h.lf + i2.lf + j.lf))) AS p FROM xs JOIN lf a ON a.i = k JOIN lf b ON b.i = x JOIN lf c ON c.i = k - x JOIN lf e ON e.i = n - k JOIN lf f ON f.i = d - x JOIN lf g ON g.i = n - k - d + x JOIN lf h ON h.i = n JOIN lf i2 ON i2.i = d JOIN lf j ON j.i = n - d GROUP BY id)"""


def set_counts(spark, sf):
    g = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("id"), F.col("p_retailprice").alias("score"))
    n = g.agg(F.count("*").alias("population"), F.floor(F.count("*") / 10).cast("long").alias("drawn"))
    marked = ranking.ranked(g, [], "score", name="gene").join(F.broadcast(n))
    c = marked.groupBy("id").agg(F.first("population").alias("population"), F.count("*").alias("marked"), F.first("drawn").alias("drawn"), F.count_if(F.col("rank") <= F.col("drawn")).alias("hits"))
    return c.filter("marked between 10 and 500")


@query("stat_hypergeom_sf", f"WITH {_SETS}, {_TAIL} SELECT ct.id, hits, marked, drawn, population, p FROM ct JOIN pr USING (id)", "p", "hits marked drawn population")
def _(spark, sf):
    return stats.hypergeometric_tail(set_counts(spark, sf), ["id"])


@query("stat_enrichment", f"WITH {_SETS}, {_TAIL}, pv AS (SELECT pr.id, p FROM pr JOIN ct USING (id) WHERE hits > 0), {_BH} SELECT id, p, fdr FROM pv JOIN b USING (id)", "p fdr")
def _(spark, sf):
    p = stats.hypergeometric_tail(set_counts(spark, sf).filter("hits > 0"), ["id"])
    return stats.bh_fdr(p, []).select("id", "p", "fdr")


# ---- regression


@query("stat_ols_1d", f"WITH {SCATTER} SELECT count(*) AS n, regr_intercept(delta, di) AS intercept, regr_slope(delta, di) AS slope, regr_r2(delta, di) AS r2, sqrt(var_pop(delta) - regr_slope(delta, di) * covar_pop(delta, di)) AS rmse FROM sc", "intercept slope r2 rmse", "n")
def _(spark, sf):
    return fx.scatter(spark, sf).agg(*stats.ols(F.col("di"), F.col("delta")))


_TWO = """m AS (SELECT var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, var_pop(y) AS syy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM z),
c AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ca, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cb FROM m) SELECT my - ca * ma - cb * mb AS intercept, ca AS coef_a, cb AS coef_b, (ca * say + cb * sby) / syy AS r2 FROM c"""


@query("stat_ols_2d", f"WITH {FEATURES_SQL}, z AS (SELECT v_total AS a, v_within AS b, fis AS y FROM ft), {_TWO}", "intercept coef_a coef_b r2")
def _(spark, sf):
    return fx.features(spark, sf).agg(*stats.ols_2d(F.col("v_total"), F.col("v_within"), F.col("fis")))


@query("stat_confounder", f"WITH {SCATTER}, z AS (SELECT di AS a, ln(length(view)) AS b, delta AS y FROM sc), {_TWO.replace('SELECT my', 'SELECT (SELECT regr_r2(y, a) FROM z) AS r2_di, my')}", "r2_di intercept coef_a coef_b r2")
def _(spark, sf):
    s = fx.scatter(spark, sf)
    size = F.ln(F.length("view").cast("double"))
    return s.agg(stats.ols(F.col("di"), F.col("delta"))[3].alias("r2_di"), *stats.ols_2d(F.col("di"), size, F.col("delta")))


@query("stat_loo_r2", f"""WITH {SCATTER}, s AS (SELECT *, count(*) OVER () - 1 AS n, sum(di) OVER () - di AS sx, sum(delta) OVER () - delta AS sy, sum(di * di) OVER () - di * di AS sxx, sum(di * delta) OVER () - di * delta AS sxy FROM sc),
  p AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM s), q AS (SELECT delta, (sy - b * sx) / n + b * di AS pred FROM p)
  SELECT 1 - sum((delta - pred) ** 2) / sum((delta - (SELECT avg(delta) FROM q)) ** 2) AS r2_loo, avg(abs(delta - pred)) AS mae FROM q""", "r2_loo mae")  # fmt: skip
def _(spark, sf):
    s = stats.loo_ols(fx.scatter(spark, sf).withColumn("g", F.lit(0)), ["g"], "di", "delta")
    n = Window.partitionBy("g")
    one = F.lit(1.0)
    cnt, sx = F.sum(one).over(n) - 1, F.sum("di").over(n) - F.col("di")
    sxx, sy, sxy = F.sum(F.col("di") ** 2).over(n) - F.col("di") ** 2, F.sum("delta").over(n) - F.col("delta"), F.sum(F.col("di") * F.col("delta")).over(n) - F.col("di") * F.col("delta")
    slope = (cnt * sxy - sx * sy) / (cnt * sxx - sx * sx)
    e = s.withColumn("fit", F.col("pred") + slope * F.col("di")).withColumn("m", F.avg("delta").over(n))
    miss = F.col("delta") - F.col("fit")
    return e.agg((1 - F.sum(miss**2) / F.sum((F.col("delta") - F.col("m")) ** 2)).alias("r2_loo"), F.avg(F.abs(miss)).alias("mae"))


@query("stat_kde", f"WITH {FEATURES_SQL}, l AS (SELECT min(v_total) AS lo, max(v_total) AS hi, count(*) AS n FROM ft), g AS (SELECT i, lo + (hi - lo) * i / 20 AS x_at, 0.15 * (hi - lo) / CAST(n AS DOUBLE) ** 0.2 AS h FROM l, range(0, 21) t(i)) SELECT i, x_at, avg(exp(0 - ((x_at - v_total) / h) ** 2 / 2) / (h * 2.5066282746310002)) AS density FROM ft, g GROUP BY i, x_at", "x_at density", "i")
def _(spark, sf):
    return stats.kde(fx.features(spark, sf), VIEW, "v_total", 21).drop("view")


# ---- draws, bootstraps and permutations


@query("sample_cap_neutral", f"WITH {FEATURES_SQL} SELECT view, feature FROM vp QUALIFY row_number() OVER (PARTITION BY view ORDER BY md5('1|' || feature), feature) <= 20")
def _(spark, sf):
    return resample.capped(fx.vp(spark, sf).select("view", "feature"), VIEW, "feature", 20, 1)


@query("sample_rows", f"WITH {SAMPLES} SELECT sample_id FROM samples QUALIFY row_number() OVER (ORDER BY md5('5|' || sample_id), sample_id) <= 100")
def _(spark, sf):
    return resample.capped(fx.samples(spark, sf), [], "sample_id", 100, 5).select("sample_id")


@query("sample_random_topk", f"WITH {FEATURES_SQL}, d AS (SELECT view, feature, eta_sq, draw FROM vp, range(0, 20) t(draw) QUALIFY row_number() OVER (PARTITION BY view, draw ORDER BY md5('2|' || draw || '|' || feature), feature) <= 6) SELECT draw, avg(eta_sq) AS score FROM d GROUP BY draw", "score", "draw")
def _(spark, sf):
    sets = resample.random_sets(fx.vp(spark, sf).select("view", "feature", "eta_sq"), VIEW, "feature", 6, 20, 2)
    return sets.groupBy("draw").agg(F.avg("eta_sq").alias("score"))


@query("sample_topvar_plus_rest", f"WITH {FEATURES_SQL}, r AS (SELECT view, feature, v_rank, row_number() OVER (PARTITION BY view, v_rank <= 6 ORDER BY md5('3|' || feature), feature) AS k FROM vp) SELECT view, feature, v_rank <= 6 AS is_top FROM r WHERE v_rank <= 6 OR k <= 14")
def _(spark, sf):
    v = fx.vp(spark, sf).withColumn("is_top", F.col("v_rank") <= 6)
    rest = resample.capped(v.filter("not is_top"), VIEW, "feature", 14, 3)
    return v.filter("is_top").select("view", "feature", "is_top").unionByName(rest.select("view", "feature", "is_top"))


_BOOT = f"""nb AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS i, count(*) OVER (PARTITION BY label) AS m FROM samples),
bt AS (SELECT draw, label, CAST(floor(({UNIT.format("concat_ws('|', '4', draw, i, label)")}) * m) + 1 AS INT) AS i FROM nb, range(0, 10) t(draw))"""


@query("sample_bootstrap_stratified", f"WITH {SAMPLES}, {_BOOT} SELECT draw, label, count(*) AS n, count(DISTINCT nb.sample_id) AS n_distinct, sum(nb.sample_id) AS id_sum FROM bt JOIN nb USING (label, i) GROUP BY draw, label", "", "draw label n n_distinct id_sum")
def _(spark, sf):
    b = resample.bootstrap(fx.samples(spark, sf), ["label"], 10, 4)
    return b.groupBy("draw", "label").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_distinct"), F.sum("sample_id").alias("id_sum"))


_BOOT1 = f"nb AS (SELECT *, row_number() OVER (ORDER BY view) AS i, count(*) OVER () AS m FROM sc), bt AS (SELECT draw, CAST(floor(({UNIT.format("concat_ws('|', '6', draw, i)")}) * m) + 1 AS INT) AS i FROM nb, range(0, 200) t(draw)), bs AS (SELECT draw, nb.* FROM bt JOIN nb USING (i))"


@query("sample_bootstrap_mean_ci", f"WITH {SCATTER}, {_BOOT1}, m AS (SELECT draw, avg(delta) AS d FROM bs GROUP BY draw) SELECT avg(d) AS mean, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM m", "mean lo hi")
def _(spark, sf):
    m = resample.bootstrap(fx.scatter(spark, sf), [], 200, 6, "view").groupBy("draw").agg(F.avg("delta").alias("d"))
    return m.agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"))


@query("sample_bootstrap_fit", f"WITH {SCATTER}, {_BOOT1} SELECT draw, regr_intercept(delta, di) AS intercept, regr_slope(delta, di) AS slope FROM bs GROUP BY draw", "intercept slope", "draw")
def _(spark, sf):
    b = resample.bootstrap(fx.scatter(spark, sf), [], 200, 6, "view")
    return b.groupBy("draw").agg(*stats.ols(F.col("di"), F.col("delta"))[1:3])


@query("stat_bootstrap_quantile_band", f"WITH {SCATTER}, {_BOOT1}, f AS (SELECT draw, regr_intercept(delta, di) AS a, regr_slope(delta, di) AS b FROM bs GROUP BY draw), g AS (SELECT i, 0.6 + 0.06 * i AS x FROM range(0, 11) t(i)) SELECT i, quantile_cont(a + b * x, 0.05) AS lo, quantile_cont(a + b * x, 0.5) AS mid, quantile_cont(a + b * x, 0.95) AS hi FROM f, g GROUP BY i", "lo mid hi", "i")
def _(spark, sf):
    fit = resample.bootstrap(fx.scatter(spark, sf), [], 200, 6, "view").groupBy("draw").agg(*stats.ols(F.col("di"), F.col("delta"))[1:3])
    grid = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10))))
    y = F.col("intercept") + F.col("slope") * (0.6 + 0.06 * F.col("i"))
    return grid.groupBy("i").agg(F.percentile(y, 0.05).alias("lo"), F.percentile(y, 0.5).alias("mid"), F.percentile(y, 0.95).alias("hi"))


@query("sample_permute_labels", f"WITH {SAMPLES}, s AS (SELECT sample_id, group_id, label, perm, row_number() OVER (PARTITION BY perm, group_id ORDER BY sample_id) AS a, row_number() OVER (PARTITION BY perm, group_id ORDER BY md5('7|' || perm || '|' || sample_id), sample_id) AS b FROM samples, range(0, 3) t(perm)) SELECT x.sample_id, x.perm, x.group_id, y.label FROM s x JOIN s y ON x.perm = y.perm AND x.group_id = y.group_id AND x.a = y.b", "", "perm label")
def _(spark, sf):
    return resample.permuted(fx.samples(spark, sf), ["group_id"], "label", 3, 7).select("sample_id", "perm", "group_id", "label")


_PERM = "s AS (SELECT sample_id, label, perm, row_number() OVER (PARTITION BY perm ORDER BY sample_id) AS a, row_number() OVER (PARTITION BY perm ORDER BY md5('8|' || perm || '|' || sample_id), sample_id) AS b FROM samples, range(0, 10) t(perm)), pl AS (SELECT x.sample_id, x.perm, y.label FROM s x JOIN s y ON x.perm = y.perm AND x.a = y.b)"


@query("sample_permute_global_u64", f"WITH {SAMPLES}, {_PERM} SELECT sample_id, perm, label FROM pl", "", "perm label")
def _(spark, sf):
    return resample.permuted(fx.samples(spark, sf), [], "label", 10, 8).select("sample_id", "perm", "label")


@query("agg_permnull_summary", f"""WITH {FEATURES_SQL}, {SAMPLES}, {_PERM}, pe AS (SELECT perm, sample_id, feature, x, pl.label FROM emb JOIN pl USING (sample_id)), pc AS (SELECT perm, feature, label, count(*) AS n, avg(x) AS mu FROM pe GROUP BY ALL), pt AS (SELECT feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS vp FROM emb GROUP BY ALL),
  pf AS (SELECT perm, feature, greatest(0.0, least(1.0, sum(pc.n / CAST(pt.n AS DOUBLE) * (mu - mean) ** 2) / (any_value(vp) + 1e-12))) AS eta FROM pc JOIN pt USING (feature) GROUP BY ALL), nul AS (SELECT perm, avg(eta) AS m FROM pf GROUP BY perm), obs AS (SELECT avg(eta_sq) AS o FROM ft)
  SELECT any_value(o) AS observed, avg(m) AS null_mean, stddev_pop(m) AS null_sd, (any_value(o) - avg(m)) / stddev_pop(m) AS z, (1 + count(*) FILTER (m >= o)) / (count(*) + 1.0) AS p FROM nul, obs""", "observed null_mean null_sd z p")  # fmt: skip
def _(spark, sf):
    e = fx.emb(spark, sf)
    pl = resample.permuted(fx.samples(spark, sf), [], "label", 10, 8)
    # permutations are one more key of the same aggregate
    null = moments.eta2(e.drop("label").join(pl, "sample_id"), ["perm"]).groupBy("perm").agg(F.avg("eta_sq").alias("m"))
    obs = moments.eta2(e, []).agg(F.avg("eta_sq").alias("o"))
    j = null.join(F.broadcast(obs))
    o, m = F.first("o"), F.col("m")
    return j.agg(o.alias("observed"), F.avg(m).alias("null_mean"), F.stddev_pop(m).alias("null_sd"), ((o - F.avg(m)) / F.stddev_pop(m)).alias("z"), ((1 + F.count_if(m >= F.col("o"))) / (F.count("*") + 1.0)).alias("p"))


_DRAWS = "d AS (SELECT draw, feature, side, row_number() OVER (PARTITION BY draw, side ORDER BY md5(concat_ws('|', seed, draw, feature)), feature) AS k FROM vp, range(0, 100) t(draw), (VALUES ('a', '11'), ('b', '12')) s(side, seed)), jd AS (SELECT draw, count(DISTINCT CASE WHEN n = 2 THEN feature END) / CAST(count(*) AS DOUBLE) AS j FROM (SELECT draw, feature, count(*) AS n FROM d WHERE k <= 6 GROUP BY ALL) GROUP BY draw)"


def null_jaccards(spark, sf):
    f = fx.vp(spark, sf).select("view", "feature")
    both = resample.random_sets(f, VIEW, "feature", 6, 100, 11).unionByName(resample.random_sets(f, VIEW, "feature", 6, 100, 12))
    n = both.groupBy("draw", "feature").agg(F.count("*").alias("n"))
    return n.groupBy("draw").agg((F.count_if(F.col("n") == 2) / F.count("*")).alias("j"))


@query("stat_perm_null_jaccard", f"WITH {FEATURES_SQL}, {_DRAWS} SELECT draw, j FROM jd", "j", "draw")
def _(spark, sf):
    return null_jaccards(spark, sf)


@query("stat_null_di_sim", f"WITH {FEATURES_SQL}, {_DRAWS} SELECT avg((1 - j) / (1 - (6 / 64.0) / (2 - 6 / 64.0))) AS di_mean, quantile_cont((1 - j) / (1 - (6 / 64.0) / (2 - 6 / 64.0)), 0.05) AS lo FROM jd", "di_mean lo")
def _(spark, sf):
    d = null_jaccards(spark, sf).withColumn("di", overlap.di_stable(F.col("j"), F.lit(6 / 64.0)))
    return d.agg(F.avg("di").alias("di_mean"), F.percentile("di", 0.05).alias("lo"))


@query("stat_convergence_null", f"WITH {FEATURES_SQL}, {_DRAWS}, o AS (SELECT count(*) FILTER (v_rank <= 6 AND eta_rank <= 6) / CAST(count(*) FILTER (v_rank <= 6 OR eta_rank <= 6) AS DOUBLE) AS obs FROM vp) SELECT any_value(obs) AS observed, avg(j) AS null_mean, quantile_cont(j, 0.5) AS null_median, quantile_cont(j, 0.95) AS null_q95, (1 + count(*) FILTER (j <= obs)) / (count(*) + 1.0) AS p_lower FROM jd, o", "observed null_mean null_median null_q95 p_lower")
def _(spark, sf):
    o = fx.vp(spark, sf).agg(overlap.jaccard(F.col("v_rank") <= 6, F.col("eta_rank") <= 6).alias("obs"))
    d = null_jaccards(spark, sf).join(F.broadcast(o))
    return d.agg(F.first("obs").alias("observed"), F.avg("j").alias("null_mean"), F.percentile("j", 0.5).alias("null_median"), F.percentile("j", 0.95).alias("null_q95"), ((1 + F.count_if(F.col("j") <= F.col("obs"))) / (F.count("*") + 1.0)).alias("p_lower"))


# ---- folds and metrics

_FOLDS = "fo AS (SELECT sample_id, label, group_id, repeat, (row_number() OVER (PARTITION BY repeat, label ORDER BY md5('9|' || repeat || '|' || sample_id), sample_id) - 1) % 5 AS fold FROM samples, range(0, 3) t(repeat))"


def fold_table(spark, sf):
    return folds.stratified(fx.samples(spark, sf), 5, 3, 9)


for _name in ("ml_stratified_kfold", "ml_repeated_folds"):

    @query(_name, f"WITH {SAMPLES}, {_FOLDS} SELECT sample_id, repeat, fold FROM fo", "", "repeat fold")
    def _(spark, sf):
        return fold_table(spark, sf).select("sample_id", "repeat", "fold")


@query("ml_effective_splits", f"WITH {SAMPLES} SELECT greatest(2, least(60, min(n))) AS n_splits FROM (SELECT count(*) AS n FROM samples GROUP BY label)", "", "n_splits")
def _(spark, sf):
    return folds.effective_splits(fx.samples(spark, sf), 60)


@query("pred_valid_fold", f"WITH {SAMPLES}, {_FOLDS}, b AS (SELECT repeat, CASE WHEN label = 3 THEN 0 ELSE fold END AS fold, label FROM fo) SELECT repeat, fold, label FROM (SELECT *, sum(m) OVER (PARTITION BY repeat, label) AS n FROM (SELECT repeat, fold, label, count(*) AS m FROM b GROUP BY ALL)) WHERE m = n", "", "repeat fold label")
def _(spark, sf):
    return folds.invalid_folds(fold_table(spark, sf).withColumn("fold", F.when(F.col("label") == 3, 0).otherwise(F.col("fold"))))


@query("ml_balanced_weights", f"WITH {SAMPLES}, c AS (SELECT label, count(*) AS n_class FROM samples GROUP BY label) SELECT label, n_class, sum(n_class) OVER () / CAST(count(*) OVER () * n_class AS DOUBLE) AS weight FROM c", "weight", "label n_class")
def _(spark, sf):
    return folds.class_weights(fx.samples(spark, sf))


@query("ml_group_recovery", "SELECT l.doc_id, coalesce(d.source, CAST(l.doc_id AS VARCHAR)) AS group_id FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 > 0) d USING (doc_id)")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").filter("doc_id % 3 > 0").select("doc_id", "source")
    return fx.table(spark, sf, "labels").join(d, "doc_id", "left").select("doc_id", F.coalesce("source", F.col("doc_id").cast("string")).alias("group_id"))


_PRED = "pd AS (SELECT group_id, label AS y, CASE WHEN sample_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM samples)"
_METRICS = """c AS (SELECT group_id, y AS c, count(*) AS act, 0 AS prd, count(*) FILTER (y = p) AS hit FROM pd GROUP BY ALL UNION ALL SELECT group_id, p, 0, count(*), 0 FROM pd GROUP BY ALL),
e AS (SELECT group_id, c, sum(act) AS act, sum(prd) AS prd, sum(hit) AS hit FROM c GROUP BY ALL) SELECT group_id, sum(hit) / CAST(sum(act) AS DOUBLE) AS accuracy, avg(hit / act) FILTER (act > 0) AS balanced_accuracy, avg(2.0 * hit / (act + prd)) AS macro_f1 FROM e GROUP BY group_id"""


def predictions(spark, sf):
    return fx.samples(spark, sf).select("group_id", F.col("label").alias("y"), F.when(F.col("sample_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("p"))


@query("ml_metrics", f"WITH {SAMPLES}, {_PRED}, {_METRICS}", "accuracy balanced_accuracy macro_f1")
def _(spark, sf):
    return folds.confusion_metrics(predictions(spark, sf), ["group_id"])


@query("ml_balanced_accuracy", f"WITH {SAMPLES}, {_PRED} SELECT group_id, avg(r) AS balanced_accuracy FROM (SELECT group_id, y, avg(CAST(y = p AS INT)) AS r FROM pd GROUP BY ALL) GROUP BY group_id", "balanced_accuracy")
def _(spark, sf):
    return folds.confusion_metrics(predictions(spark, sf), ["group_id"]).select("group_id", "balanced_accuracy")


@query("ml_auroc_guard", f"WITH {EMB}, r AS (SELECT feature, group_id, label = 0 AS f, rank() OVER (PARTITION BY feature, group_id ORDER BY x) + (count(*) OVER (PARTITION BY feature, group_id, x) - 1) / 2.0 AS k FROM (SELECT * REPLACE (sample_id // 5 AS group_id) FROM emb)), s AS (SELECT feature, group_id, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0, sum(k) FILTER (f) AS w FROM r GROUP BY ALL) SELECT feature, group_id, CASE WHEN n1 = 0 OR n0 = 0 THEN NULL ELSE (w - n1 * (n1 + 1) / 2.0) / (n1 * n0) END AS auroc_or_null, coalesce(auroc_or_null, 0.5) AS auroc FROM s", "auroc auroc_or_null")
def _(spark, sf):
    # groups of five samples: many hold one class only, which has no AUROC
    rows = fx.emb(spark, sf).select("feature", F.floor(F.col("sample_id") / 5).alias("group_id"), "x", (F.col("label") == 0).alias("f"))
    u = stats.mann_whitney(rows, ["feature", "group_id"], "x", "f")
    return u.select("feature", "group_id", F.coalesce("auroc", F.lit(0.5)).alias("auroc"), F.col("auroc").alias("auroc_or_null"))


@query("mat_ari_nmi", f"""WITH {SAMPLES}, pr AS (SELECT label AS a, (label + CASE WHEN sample_id % 4 = 0 THEN 1 ELSE 0 END) % 10 AS b FROM samples), c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM pr GROUP BY ALL),
  w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c), s AS (SELECT sum(n * (n - 1) / 2) AS sij, sum(n / na * na * (na - 1) / 2) AS sa, sum(n / nb * nb * (nb - 1) / 2) AS sb, any_value(t) AS t, sum(n / t * ln(n * t / (na * nb))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM w)
  SELECT (sij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) AS ari, mi / ((ha + hb) / 2) AS nmi FROM s""", "ari nmi")  # fmt: skip
def _(spark, sf):
    other = (F.col("label") + F.when(F.col("sample_id") % 4 == 0, 1).otherwise(0)) % 10
    return folds.ari_nmi(fx.samples(spark, sf), F.col("label"), other)


# ---- the model-free diagnostic over all training folds at once

_TRAIN = f"""{SAMPLES}, {_FOLDS}, tr AS (SELECT emb.view, f.repeat, h.fold, emb.sample_id, emb.feature, emb.x, emb.label FROM emb JOIN fo f USING (sample_id), range(0, 5) h(fold) WHERE f.fold <> h.fold),
tc AS (SELECT view, repeat, fold, feature, label, count(*) AS n, avg(x) AS mu FROM tr GROUP BY ALL), tt AS (SELECT view, repeat, fold, feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS v_total FROM tr GROUP BY ALL),
tf AS (SELECT view, repeat, fold, feature, any_value(v_total) AS v_total, greatest(0.0, least(1.0, sum(tc.n / CAST(tt.n AS DOUBLE) * (mu - mean) ** 2) / (any_value(v_total) + 1e-12))) AS eta_sq FROM tc JOIN tt USING (view, repeat, fold, feature) GROUP BY ALL),
tk AS (SELECT *, row_number() OVER (PARTITION BY view, repeat, fold ORDER BY v_total DESC, feature) AS vr, row_number() OVER (PARTITION BY view, repeat, fold ORDER BY eta_sq DESC, feature) AS er, rank() OVER (PARTITION BY view, repeat, fold ORDER BY eta_sq) + (count(*) OVER (PARTITION BY view, repeat, fold, eta_sq) - 1) / 2.0 AS ek, rank() OVER (PARTITION BY view, repeat, fold ORDER BY v_total) + (count(*) OVER (PARTITION BY view, repeat, fold, v_total) - 1) / 2.0 AS vk FROM tf),
vd AS (SELECT view, repeat, fold, avg(eta_sq) FILTER (vr <= 6) / (avg(eta_sq) + 1e-12) AS eta_es, (sum(ek) FILTER (vr <= 6) - 21.0) / (6.0 * 58) - 0.5 AS vsa, corr(vk, ek) AS alpha_prime,
  (1 - count(*) FILTER (vr <= 6 AND er <= 6) / CAST(count(*) FILTER (vr <= 6 OR er <= 6) AS DOUBLE)) / (1 - (6 / 64.0) / (2 - 6 / 64.0)) AS f_di FROM tk GROUP BY ALL)"""
_V = "eta_es vsa alpha_prime f_di"


def vad_features(spark, sf):
    """Moments of all training splits, which are keys of one plan, and the same with ranks."""
    keys = ["view", "repeat", "fold"]
    f = fold_table(spark, sf).select("sample_id", "repeat", F.col("fold").alias("own"))
    train = fx.emb(spark, sf).join(f, "sample_id").withColumn("fold", F.explode(F.array(*map(F.lit, range(5))))).filter("own <> fold")
    ft = moments.eta2(train, keys)
    return ft, ranking.ranked(ranking.ranked(ft, keys, "v_total", out="v_rank"), keys, "eta_sq", out="eta_rank")


def vad_long(spark, sf):
    """One row a (view, repeat, fold)."""
    keys = ["view", "repeat", "fold"]
    ft, ranks = vad_features(spark, sf)
    out = stats.eta_enrichment(ft, keys, 10).select(*keys, "eta_es").join(stats.vsa(ft, keys, 10), keys)
    out = out.join(stats.spearman(ft, keys, "v_total", "eta_sq").select(*keys, F.col("rho").alias("alpha_prime")), keys)
    return out.join(overlap.f_di(ranks, keys, "v_rank", "eta_rank", 10), keys)


@query("agg_vad_fold_metrics", f"WITH {EMB}, {_TRAIN} SELECT * FROM vd", _V, "repeat fold")
def _(spark, sf):
    return vad_long(spark, sf)


def _at_k(k_pct: int, k: int) -> str:
    return f"""SELECT view, repeat, fold, {k_pct} AS k_pct, avg(eta_sq) FILTER (vr <= {k}) / (avg(eta_sq) + 1e-12) AS eta_es, (sum(ek) FILTER (vr <= {k}) - {k * (k + 1) / 2}) / ({k}.0 * {64 - k}) - 0.5 AS vsa, corr(vk, ek) AS alpha_prime,
  (1 - count(*) FILTER (vr <= {k} AND er <= {k}) / CAST(count(*) FILTER (vr <= {k} OR er <= {k}) AS DOUBLE)) / (1 - ({k} / 64.0) / (2 - {k} / 64.0)) AS f_di FROM tk GROUP BY ALL"""


_ES, _VS = ("CASE WHEN eta_es_hi < 1 AND vsa_hi < 0 THEN 'RED_HARMFUL' WHEN eta_es_lo > 1 AND vsa_lo > 0 THEN 'GREEN_SAFE' ELSE 'YELLOW_INCONCLUSIVE' END", "CASE WHEN eta_es < 1 AND vsa < 0 THEN 'RED_RISK' WHEN eta_es > 1 AND vsa > 0 THEN 'GREEN_SAFE' ELSE 'YELLOW_INCONCLUSIVE' END")
_MEANS = ", ".join(f"avg({c}) AS {c}, quantile_cont({c}, 0.025) AS {c}_lo, quantile_cont({c}, 0.975) AS {c}_hi" for c in _V.split())


@query(
    "agg_vad_bundle",
    f"WITH {EMB}, {_TRAIN}, vk AS ({' UNION ALL '.join(_at_k(p, k) for p, k in ((1, 1), (5, 3), (10, 6), (20, 12)))}), s AS (SELECT view, k_pct, count(*) AS n_splits, {_MEANS} FROM vk GROUP BY ALL) SELECT *, {_VS} AS zone_nominal, {_ES} AS zone_conservative FROM s",
    " ".join(f"{c}{e}" for c in _V.split() for e in ("", "_lo", "_hi")),
    "k_pct n_splits",
)
def _(spark, sf):
    """Every K of the grid over all training splits, its means and limits, and both zones."""
    keys = ["view", "repeat", "fold"]
    ft, ranks = vad_features(spark, sf)
    every = None
    for k_pct in K_PCTS:
        at = stats.eta_enrichment(ft, keys, k_pct).select(*keys, "eta_es").join(stats.vsa(ft, keys, k_pct), keys).join(overlap.f_di(ranks, keys, "v_rank", "eta_rank", k_pct), keys).withColumn("k_pct", F.lit(k_pct))
        every = at if every is None else every.unionByName(at)
    every = every.join(stats.spearman(ft, keys, "v_total", "eta_sq").select(*keys, F.col("rho").alias("alpha_prime")), keys)
    aggs = [F.count("*").alias("n_splits")]
    for c in _V.split():
        p = F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
        aggs += [F.avg(c).alias(c), p[0].alias(f"{c}_lo"), p[1].alias(f"{c}_hi")]
    out = every.groupBy("view", "k_pct").agg(*aggs)
    limits = [F.col(c) for c in ("eta_es_lo", "eta_es_hi", "vsa_lo", "vsa_hi")]
    state = rules.diagnostic_state(F.col("eta_es"), F.col("vsa"))
    return out.withColumns({"zone_nominal": rules.nominal_zone(state), "zone_conservative": rules.vad_zone(F.col("eta_es"), F.col("vsa"), *limits)})


@query("agg_vad_summary", f"WITH {EMB}, {_TRAIN} SELECT view, count(*) AS n, " + ", ".join(f"avg({c}) AS {c}_mean, quantile_cont({c}, 0.025) AS {c}_lo, quantile_cont({c}, 0.975) AS {c}_hi" for c in _V.split()) + " FROM vd GROUP BY view", " ".join(f"{c}_{s}" for c in _V.split() for s in ("mean", "lo", "hi")), "n")
def _(spark, sf):
    aggs = [F.count("*").alias("n")]
    for c in _V.split():
        p = F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
        aggs += [F.avg(c).alias(f"{c}_mean"), p[0].alias(f"{c}_lo"), p[1].alias(f"{c}_hi")]
    return vad_long(spark, sf).groupBy("view").agg(*aggs)


# ---- the results table


@query("agg_repeat_means", f"WITH {RESULTS} SELECT dataset, view, model, k_pct, repeat, strategy, avg(value) AS value FROM res GROUP BY ALL", "value", "k_pct repeat")
def _(spark, sf):
    return fx.results(spark, sf).groupBy("dataset", "view", "model", "k_pct", "repeat", "strategy").agg(F.avg("value").alias("value"))


@query("agg_summarize_metrics", f"WITH {RESULTS} SELECT view, model, strategy, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, string_agg(printf('%.4f', v), ',' ORDER BY repeat) AS per_repeat FROM (SELECT view, model, strategy, repeat, avg(value) AS v FROM res GROUP BY ALL) GROUP BY ALL", "mean sd lo hi")
def _(spark, sf):
    r = fx.results(spark, sf).groupBy("view", "model", "strategy", "repeat").agg(F.avg("value").alias("v"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("repeat", "v"))), lambda s: F.format_string("%.4f", s["v"])), ",")
    return r.groupBy("view", "model", "strategy").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"), listed.alias("per_repeat"))


@query("agg_agreement_summary", f"WITH {REPEATS_SQL}, s AS (SELECT repeat, count(*) FILTER (imp_rank <= 6 AND v_rank <= 6) / CAST(count(*) FILTER (imp_rank <= 6 OR v_rank <= 6) AS DOUBLE) AS j, count(*) AS n FROM rep GROUP BY repeat) SELECT quantile_cont(n, 0.5) AS n_features, avg(j) AS mean_jaccard, (36 / 64.0) / (12 - 36 / 64.0) AS null_jaccard FROM s", "n_features mean_jaccard null_jaccard")
def _(spark, sf):
    s = fx.repeats(spark, sf).groupBy("repeat").agg(overlap.jaccard(F.col("imp_rank") <= 6, F.col("v_rank") <= 6).alias("j"), F.count("*").alias("n"))
    return s.agg(F.percentile("n", 0.5).alias("n_features"), F.avg("j").alias("mean_jaccard"), overlap.expected_jaccard(F.lit(64.0), F.lit(6.0), F.lit(6.0)).alias("null_jaccard"))


assert K_PCTS == [1, 5, 10, 20]  # the SQL above spells them out
