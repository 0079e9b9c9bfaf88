"""Queries of column kinds, catalogues, claims, normalisation policies, subsets, and tables written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import moments, overlap, profile, ranking, resample, rules, stats, transform
from ..sources import readers, sinks
from . import fixtures as fx
from .fixtures import BRAND, EMB, FEATURES_SQL, LINE, REPEATS_SQL, RESULTS, SCATTER, VIEW
from .matrix_queries import _HOLES, _holes
from .registry import query
from .rule_queries import _BOOT_FIT, _DI_ZONE, boot_lines, deltas

# ---- columns and catalogues

_TEXTS = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("documents", "text"), ("documents", "lang"), ("documents", "source"), ("pages", "url")]
_TYPED = [("orders", "o_orderkey", "int"), ("orders", "o_custkey", "int"), ("orders", "o_totalprice", "float"), ("orders", "o_orderdate", "datetime"), ("documents", "doc_id", "int"), ("documents", "n_chars", "int"), ("pages", "page_id", "int")]
_KIND = "SELECT '{0}' AS tbl, '{1}' AS \"column\", CASE WHEN count({1}) = 0 THEN 'empty' WHEN avg(CAST(regexp_matches({1}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AS INT)) > 0.8 THEN 'datetime_like' WHEN count(DISTINCT {1}) <= least(50, greatest(10, floor(0.05 * count({1})))) THEN 'categorical' WHEN avg(length({1})) >= 30 THEN 'text' ELSE 'categorical_highcard' END AS kind FROM {0}"


@query("agg_kind_inference", " UNION ALL ".join([_KIND.format(t, c) for t, c in _TEXTS] + [f"SELECT '{t}', '{c}', '{k}'" for t, c, k in _TYPED]))
def _(spark, sf):
    keep = {t: [c for x, c, *_ in [*_TEXTS, *_TYPED] if x == t] for t in ("orders", "documents", "pages")}
    return reduce(DataFrame.unionByName, [profile.infer_kinds(fx.table(spark, sf, t).select(*cols)).withColumn("tbl", F.lit(t)) for t, cols in keep.items()])


@query("fn_categorical_top", "SELECT p_type AS level, count(*) AS n, (SELECT count(DISTINCT p_type) FROM part) AS n_levels FROM part WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY n DESC, level LIMIT 5", "", "n n_levels")
def _(spark, sf):
    return profile.level_summary(fx.table(spark, sf, "part"), "p_type", 5)


@query("scan_discover_vp_records", f"WITH {EMB}, {LINE}, {BRAND}, v AS (SELECT view, feature, sample_id FROM emb UNION ALL SELECT view, feature, sample_id FROM line UNION ALL SELECT view, feature, sample_id FROM brand) SELECT view, count(DISTINCT feature) AS n_features, count(DISTINCT sample_id) AS n_samples, count(*) AS n_values FROM v GROUP BY view", "", "n_features n_samples n_values")
def _(spark, sf):
    return profile.catalogue(_views(spark, sf), VIEW)


def _views(spark, sf):
    return reduce(DataFrame.unionByName, [f(spark, sf).select("view", "feature", "sample_id") for f in (fx.emb, fx.line, fx.brand)])


_AUDIT = [("p_partkey", "bigint", "CAST({}({}) AS VARCHAR)"), ("p_name", "string", "{}({})"), ("p_brand", "string", "{}({})"), ("p_size", "int", "CAST({}({}) AS VARCHAR)"), ("p_retailprice", "double", "printf('%.2f', {}({}))")]


@query("tbl_schema_audit", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS n_missing, {e.format('min', c)} AS lo, {e.format('max', c)} AS hi FROM part" for c, k, e in _AUDIT), "", "n_missing")
def _(spark, sf):
    p = fx.table(spark, sf, "part").select(*[c for c, *_ in _AUDIT])
    text = lambda c, k: F.format_string("%.2f", c) if k == "double" else c.cast("string")
    items = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("dtype"), F.count_if(F.col(c).isNull()).alias("n_missing"), text(F.min(c), k).alias("lo"), text(F.max(c), k).alias("hi")) for c, k in p.dtypes]
    return p.agg(F.array(*items).alias("z")).select(F.explode("z").alias("z")).select("z.*")


# ---- claims and consistency


@query("agg_count_views", f"WITH {SCATTER} SELECT count(*) AS n_views, count(*) FILTER (di > 1.05) AS n_anti, count(*) FILTER (di < 0.85) AS n_coupled, min(di) AS di_min, max(di) AS di_max FROM sc", "di_min di_max", "n_views n_anti n_coupled")
def _(spark, sf):
    return fx.scatter(spark, sf).agg(F.count("*").alias("n_views"), F.count_if(F.col("di") > 1.05).alias("n_anti"), F.count_if(F.col("di") < 0.85).alias("n_coupled"), F.min("di").alias("di_min"), F.max("di").alias("di_max"))


@query("tbl_validate_claims", f"WITH {SCATTER}, o AS (SELECT unnest(['n_views', 'worst', 'mean_di']) AS claim, unnest([CAST(count(*) AS DOUBLE), min(delta), avg(di)]) AS observed, unnest([25.0, -0.1, 0.5]) AS expected, unnest([0.0, 0.15, 0.1]) AS tol FROM sc) SELECT claim, observed, expected, abs(observed - expected) <= tol AS passed FROM o", "observed expected")
def _(spark, sf):
    row = fx.scatter(spark, sf).agg(F.count("*").alias("n_views"), F.min("delta").alias("worst"), F.avg("di").alias("mean_di"))
    return profile.claims(row, {"n_views": (25, 0), "worst": (-0.1, 0.15), "mean_di": (0.5, 0.1)})


@query("tbl_supp_values", f"WITH {SCATTER}, r AS (SELECT rank() OVER (ORDER BY di) + (count(*) OVER (PARTITION BY di) - 1) / 2.0 AS a, rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2.0 AS b FROM sc) SELECT {_DI_ZONE} AS zone, count(*) AS n, (SELECT corr(a, b) FROM r) AS rho FROM sc GROUP BY zone", "rho", "n")
def _(spark, sf):
    s = fx.scatter(spark, sf)
    rho = stats.spearman(s.withColumn("g", F.lit(0)), ["g"], "di", "delta", name="view").select("rho")  # one row
    return s.groupBy(rules.di_zone(F.col("di"), 0.9, 1.0).alias("zone")).agg(F.count("*").alias("n")).join(F.broadcast(rho))


_PARTS = {"all": "true", "coupled": "di < 0.85", "harmed": "delta < 0"}
_SETS = ", ".join(f"{name}_ AS (SELECT view AS v FROM sc WHERE {test})" for name, test in _PARTS.items())
_ONLY = "(SELECT count(*) FROM (SELECT v FROM {0}_ EXCEPT SELECT v FROM {1}_))"
_PAIRS = [("all", "coupled"), ("all", "harmed"), ("coupled", "harmed")]


def _parts(spark, sf):
    return {name: fx.scatter(spark, sf).filter(test).select("view") for name, test in _PARTS.items()}


@query("tbl_cross_table", f"WITH {SCATTER}, {_SETS}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_ONLY.format(a, b)} AS n_a_only, {_ONLY.format(b, a)} AS n_b_only" for a, b in _PAIRS) + ") SELECT *, n_a_only = 0 AND n_b_only = 0 AS equal FROM c", "", "n_a_only n_b_only")
def _(spark, sf):
    return profile.set_comparison(_parts(spark, sf), "view")


@query("tbl_view_consistency", f"WITH {SCATTER}, {_SETS}, u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS t, v FROM {n}_" for n in _PARTS) + ") SELECT v AS value, string_agg(t, ',' ORDER BY t) AS tables, count(*) = 3 AS everywhere FROM u GROUP BY v")
def _(spark, sf):
    return profile.membership(_parts(spark, sf), "view")


@query("stat_fit_band", f"WITH {SCATTER}, {_BOOT_FIT}, g AS (SELECT i, 0.6 + 0.06 * i AS x FROM range(0, 11) t(i)), o AS (SELECT regr_intercept(delta, di) AS a0, regr_slope(delta, di) AS b0, corr(di, delta) AS r FROM sc) SELECT i, any_value(a0 + b0 * x) AS fit, quantile_cont(a + b * x, 0.025) AS lo, quantile_cont(a + b * x, 0.975) AS hi, any_value(r) AS r FROM bf, g, o GROUP BY i", "fit lo hi r", "i")
def _(spark, sf):
    s = fx.scatter(spark, sf)
    one = s.agg(*stats.ols(F.col("di"), F.col("delta"))[1:3], stats.pearson(F.col("di"), F.col("delta")).alias("r"))
    grid = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("y", F.col("intercept") + F.col("slope") * (0.6 + 0.06 * F.col("i")))
    band = grid(boot_lines(s)).groupBy("i").agg(F.percentile("y", 0.025).alias("lo"), F.percentile("y", 0.975).alias("hi"))
    return grid(one).select("i", F.col("y").alias("fit"), "r").join(band, "i")


# ---- totals, ranks and subsets


@query("agg_grouping_sets_cube_rollup", f"WITH {RESULTS} SELECT model, CASE WHEN grouping(view) = 1 THEN '__ALL__' ELSE view END AS view, count(*) AS n, avg(value) AS mean FROM res GROUP BY GROUPING SETS ((model, view), (model))", "mean", "n")
def _(spark, sf):
    return profile.with_total(fx.results(spark, sf), ["model"], "view", "value")


@query("win_rank_first", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part", "", "rank")
def _(spark, sf):
    return profile.ordinal_ranks(fx.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey").drop("p_size")


@query("topk_argpartition", f"WITH {FEATURES_SQL} SELECT view, avg(eta_sq) FILTER (v_rank <= 6) AS eta_topv, avg(eta_sq) AS eta_all, avg(eta_sq) FILTER (v_rank <= 6) / (avg(eta_sq) + 1e-12) AS eta_es FROM vp GROUP BY view", "eta_topv eta_all eta_es")
def _(spark, sf):
    return stats.eta_enrichment(fx.features(spark, sf), VIEW, 10)


@query("topk_stability_topk", f"WITH {REPEATS_SQL} SELECT view, repeat, feature FROM rep WHERE imp_rank <= 6", "", "repeat")
def _(spark, sf):
    return fx.repeats(spark, sf).filter("imp_rank <= 6").select("view", "repeat", "feature")


@query("topk_feature_subsets", f"""WITH {FEATURES_SQL}, m AS (SELECT feature, v_rank, eta_rank FROM vp WHERE feature >= 'f016'), s AS (SELECT 'all' AS strategy, feature FROM m UNION ALL SELECT 'var', feature FROM m WHERE v_rank <= 6 UNION ALL SELECT 'shap', feature FROM m WHERE eta_rank <= 6
  UNION ALL SELECT 'random' || draw, feature FROM (SELECT draw, feature FROM m, range(0, 3) t(draw) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY md5('21|' || draw || '|' || feature), feature) <= 6))
  SELECT strategy, feature FROM s QUALIFY count(*) OVER (PARTITION BY strategy) >= 3""")  # fmt: skip
def _(spark, sf):
    # the matrix lacks features that the rankings have, so a set is kept only if half of it is there
    m = fx.vp(spark, sf).filter("feature >= 'f016'").select("view", "feature", "v_rank", "eta_rank")
    drawn = resample.random_sets(m.select("view", "feature"), VIEW, "feature", 6, 3, 21)
    of = lambda name, df: df.select(F.lit(name).alias("strategy"), "feature")
    sets = reduce(DataFrame.unionByName, [of("all", m), of("var", m.filter("v_rank <= 6")), of("shap", m.filter("eta_rank <= 6")), drawn.select(F.concat(F.lit("random"), F.col("draw").cast("string")).alias("strategy"), "feature")])
    kept = sets.groupBy("strategy").agg(F.count("*").alias("n")).filter("n >= 3").select("strategy")
    return sets.join(kept, "strategy", "left_semi")


@query("stat_pathway_null", f"""WITH {FEATURES_SQL}, pool AS (SELECT feature FROM vp WHERE v_rank <= 12 OR eta_rank <= 12), d AS (SELECT draw, feature, side FROM pool, range(0, 100) t(draw), (VALUES ('a', '31'), ('b', '32')) s(side, seed) QUALIFY row_number() OVER (PARTITION BY draw, side ORDER BY md5(concat_ws('|', seed, draw, feature)), feature) <= 12)
  SELECT draw, count(*) FILTER (n = 2) / CAST(count(*) AS DOUBLE) AS j FROM (SELECT draw, feature, count(*) AS n FROM d GROUP BY ALL) GROUP BY draw""", "j", "draw")  # fmt: skip
def _(spark, sf):
    pool = fx.vp(spark, sf).filter("v_rank <= 12 or eta_rank <= 12").select("view", "feature")
    both = resample.random_sets(pool, VIEW, "feature", 12, 100, 31).unionByName(resample.random_sets(pool, VIEW, "feature", 12, 100, 32))
    return both.groupBy("draw", "feature").agg(F.count("*").alias("n")).groupBy("draw").agg((F.count_if(F.col("n") == 2) / F.count("*")).alias("j"))


# ---- normalisation by policy


@query("mat_normalize_standardized", f"""WITH {BRAND}, z AS (SELECT 'raw' AS view, feature, x FROM brand UNION ALL SELECT 'scaled', feature, (x - avg(x) OVER w) / stddev_pop(x) OVER w FROM brand WINDOW w AS (PARTITION BY feature)), v AS (SELECT view, feature, var_pop(x) AS v FROM z GROUP BY ALL)
  SELECT view, CASE WHEN abs(avg(v) - 1) < 0.1 AND stddev_pop(v) < 0.1 THEN 'latent_axis' ELSE 'marginal' END AS approach, count(*) AS n_features FROM v GROUP BY view""", "", "n_features")  # fmt: skip
def _(spark, sf):
    b = fx.brand(spark, sf).withColumn("view", F.lit("raw"))
    both = b.unionByName(transform.standard_scale(b, VIEW).withColumn("view", F.lit("scaled")))
    kept, _ = transform.missingness(both, VIEW)
    n = kept.groupBy("view").agg(F.countDistinct("feature").alias("n_features"))
    c = moments.scale_check(kept, VIEW).select("view", F.when(F.col("is_standardized"), "latent_axis").otherwise("marginal").alias("approach"))
    return c.join(n, "view")


_TWO = f"{EMB}, {_HOLES}, h2 AS (SELECT v.view, feature, x FROM h, unnest(['proteomics', 'cnv']) v(view)), f AS (SELECT view, feature, avg(CAST(x IS NULL AS INT)) AS m, quantile_cont(x, 0.5) AS med FROM h2 GROUP BY ALL)"


@query("mat_normalize_passthrough", f"WITH {_TWO} SELECT view, feature, sum(coalesce(x, CASE WHEN view = 'proteomics' THEN med ELSE 0 END)) AS total FROM h2 JOIN f USING (view, feature) WHERE m <= 0.3 GROUP BY ALL", "total")
def _(spark, sf):
    h = _holes(spark, sf).withColumn("view", F.explode(F.array(F.lit("proteomics"), F.lit("cnv"))))
    return transform.impute_by_policy(h, VIEW, {"proteomics": "median"}).groupBy("view", "feature").agg(F.sum("x").alias("total"))


@query("mat_normalize_beta", f"WITH {LINE}, e AS (SELECT feature, min(x) >= 0 AND max(x) <= 1 AS share FROM line GROUP BY feature), c AS (SELECT feature, x, share, least(greatest(x, 1e-6), 1 - 1e-6) AS b FROM line JOIN e USING (feature)) SELECT feature, sum(CASE WHEN share THEN log2(b / (1 - b)) ELSE x END) / 1e6 AS total FROM c GROUP BY feature", "total")
def _(spark, sf):
    return transform.m_values_where_shares(fx.line(spark, sf), ["feature"]).groupBy("feature").agg((F.sum("x") / 1e6).alias("total"))


# ---- result tables


@query("tbl_fig5", f"WITH {SCATTER} SELECT dataset, view, di FROM sc", "di")
def _(spark, sf):
    return transform.projected(fx.scatter(spark, sf), ["dataset", "view", "di", "convergence"], 3)


@query("tbl_fig5_fallback", f"WITH {RESULTS}, dl AS (SELECT dataset, view, model, k_pct, avg(value) FILTER (strategy = 'var') - avg(value) FILTER (strategy = 'random') AS delta FROM res GROUP BY ALL) SELECT dataset, view, delta AS gain FROM dl WHERE k_pct = 10 QUALIFY row_number() OVER (PARTITION BY dataset, view ORDER BY model) = 1", "gain")
def _(spark, sf):
    d = deltas(spark, sf).filter("k_pct = 10").withColumnRenamed("delta", "gain")
    return ranking.ranked(d, ["dataset", "view"], "model", name="model", descending=False).filter("rank = 1").select("dataset", "view", "gain")


@query("tbl_st7", f"WITH {REPEATS_SQL}, s AS (SELECT view, feature, repeat FROM rep WHERE imp_rank <= 6), p AS (SELECT a.view, a.repeat AS a, b.repeat AS b, count(*) AS n FROM s a JOIN s b ON a.view = b.view AND a.feature = b.feature AND a.repeat < b.repeat GROUP BY ALL) SELECT view, sum(n / (12.0 - n)) / 10 AS stability FROM p GROUP BY view", "stability")
def _(spark, sf):
    flags = fx.repeats(spark, sf).select("view", "repeat", "feature", (F.col("imp_rank") <= 6).alias("in_set"))
    return overlap.pairwise_jaccard(flags, VIEW, "repeat").groupBy("view").agg(F.avg("jaccard").alias("stability"))


@query("tbl_st8", f"WITH {FEATURES_SQL} SELECT 'topV' AS gene_set, feature, v_rank AS rank FROM vp WHERE v_rank <= 12 UNION ALL SELECT 'topP', feature, eta_rank FROM vp WHERE eta_rank <= 12", "", "rank")
def _(spark, sf):
    v = fx.vp(spark, sf)
    part = lambda c: v.filter(F.col(c) <= 12).select("feature", F.col(c).alias("rank"))
    return transform.union_tagged({"topV": part("v_rank"), "topP": part("eta_rank")}, "gene_set")


# ---- tables written and read back

_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey FROM customer"
_DDL = "c_custkey long, c_name string, c_nationkey int"


def customers(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")


for _name, _suffix in (("scan_csv_gz", ".csv.gz"), ("sink_csv_gz", ".csv.gz"), ("scan_csv_with_fallback", ".csv"), ("scan_table_by_suffix", ".parquet"), ("sink_parquet_or_csvgz", ".parquet"), ("sink_json", ".json")):

    @query(_name, _CUSTOMERS, "", "c_custkey c_nationkey")
    def _(spark, sf, name=_name, suffix=_suffix):
        path = sinks.workspace(spark, name) + suffix
        sinks.write_table(customers(spark, sf), path)
        back = readers.read_delimited(spark, path, _DDL) if ".csv" in suffix else readers.read_table(spark, path)
        return back.select("c_custkey", "c_name", "c_nationkey")


@query("scan_csv_tsv_sniff", _CUSTOMERS, "", "c_custkey c_nationkey")
def _(spark, sf):
    path = sinks.workspace(spark, "sniff")
    customers(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_delimited(spark, path, _DDL).drop("_corrupt")


@query("scan_first_existing", "SELECT r_regionkey, r_name FROM region", "", "r_regionkey")
def _(spark, sf):
    found = readers.first_existing(spark, [f"{sf}/absent.parquet", f"{sf}/region.parquet", f"{sf}/nation.parquet"])
    return readers.read_table(spark, found).select("r_regionkey", "r_name")


@query("scan_raw_wide_matrix", "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, feature, CAST(x AS DOUBLE) AS x FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance FROM customer) UNPIVOT (x FOR feature IN (nation, balance))", "x")
def _(spark, sf):
    path = sinks.workspace(spark, "wide") + ".csv"
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    sinks.write_table(c, path)
    return readers.read_wide_matrix(spark, path, "c_custkey", features_in_rows=False)


@query("sink_resume_skip_existing", "SELECT c_custkey FROM customer WHERE c_nationkey >= 10", "", "c_custkey")
def _(spark, sf):
    path = sinks.workspace(spark, "done") + ".parquet"
    work = fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    sinks.write_table(work.filter("c_nationkey < 10").select("c_custkey"), path)
    return sinks.remaining(work.select("c_custkey"), path, ["c_custkey"])


@query("fn_gzip_magic", "SELECT 'csv' AS kind, false AS is_gzip, false AS looks_like_html UNION ALL SELECT 'gz', true, false")
def _(spark, sf):
    root = sinks.workspace(spark, "magic")
    r = fx.table(spark, sf, "region").coalesce(1)
    r.write.csv(f"{root}/csv")
    r.write.option("compression", "gzip").csv(f"{root}/gz")
    files = readers.magic_bytes(spark, f"{root}/*/part-*")
    return files.select(F.when(F.col("path").endswith(".gz"), "gz").otherwise("csv").alias("kind"), "is_gzip", "looks_like_html")
