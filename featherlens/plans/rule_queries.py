"""Queries of decision rules, threshold scans, reshaping and result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import overlap, profile, ranking, resample, rules, stats, transform
from . import fixtures as fx
from .fixtures import FEATURES_SQL, RESULTS, SCATTER, UNIT, VIEW
from .matrix_queries import GRID_SQL, grid
from .registry import query

#: What results call the states, zones and verdicts.
_STATE = "CASE WHEN di < 1 AND delta < 0 THEN 'VARIANCE_SIGNAL_DECOUPLED' WHEN di > 1 AND delta > 0 THEN 'VARIANCE_SIGNAL_ALIGNED' ELSE 'INCONCLUSIVE' END"
_ZONE = "CASE WHEN di < 0.95 AND delta < 0 THEN 'RED_HARMFUL' WHEN di > 1.05 AND delta > 0 THEN 'GREEN_SAFE' ELSE 'YELLOW_INCONCLUSIVE' END"
_DI_ZONE = "CASE WHEN di <= 0.9 THEN 'SAFE' WHEN di >= 1.0 THEN 'HARMFUL' ELSE 'INCONCLUSIVE' END"
_DI_ZONE_CI = "CASE WHEN di_hi < 0.9 THEN 'SAFE' WHEN di_lo > 1.0 THEN 'HARMFUL' ELSE 'INCONCLUSIVE' END"
_VERDICT = "CASE WHEN {0} <= -5 THEN 'CONFIRMED_HARM' WHEN {0} < -1 THEN 'MILD_HARM' WHEN abs({0}) <= 1 THEN 'TIE' ELSE 'TOPVAR_HELP' END"


def _zone(ci=None):
    limits = [F.col("di_lo"), F.col("di_hi"), F.col("delta") - 0.01, F.col("delta") + 0.01]
    return rules.vad_zone(F.col("di"), F.col("delta"), *[F.when(F.lit(False) if ci is None else ci, c) for c in limits])


def _state():
    return rules.diagnostic_state(F.col("di"), F.col("delta"))


_CASES = {
    "rule_regime_io": ("CASE WHEN di > 1.05 THEN 'ANTI_ALIGNED' WHEN di < 0.85 THEN 'COUPLED' ELSE 'DECOUPLED' END", lambda: rules.regime(F.col("di"))),
    "rule_regime_di_unc": ("CASE WHEN di >= 1.0 THEN 'ANTI_ALIGNED' WHEN di < 0.85 THEN 'COUPLED' ELSE 'MIXED' END", lambda: rules.regime(F.col("di"), 0.85, 1.0, "MIXED", closed=True)),
    "rule_regime_vp": (
        "CASE WHEN di > 1 THEN 'ANTI_ALIGNED' WHEN delta > 0 AND di_lo - 0.85 > 0 THEN 'COUPLED' WHEN abs(delta) <= 0.01 AND abs(di_lo - 0.85) <= 0.05 AND di_hi >= 0.5 THEN 'DECOUPLED' ELSE 'MIXED' END",
        lambda: rules.regime_with_gain(F.col("di"), F.col("delta"), F.col("di_lo") - 0.85, F.col("di_hi")),
    ),
    "rule_regime_sim": ("CASE WHEN delta >= 0.02 AND di <= 0.85 THEN 'COUPLED' WHEN di_hi >= 1.11 AND delta <= -0.02 THEN 'ANTI_ALIGNED' ELSE 'DECOUPLED' END", lambda: rules.regime_two_point(F.col("di"), F.col("delta") * 5, F.col("di_hi"), F.col("delta") * 5)),
    "rule_vad_zone": (
        f"CASE WHEN length(view) % 2 = 0 THEN CASE WHEN di_hi < 1 AND delta + 0.01 < 0 THEN 'RED_HARMFUL' WHEN di_lo > 1 AND delta - 0.01 > 0 THEN 'GREEN_SAFE' ELSE 'YELLOW_INCONCLUSIVE' END ELSE {_ZONE} END",
        lambda: _zone(F.length("view") % 2 == 0),
    ),
    "rule_di_zone": (_DI_ZONE_CI, lambda: rules.di_zone(F.col("di"), 0.9, 1.0, F.col("di_lo"), F.col("di_hi"))),
    "rule_di_zone_naive": (_DI_ZONE, lambda: rules.di_zone(F.col("di"), 0.9, 1.0)),
    "rule_risk": (
        "CASE WHEN di > 1.05 AND di_hi >= 1 AND delta > -0.05 THEN 'HIGH' WHEN di < 0.85 AND di_hi >= 0.5 AND delta > -0.05 THEN 'OK' WHEN di BETWEEN 0.85 AND 1.05 AND delta > -0.05 THEN 'NEUTRAL' ELSE 'UNCERTAIN' END",
        lambda: rules.risk(rules.regime(F.col("di")), F.col("di_hi"), F.col("delta") > -0.05),
    ),
    "rule_harm_verdict": (_VERDICT.format("(delta * 100)"), lambda: rules.harm_verdict(F.col("delta") * 100)),
}
for _name, (_sql, _rule) in _CASES.items():

    @query(_name, f"WITH {SCATTER} SELECT dataset, view, {_sql} AS call FROM sc")
    def _(spark, sf, rule=_rule):
        return fx.scatter(spark, sf).select("dataset", "view", rule().alias("call"))


@query("rule_sign_eps", f"WITH {SCATTER} SELECT view, CASE WHEN delta > 0.02 THEN 1 WHEN delta < -0.02 THEN -1 ELSE 0 END AS sgn FROM sc", "", "sgn")
def _(spark, sf):
    return fx.scatter(spark, sf).select("view", rules.sign_eps(F.col("delta"), 0.02).alias("sgn"))


@query("pred_material_harm", f"WITH {SCATTER} SELECT view, CAST(delta < -0.01 AS INT) AS harmful FROM sc", "", "harmful")
def _(spark, sf):
    return fx.scatter(spark, sf).select("view", (F.col("delta") < -0.01).cast("int").alias("harmful"))


@query("rule_consensus_vote", f"WITH {RESULTS}, l AS (SELECT view, model, k_pct, CASE WHEN avg(value) > 0.7 THEN 'HIGH' ELSE 'LOW' END AS label FROM res GROUP BY ALL), c AS (SELECT view, label, count(*) AS c FROM l GROUP BY ALL), s AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY view) AS DOUBLE) AS share, row_number() OVER (PARTITION BY view ORDER BY c DESC, label) AS n FROM c) SELECT view, CASE WHEN share = 0.5 THEN 'MIXED' ELSE label END AS consensus, share AS confidence FROM s WHERE n = 1", "confidence")
def _(spark, sf):
    r = fx.results(spark, sf).groupBy("view", "model", "k_pct").agg(F.when(F.avg("value") > 0.7, "HIGH").otherwise("LOW").alias("label"))
    return rules.majority(r, VIEW)


HARM, RATIOS, PRIMARY = 0.0, [1.0, 5.0, 10.0], 5.0


def _scan_sql(source: str, keys: str = "", ratios: str = "[1.0, 5.0, 10.0]") -> str:
    """CTE scan over a scatter; keys: columns with a comma after each."""
    part = f"PARTITION BY {keys.rstrip(', ')} " if keys else ""
    same = "cu.held = s.held" if keys else "true"
    return f"""cv AS (SELECT DISTINCT {keys}round(di, 6) AS t FROM {source}), cu AS (SELECT {keys}t FROM cv UNION SELECT {keys}(t + nxt) / 2 FROM (SELECT *, lead(t) OVER ({part}ORDER BY t) AS nxt FROM cv) WHERE nxt IS NOT NULL UNION SELECT {keys}min(t) - 1e-6 FROM cv GROUP BY ALL UNION SELECT {keys}max(t) + 1e-6 FROM cv GROUP BY ALL),
cf AS (SELECT {keys and 'cu.held, '}t, count(*) FILTER (di >= t AND delta < 0) AS tp, count(*) FILTER (di >= t AND delta >= 0) AS fp, count(*) FILTER (di < t AND delta < 0) AS fn, count(*) FILTER (di < t AND delta >= 0) AS tn FROM cu JOIN {source} s ON {same} GROUP BY ALL),
scan AS (SELECT {keys}t, cost_ratio, tp, fp, fn, tn, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS sensitivity, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity, -(cost_ratio * fn + fp) / CAST(tp + fp + fn + tn AS DOUBLE) AS utility FROM cf, unnest({ratios}) r(cost_ratio))"""


_SCAN = _scan_sql("sc")
_S = "t cost_ratio sensitivity specificity utility"
_BEST = "SELECT t FROM scan WHERE cost_ratio = 5.0 ORDER BY round(utility, 9) DESC, t LIMIT 1"


def scan(spark, sf, ratios=RATIOS):
    return rules.threshold_scan(fx.scatter(spark, sf), HARM, ratios)


@query("rule_threshold_scan", f"WITH {SCATTER}, {_SCAN} SELECT * FROM scan", _S, "tp fp fn tn")
def _(spark, sf):
    return scan(spark, sf)


@query("rule_threshold_grid", f"WITH {SCATTER}, {_SCAN} SELECT * EXCLUDE (cost_ratio) FROM scan WHERE cost_ratio = 5.0", "t sensitivity specificity utility", "tp fp fn tn")
def _(spark, sf):
    return scan(spark, sf, [PRIMARY]).drop("cost_ratio").orderBy("t")


@query("topk_idxmax", f"WITH {SCATTER}, {_SCAN} SELECT cost_ratio, t, utility FROM scan QUALIFY row_number() OVER (PARTITION BY cost_ratio ORDER BY round(utility, 9) DESC, t) = 1", "cost_ratio t utility")
def _(spark, sf):
    return rules.best_threshold(scan(spark, sf)).select("cost_ratio", "t", "utility")


@query("rule_pick_thresholds", f"""WITH {SCATTER}, {_SCAN}, g AS (SELECT cost_ratio, (list(t ORDER BY round(utility, 9) DESC, t))[1] AS t_opt, max(t) FILTER (sensitivity >= 0.9) AS s, min(t) FILTER (specificity >= 0.9) AS h FROM scan GROUP BY cost_ratio)
  SELECT cost_ratio, t_opt, CASE WHEN s > h THEN t_opt ELSE coalesce(s, t_opt) END AS t_safe, CASE WHEN s > h THEN t_opt ELSE coalesce(h, t_opt) END AS t_harm FROM g""", "cost_ratio t_opt t_safe t_harm")  # fmt: skip
def _(spark, sf):
    return rules.pick_thresholds(scan(spark, sf))


@query("rule_lodo", f"""WITH {SCATTER}, tr AS (SELECT held, sc.* FROM sc JOIN (SELECT DISTINCT dataset AS held FROM sc) h ON dataset <> held), {_scan_sql("tr", "held, ", "[5.0]")},
  b AS (SELECT held, t FROM scan QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(utility, 9) DESC, t) = 1)
  SELECT held, t, count(*) AS n, sum(CAST((di >= t) = (delta < 0) AS INT)) AS n_correct, avg(CAST((di >= t) = (delta < 0) AS INT)) AS accuracy FROM b JOIN sc ON dataset = held GROUP BY ALL""", "t accuracy", "n n_correct")  # fmt: skip
def _(spark, sf):
    return rules.transferred(fx.scatter(spark, sf), HARM, PRIMARY)


@query("rule_lovo", f"WITH {SCATTER}, {_SCAN}, b AS ({_BEST}) SELECT dataset, view, di, CAST(delta < 0 AS INT) AS actual, CAST(di >= t AS INT) AS predicted, CAST((di >= t) = (delta < 0) AS INT) AS correct FROM sc, b", "di", "actual predicted correct")
def _(spark, sf):
    t = rules.best_threshold(scan(spark, sf, [PRIMARY])).select("t")  # one row
    called, harm = F.col("di") >= F.col("t"), F.col("delta") < -HARM
    return fx.scatter(spark, sf).join(F.broadcast(t)).select("dataset", "view", "di", harm.cast("int").alias("actual"), called.cast("int").alias("predicted"), (called == harm).cast("int").alias("correct"))


_METRICS = ["v_total", "v_between", "v_within", "fis"]


@query("rule_best_metric", f"""WITH {FEATURES_SQL}, l AS (SELECT feature, eta_sq, metric, v FROM (SELECT feature, eta_sq, {', '.join(_METRICS)} FROM ft) UNPIVOT (v FOR metric IN ({', '.join(_METRICS)}))),
  r AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY metric ORDER BY eta_sq) + (count(*) OVER (PARTITION BY metric, eta_sq) - 1) / 2.0 AS b FROM l)
  SELECT metric, rho FROM (SELECT metric, corr(a, b) AS rho FROM r GROUP BY metric) ORDER BY round(abs(coalesce(rho, 0)), 9) DESC, metric LIMIT 1""", "rho")  # fmt: skip
def _(spark, sf):
    long = fx.features(spark, sf).unpivot(["feature", "eta_sq"], _METRICS, "metric", "v")
    rho = stats.spearman(long, ["metric"], "v", "eta_sq").select("metric", "rho")
    return rho.orderBy(F.desc(F.round(F.abs(F.coalesce("rho", F.lit(0.0))), 9)), "metric").limit(1)


@query("rule_diagnostic_state", f"WITH {SCATTER} SELECT dataset, view, {_STATE} AS state, CASE {_STATE} WHEN 'VARIANCE_SIGNAL_DECOUPLED' THEN 'RED_RISK' WHEN 'VARIANCE_SIGNAL_ALIGNED' THEN 'GREEN_SAFE' ELSE 'YELLOW_INCONCLUSIVE' END AS zone_nominal, {_ZONE} AS zone_conservative, {_STATE} <> 'VARIANCE_SIGNAL_ALIGNED' AS promising FROM sc")
def _(spark, sf):
    s = fx.scatter(spark, sf).select("dataset", "view", _state().alias("state"), _zone().alias("zone_conservative"))
    return s.withColumns({"zone_nominal": rules.nominal_zone(F.col("state")), "promising": rules.promising(F.col("state"), F.col("zone_conservative"))})


_DELTA = f"{RESULTS}, dl AS (SELECT dataset, view, model, k_pct, avg(value) FILTER (strategy = 'var') - avg(value) FILTER (strategy = 'random') AS delta FROM res GROUP BY ALL)"


def deltas(spark, sf):
    of = lambda s: F.avg(F.when(F.col("strategy") == s, F.col("value")))
    return fx.results(spark, sf).groupBy("dataset", "view", "model", "k_pct").agg((of("var") - of("random")).alias("delta"))


@query("rule_k_stability", f"WITH {_DELTA} SELECT dataset, view, CAST(min(CAST(delta < 0 AS INT)) = max(CAST(delta < 0 AS INT)) AS INT) AS k_stable, string_agg(CAST(k_pct AS VARCHAR), ',' ORDER BY k_pct) AS k_cols FROM dl WHERE model = 'rf' GROUP BY dataset, view", "", "k_stable")
def _(spark, sf):
    h = (F.col("delta") < -HARM).cast("int")
    d = deltas(spark, sf).filter("model = 'rf'")
    ks = F.array_join(F.transform(F.array_sort(F.collect_set("k_pct")), lambda k: k.cast("string")), ",")
    return d.groupBy("dataset", "view").agg((F.min(h) == F.max(h)).cast("int").alias("k_stable"), ks.alias("k_cols"))


@query(
    "rule_regime_lookup",
    f"""WITH {SCATTER}, b AS (SELECT sc.*, k.k_pct FROM sc, (VALUES (5), (10)) k(k_pct)),
    l AS (SELECT view, k_pct, CASE WHEN di > 1.1 AND k_pct = 10 THEN 'summary' WHEN di > 1.1 THEN 'nearest_k' WHEN delta > 0 THEN 'other_model' WHEN length(view) % 2 = 0 THEN 'di' WHEN dataset IN ('ASIA', 'EUROPE') THEN 'dataset' ELSE 'none' END AS regime_source, di, dataset FROM b)
    SELECT view, k_pct, regime_source, CASE regime_source WHEN 'summary' THEN 'ANTI_ALIGNED' WHEN 'nearest_k' THEN 'ANTI_ALIGNED' WHEN 'other_model' THEN 'COUPLED' WHEN 'di' THEN CASE WHEN di > 1.05 THEN 'ANTI_ALIGNED' WHEN di < 0.85 THEN 'COUPLED' ELSE 'DECOUPLED' END WHEN 'dataset' THEN 'MIXED' ELSE 'UNKNOWN' END AS regime FROM l""",
    "",
    "k_pct",
)
def _(spark, sf):
    """Five sources in order of precedence: the view's summary at K, at another K, another model's, its DI, its dataset's."""
    sc = fx.scatter(spark, sf)
    base = sc.select("dataset", "view", F.explode(F.array(F.lit(5), F.lit(10))).alias("k_pct"))
    summary = sc.filter("di > 1.1").select("view", F.lit(10).alias("k_pct"), F.lit("ANTI_ALIGNED").alias("r"))
    other = sc.filter("delta > 0").select("view", F.lit("COUPLED").alias("r"))
    by_di = sc.filter(F.length("view") % 2 == 0).select("view", rules.regime(F.col("di")).alias("r"))
    by_dataset = sc.filter(F.col("dataset").isin("ASIA", "EUROPE")).select("dataset", F.lit("MIXED").alias("r")).distinct()
    sources = [("summary", summary, ["view", "k_pct"], "r"), ("nearest_k", summary.drop("k_pct"), ["view"], "r"), ("other_model", other, ["view"], "r"), ("di", by_di, ["view"], "r"), ("dataset", by_dataset, ["dataset"], "r")]
    return rules.first_known(base, sources, "regime").select("view", "k_pct", "regime", "regime_source")


#: The panel's five models, each from a model and K of the results table.
_PANEL = {"xgb": ("xgb", 1), "hgb": ("xgb", 5), "gbc": ("xgb", 10), "rf": ("rf", 10), "extratrees": ("rf", 20)}
_PANEL_SQL = f"""{SCATTER}, dl AS (SELECT dataset, view, model, k_pct, 100 * (avg(value) FILTER (strategy = 'var') - avg(value) FILTER (strategy = 'random')) AS d FROM res GROUP BY ALL),
pn AS (SELECT dataset, view, {', '.join(f"max(d) FILTER (model = '{m}' AND k_pct = {k} AND dataset <> 'ASIA'{' AND length(view) % 2 = 1' if name == 'hgb' else ''}) AS {name}" for name, (m, k) in _PANEL.items())} FROM dl GROUP BY ALL),
pc AS (SELECT pn.*, {_STATE} AS state, list_filter([xgb, hgb, gbc, rf, extratrees], lambda d: d IS NOT NULL) AS ds, list_filter([xgb, hgb, gbc], lambda d: d IS NOT NULL) AS bs FROM pn JOIN sc USING (dataset, view)),
pk AS (SELECT *, len(ds) AS n, len(list_filter(ds, lambda d: d <= -5)) AS harm, len(list_filter(bs, lambda d: d <= -5)) AS bharm, len(list_filter(ds, lambda d: d > 1)) AS help FROM pc)"""


@query("rule_panel_call", f"""WITH {_PANEL_SQL} SELECT view, n AS n_models, harm AS n_harm, CASE WHEN n = 0 THEN CASE state WHEN 'VARIANCE_SIGNAL_DECOUPLED' THEN 'VARIANCE_SIGNAL_DECOUPLED_ONLY' ELSE state END
  WHEN xgb <= -5 AND harm >= 3 THEN 'TREE_PANEL_CONFIRMED_HARM' WHEN xgb <= -5 AND bharm >= greatest(2, ceil(len(bs) / 2)) THEN 'BOOSTING_FAMILY_CONFIRMED_HARM' WHEN xgb <= -5 THEN 'XGB_CONFIRMED_HARM_MODEL_DEPENDENT'
  WHEN harm >= 2 THEN 'NON_XGB_TREE_HARM_CHECK_REQUIRED' WHEN help >= greatest(2, ceil(n / 2)) THEN 'TOPVAR_HELP_TREE_PANEL' WHEN state = 'VARIANCE_SIGNAL_DECOUPLED' THEN 'VARIANCE_SIGNAL_DECOUPLED_ONLY'
  WHEN len(list_filter(ds, lambda d: d < -1)) > 0 THEN 'MILD_OR_MODEL_SPECIFIC_HARM' ELSE state END AS call FROM pk""", "", "n_models n_harm")  # fmt: skip
def _(spark, sf):
    d = deltas(spark, sf).filter("dataset <> 'ASIA'")
    of = lambda name, m, k: F.max(F.when((F.col("model") == m) & (F.col("k_pct") == k) & ((F.length("view") % 2 == 1) if name == "hgb" else F.lit(True)), 100 * F.col("delta"))).alias(name)
    panel = d.groupBy("dataset", "view").agg(*[of(name, m, k) for name, (m, k) in _PANEL.items()])
    both = fx.scatter(spark, sf).join(panel, ["dataset", "view"], "left")
    pp = {m: F.col(m) for m in _PANEL}
    count = lambda test: sum(F.coalesce(test(c).cast("int"), F.lit(0)) for c in pp.values())
    return both.select("view", count(lambda c: c.isNotNull()).alias("n_models"), count(lambda c: c <= -5).alias("n_harm"), rules.panel_call(pp, _state()).alias("call"))


_RISK = f"greatest(0, least(2, 1 - di)) * 3 + greatest(0, least(0.5, -delta)) * 6 + CASE WHEN {_STATE} = 'VARIANCE_SIGNAL_DECOUPLED' THEN 5 ELSE 0 END"


def risks(spark, sf):
    s = fx.scatter(spark, sf).withColumns({"state": _state(), "zone": _zone()})
    return s.withColumn("risk", rules.risk_score(F.col("di"), F.col("delta"), F.col("state"), F.col("zone")))


@query("rule_rank_vad", f"WITH {SCATTER}, r AS (SELECT dataset, view, {_RISK} AS risk FROM sc) SELECT view, risk, row_number() OVER (ORDER BY round(risk, 9) DESC, dataset, view) AS rank FROM r", "risk", "rank")
def _(spark, sf):
    return risks(spark, sf).select("view", "risk", F.row_number().over(Window.orderBy(F.desc(F.round("risk", 9)), "dataset", "view")).alias("rank"))


@query("rule_promising", f"WITH {SCATTER} SELECT dataset, max({_RISK}) AS risk FROM sc WHERE {_STATE} <> 'VARIANCE_SIGNAL_ALIGNED' GROUP BY dataset ORDER BY risk DESC, dataset LIMIT 3", "risk")
def _(spark, sf):
    r = risks(spark, sf).filter(rules.promising(F.col("state"), F.col("zone")))
    return r.groupBy("dataset").agg(F.max("risk").alias("risk")).orderBy(F.desc("risk"), "dataset").limit(3)


_PIVOT = "pv AS (SELECT view, k_pct, max(delta) FILTER (model = 'rf') AS rf, max(delta) FILTER (model = 'xgb') AS xgb FROM dl GROUP BY ALL)"


def by_model(spark, sf):
    return deltas(spark, sf).groupBy("view", "k_pct").pivot("model", ["rf", "xgb"]).agg(F.max("delta"))


@query("shape_pivot", f"WITH {_DELTA}, {_PIVOT} SELECT view, k_pct, rf, xgb, CASE WHEN rf > 0 THEN 1 WHEN rf < 0 THEN -1 ELSE 0 END = CASE WHEN xgb > 0 THEN 1 WHEN xgb < 0 THEN -1 ELSE 0 END AS same_sign, rf < 0 AND xgb < 0 AS both_hurt, rf > 0 AND xgb > 0 AS both_help FROM pv", "rf xgb", "k_pct")
def _(spark, sf):
    rf, xgb = F.col("rf"), F.col("xgb")
    return by_model(spark, sf).withColumns({"same_sign": rules.sign_eps(rf, 0.0) == rules.sign_eps(xgb, 0.0), "both_hurt": (rf < 0) & (xgb < 0), "both_help": (rf > 0) & (xgb > 0)})


_PERF = """pf AS (SELECT dataset, view, model, avg(value) FILTER (strategy = 'var') AS pv, avg(value) FILTER (strategy = 'random') AS pr, avg(value) FILTER (strategy = 'shap') AS ps FROM res WHERE k_pct = 10 GROUP BY ALL)"""


@query(
    "rule_hero_rank",
    f"""WITH {SCATTER}, {_PERF},
    h AS (SELECT x.dataset, x.view, x.pv - x.pr AS dvr, r.pv - r.pr AS rf, x.ps - x.pv AS dsv, x.pv, x.pr, di, CASE WHEN length(x.view) % 3 > 0 THEN di_hi END AS cr
      FROM pf x JOIN pf r USING (dataset, view) JOIN sc USING (dataset, view) WHERE x.model = 'xgb' AND r.model = 'rf'),
    t AS (SELECT *, abs(dvr) > 0.005 AND abs(rf) > 0.005 AND (dvr > 0) = (rf > 0) AS agree, CASE WHEN dataset = 'ASIA' THEN false ELSE abs(dvr) > 0.1 OR abs(dsv) > 0.15 END AS validated,
      CASE WHEN dvr < -0.02 AND dsv > 0.02 THEN 'ANTI_ALIGNED' WHEN dvr > 0.02 AND abs(dsv) < 0.02 THEN 'COUPLED' ELSE 'MIXED' END AS category,
      2 * greatest(0, -dvr) + 1.5 * greatest(0, dsv) + 0.2 * di AS sa, 3 * greatest(0, dvr) + 0.5 * greatest(0, 0.05 - abs(dsv)) AS sc_ FROM h),
    u AS (SELECT *, CASE CAST(agree AS INT) + CAST(validated AS INT) + CAST(cr IS NOT NULL AS INT) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
      CASE category WHEN 'ANTI_ALIGNED' THEN sa WHEN 'COUPLED' THEN sc_ ELSE (sa + sc_) / 2 END AS score FROM t)
    SELECT view, agree, validated, tier, category, score, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, dataset, view) AS rank FROM u""",
    "score",
    "rank",
)
def _(spark, sf):
    """Limits under permutation are known outside one dataset, biology for some views."""
    mean = lambda s: F.avg(F.when(F.col("strategy") == s, F.col("value")))
    perf = fx.results(spark, sf).filter("k_pct = 10").groupBy("dataset", "view", "model").agg(mean("var").alias("pv"), mean("random").alias("pr"), mean("shap").alias("ps"))
    x = perf.filter("model = 'xgb'").select("dataset", "view", (F.col("pv") - F.col("pr")).alias("dvr_xgb"), (F.col("ps") - F.col("pv")).alias("dsv_xgb"), F.col("pv").alias("perf_var"), F.col("pr").alias("perf_random"))
    r = perf.filter("model = 'rf'").select("dataset", "view", (F.col("pv") - F.col("pr")).alias("dvr_rf"))
    s = fx.scatter(spark, sf).select("dataset", "view", "di", F.when(F.length("view") % 3 > 0, F.col("di_hi")).alias("convergence"))
    limit = lambda v: F.when(F.col("dataset") != "ASIA", F.lit(v))
    rows = x.join(r, ["dataset", "view"]).join(s, ["dataset", "view"]).withColumns({"dvr_lo": limit(-0.1), "dvr_hi": limit(0.1), "dsv_lo": limit(-0.15), "dsv_hi": limit(0.15)})
    return rules.hero_rank(rows).select("view", "agree", "validated", "tier", "category", "score", "rank")


@query("rule_sign_metrics", f"""WITH {SCATTER}, l AS (SELECT delta AS y, m.metric, CASE m.metric WHEN 'eta_es' THEN di WHEN 'f_di' THEN di_hi WHEN 'vsa' THEN di - 0.9 ELSE di_lo END AS x FROM sc, unnest(['eta_es', 'f_di', 'vsa', 'pcla']) m(metric)),
  c AS (SELECT metric, y < 0 AS y, CASE metric WHEN 'eta_es' THEN x < 1 WHEN 'f_di' THEN x > 1 WHEN 'vsa' THEN x < 0 END AS p FROM l)
  SELECT metric, count(*) AS n, avg(CAST(p = y AS INT)) AS accuracy, avg(CAST(p AS INT)) FILTER (y) AS sensitivity, avg(CAST(NOT p AS INT)) FILTER (NOT y) AS specificity FROM c GROUP BY metric""", "accuracy sensitivity specificity", "n")  # fmt: skip
def _(spark, sf):
    long = fx.scatter(spark, sf).select(F.col("delta").alias("y"), F.expr("stack(4, 'eta_es', di, 'f_di', di_hi, 'vsa', di - 0.9D, 'pcla', di_lo) as (metric, x)"))
    return rules.sign_metrics(long, [])


@query("rule_saf_qc", f"WITH {FEATURES_SQL}, q AS (SELECT count(*) AS n, count(DISTINCT feature) AS d, count(*) FILTER (v_between < 0) AS neg, avg(CAST(v_between < 1e-9 AS INT)) AS near_zero FROM ft) SELECT n, n - d AS n_dup, neg AS n_negative, near_zero, CASE WHEN n > d OR neg > 0 OR near_zero > 0.5 THEN 'FAIL' ELSE 'PASS' END AS status FROM q", "near_zero", "n n_dup n_negative")
def _(spark, sf):
    q = fx.features(spark, sf).agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("feature")).alias("n_dup"), F.count_if(F.col("v_between") < 0).alias("n_negative"), F.avg((F.col("v_between") < 1e-9).cast("double")).alias("near_zero"))
    return q.withColumn("status", F.when((F.col("n_dup") > 0) | (F.col("n_negative") > 0) | (F.col("near_zero") > 0.5), "FAIL").otherwise("PASS"))


#: Views that a bundle of the test tables should have, with their least features; brand has other samples than the bundle.
_EXPECTED = {"emb": 50, "brand": 20, "methylation": 100}
_BUNDLE = f"""{fx.EMB}, {fx.BRAND}, {fx.SAMPLES},
vals AS (SELECT view, sample_id, feature, CASE WHEN feature IN ('f007', 'f008') AND sample_id % 3 > 0 THEN NULL WHEN feature = 'f009' THEN 1.0 ELSE x END AS x FROM emb UNION ALL SELECT view, sample_id, feature, x FROM brand),
ea AS (SELECT view, feature, count(*) AS cells, count(*) FILTER (x IS NULL) AS gone, count(*) FILTER (isinf(x)) AS endless, CAST(min(x) IS NOT DISTINCT FROM max(x) AS INT) AS constant FROM vals GROUP BY view, feature),
vw AS (SELECT view, count(*) AS features, sum(cells) AS cells, sum(gone) AS gone, sum(endless) AS endless, count(*) FILTER (feature IS NULL OR feature = '') AS nameless, sum(constant) AS constant FROM ea GROUP BY view),
hd AS (SELECT view, count(DISTINCT sample_id) AS held FROM vals GROUP BY view), bd AS (SELECT count(DISTINCT sample_id) AS samples, count(DISTINCT label) AS classes, count(*) - count(DISTINCT sample_id) AS twice FROM samples),
wt AS (SELECT * FROM (VALUES ('emb', 50), ('brand', 20), ('methylation', 100)) t(view, least)),
fo AS (SELECT coalesce(wt.view, vw.view) AS view, least, features, cells, gone, endless, nameless, constant, held, samples FROM wt FULL JOIN vw ON wt.view = vw.view LEFT JOIN hd ON hd.view = vw.view, bd),
ck AS (SELECT view, 'present' AS check, CAST(features IS NOT NULL AS INT) AS value, CASE WHEN features IS NULL THEN 'WARN' ELSE 'OK' END AS level FROM fo
  UNION ALL SELECT view, 'expected', CAST(least IS NOT NULL AS INT), CASE WHEN least IS NULL THEN 'WARN' ELSE 'OK' END FROM fo
  UNION ALL SELECT view, 'samples', held, CASE WHEN held <> samples THEN 'ERROR' ELSE 'OK' END FROM fo UNION ALL SELECT view, 'features', features, CASE WHEN features < least THEN 'WARN' ELSE 'OK' END FROM fo
  UNION ALL SELECT view, 'missing', gone / cells, CASE WHEN gone / cells > 0.5 THEN 'ERROR' WHEN gone / cells > 0.01 THEN 'WARN' ELSE 'OK' END FROM fo UNION ALL SELECT view, 'infinite', endless, CASE WHEN endless > 0 THEN 'ERROR' ELSE 'OK' END FROM fo
  UNION ALL SELECT view, 'constant', constant / features, CASE WHEN constant / features > 0.5 THEN 'WARN' ELSE 'OK' END FROM fo UNION ALL SELECT view, 'nameless', nameless, CASE WHEN nameless > 0 THEN 'WARN' ELSE 'OK' END FROM fo
  UNION ALL SELECT '', 'bundle_samples', samples, CASE WHEN samples < 30 THEN 'WARN' ELSE 'OK' END FROM bd UNION ALL SELECT '', 'bundle_classes', classes, CASE WHEN classes < 2 THEN 'WARN' ELSE 'OK' END FROM bd
  UNION ALL SELECT '', 'repeated_samples', twice, CASE WHEN twice > 0 THEN 'ERROR' ELSE 'OK' END FROM bd)"""


def bundle_checks(spark, sf):
    gap = F.when(F.col("feature").isin("f007", "f008") & (F.col("sample_id") % 3 > 0), None).when(F.col("feature") == "f009", 1.0).otherwise(F.col("x"))
    emb = fx.emb(spark, sf).select("view", "sample_id", "feature", gap.alias("x"))
    brand = fx.brand(spark, sf).select("view", "sample_id", "feature", "x")
    return profile.bundle_checks(emb.unionAll(brand), fx.samples(spark, sf), _EXPECTED, 30, 2)


@query("rule_bundle_validate", f"WITH {_BUNDLE} SELECT view, \"check\", value, level FROM ck WHERE value IS NOT NULL", "value")
def _(spark, sf):
    """Every check of every view, with gaps and a constant put into the embeddings."""
    return bundle_checks(spark, sf)


@query("rule_bundle_status", f"WITH {_BUNDLE} SELECT view, count(*) FILTER (level = 'ERROR') AS n_errors, count(*) FILTER (level = 'WARN') AS n_warnings, CASE WHEN count(*) FILTER (level = 'ERROR') > 0 THEN 'FAIL' WHEN count(*) FILTER (level = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM ck WHERE value IS NOT NULL GROUP BY view", "", "n_errors n_warnings")
def _(spark, sf):
    return profile.verdict(bundle_checks(spark, sf), ["view"])


# ---- result tables


@query("agg_ablation_delta_pp", f"WITH {RESULTS}, s AS (SELECT view, k_pct, avg(value) FILTER (strategy = 'var') AS top, avg(value) FILTER (strategy = 'random') AS rnd, stddev_samp(value) FILTER (strategy = 'random') AS sd FROM res GROUP BY ALL) SELECT view, k_pct, top, rnd, sd, (top - rnd) * 100 AS delta_pp, {_VERDICT.format('((top - rnd) * 100)')} AS verdict FROM s", "top rnd sd delta_pp", "k_pct")
def _(spark, sf):
    of = lambda s: F.when(F.col("strategy") == s, F.col("value"))
    s = fx.results(spark, sf).groupBy("view", "k_pct").agg(F.avg(of("var")).alias("top"), F.avg(of("random")).alias("rnd"), F.stddev_samp(of("random")).alias("sd"))
    return s.withColumn("delta_pp", (F.col("top") - F.col("rnd")) * 100).withColumn("verdict", rules.harm_verdict(F.col("delta_pp")))


@query("agg_label_level_rollup", f"WITH {_DELTA} SELECT dataset, model, count(*) AS n_rows, count(*) FILTER (delta < -0.05) AS n_harm, min(delta) AS worst, avg(delta) AS mean_delta, CASE WHEN count(*) FILTER (delta < -0.05) >= 5 THEN 'PRIORITY' WHEN min(delta) < -0.05 THEN 'WATCH' ELSE 'CLEAR' END AS call FROM dl GROUP BY dataset, model", "worst mean_delta", "n_rows n_harm")
def _(spark, sf):
    g = deltas(spark, sf).groupBy("dataset", "model").agg(F.count("*").alias("n_rows"), F.count_if(F.col("delta") < -0.05).alias("n_harm"), F.min("delta").alias("worst"), F.avg("delta").alias("mean_delta"))
    return g.withColumn("call", F.when(F.col("n_harm") >= 5, "PRIORITY").when(F.col("worst") < -0.05, "WATCH").otherwise("CLEAR"))


_SEED_SQL = f"{RESULTS}, m AS (SELECT view, repeat AS seed, avg(value) FILTER (strategy = 'var') - avg(value) FILTER (strategy = 'random') AS d FROM res WHERE k_pct = 10 GROUP BY ALL)"


def seed_deltas(spark, sf):
    m = fx.results(spark, sf).filter("k_pct = 10").groupBy("view", F.col("repeat").alias("seed")).pivot("strategy", ["var", "random"]).agg(F.avg("value"))
    return m.select("view", "seed", (F.col("var") - F.col("random")).alias("d"))


@query("tbl_seed_delta", f"WITH {_SEED_SQL} SELECT view, seed, d FROM m", "d", "seed")
def _(spark, sf):
    return seed_deltas(spark, sf)


for _name in ("agg_label_perm_summary", "tbl_label_perm_fallback"):

    @query(_name, f"WITH {_SEED_SQL} SELECT view, avg(d) AS mean, quantile_cont(d, 0.05) AS q05, quantile_cont(d, 0.95) AS q95, count(DISTINCT seed) AS n_seeds FROM m GROUP BY view", "mean q05 q95", "n_seeds")
    def _(spark, sf):
        return seed_deltas(spark, sf).groupBy("view").agg(F.avg("d").alias("mean"), F.percentile("d", 0.05).alias("q05"), F.percentile("d", 0.95).alias("q95"), F.countDistinct("seed").alias("n_seeds"))


@query("agg_st6_perm_pvalue", f"WITH {RESULTS}, o AS (SELECT view, avg(value) AS obs FROM res WHERE strategy = 'var' GROUP BY view), p AS (SELECT view, model, k_pct, repeat, avg(value) AS v FROM res WHERE strategy = 'random' GROUP BY ALL) SELECT view, any_value(obs) AS observed, avg(v) AS perm_mean, stddev_samp(v) AS perm_sd, count(*) AS n, (count(*) FILTER (v >= obs) + 1) / (count(*) + 1.0) AS p FROM p JOIN o USING (view) GROUP BY view", "observed perm_mean perm_sd p", "n")
def _(spark, sf):
    r = fx.results(spark, sf)
    o = r.filter("strategy = 'var'").groupBy("view").agg(F.avg("value").alias("obs"))
    p = r.filter("strategy = 'random'").groupBy("view", "model", "k_pct", "repeat").agg(F.avg("value").alias("v")).join(o, "view")
    return p.groupBy("view").agg(F.first("obs").alias("observed"), F.avg("v").alias("perm_mean"), F.stddev_samp("v").alias("perm_sd"), F.count("*").alias("n"), ((F.count_if(F.col("v") >= F.col("obs")) + 1) / (F.count("*") + 1.0)).alias("p"))


_WIDE = f"{RESULTS}, wd AS (SELECT dataset, view, model, k_pct, repeat, " + ", ".join(f"avg(value) FILTER (strategy = '{s}') AS p_{s}" for s in ("all", "var", "shap", "random", "saf")) + " FROM res GROUP BY ALL)"
_STRATEGIES = ["all", "var", "shap", "random", "saf"]


def wide(spark, sf):
    w = fx.results(spark, sf).groupBy("dataset", "view", "model", "k_pct", "repeat").pivot("strategy", _STRATEGIES).agg(F.avg("value"))
    return w.withColumnsRenamed({s: f"p_{s}" for s in _STRATEGIES})


@query("shape_unstack", f"WITH {_WIDE} SELECT dataset, view, model, k_pct, repeat, p_var - p_random AS d_var_random, p_shap - p_var AS d_shap_var, p_saf - p_var AS d_saf_var, p_all - p_shap AS d_all_shap FROM wd", "d_var_random d_shap_var d_saf_var d_all_shap", "k_pct repeat")
def _(spark, sf):
    d = lambda a, b: (F.col(f"p_{a}") - F.col(f"p_{b}")).alias(f"d_{a}_{b}")
    return wide(spark, sf).select("dataset", "view", "model", "k_pct", "repeat", d("var", "random"), d("shap", "var"), d("saf", "var"), d("all", "shap"))


_MASTER = f"{_WIDE}, ms AS (SELECT dataset, view, model, k_pct, " + ", ".join(f"avg(p_{s}) AS {s}_mean, quantile_cont(p_{s}, 0.025) AS {s}_lo, quantile_cont(p_{s}, 0.975) AS {s}_hi" for s in _STRATEGIES) + " FROM wd GROUP BY ALL)"
_MD = " ".join(f"{s}_{x}" for s in _STRATEGIES for x in ("mean", "lo", "hi"))


def master(spark, sf):
    aggs = []
    for s in _STRATEGIES:
        p = F.percentile(f"p_{s}", F.array(F.lit(0.025), F.lit(0.975)))
        aggs += [F.avg(f"p_{s}").alias(f"{s}_mean"), p[0].alias(f"{s}_lo"), p[1].alias(f"{s}_hi")]
    return wide(spark, sf).groupBy("dataset", "view", "model", "k_pct").agg(*aggs)


for _name in ("ml_ablation_master", "tbl_master_from_json"):

    @query(_name, f"WITH {_MASTER} SELECT * FROM ms", _MD, "k_pct")
    def _(spark, sf):
        return master(spark, sf)


@query("ml_ablation_interpret", f"WITH {_MASTER} SELECT view, max(CAST(var_mean - random_mean < -0.05 AS INT)) = 1 AS anti_harmed, max(var_mean - random_mean) AS best_delta, arg_max(k_pct, round(var_mean - random_mean, 9)) AS best_k FROM ms WHERE model = 'rf' GROUP BY view", "best_delta", "best_k")
def _(spark, sf):
    d = F.col("var_mean") - F.col("random_mean")
    m = master(spark, sf).filter("model = 'rf'").withColumn("d", F.round(d, 9))
    best = ranking.ranked(m, ["view"], "d", name="k_pct").filter("rank = 1").select("view", F.col("k_pct").alias("best_k"))
    return m.groupBy("view").agg((F.max((d < -0.05).cast("int")) == 1).alias("anti_harmed"), F.max(d).alias("best_delta")).join(best, "view")


@query("ml_oof_eval", f"WITH {_WIDE}, b AS (SELECT view, model FROM (SELECT view, model, avg(p_all) AS a FROM wd GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY view ORDER BY round(a, 9) DESC, model) = 1) SELECT wd.view, b.model, avg(p_shap - p_all) AS delta, quantile_cont(p_shap - p_all, 0.025) AS lo, quantile_cont(p_shap - p_all, 0.975) AS hi FROM wd JOIN b ON wd.view = b.view AND wd.model = b.model GROUP BY ALL", "delta lo hi")
def _(spark, sf):
    w = wide(spark, sf)
    a = w.groupBy("view", "model").agg(F.round(F.avg("p_all"), 9).alias("a"))
    best = ranking.ranked(a, ["view"], "a", name="model").filter("rank = 1").select("view", "model")
    d = F.col("p_shap") - F.col("p_all")
    return w.join(best, ["view", "model"]).groupBy("view", "model").agg(F.avg(d).alias("delta"), F.percentile(d, 0.025).alias("lo"), F.percentile(d, 0.975).alias("hi"))


@query("shape_heatmap", f"WITH {_DELTA} SELECT view, " + ", ".join(f"max(delta) FILTER (k_pct = {k}) AS k{k}" for k in fx.K_PCTS) + " FROM dl WHERE model = 'rf' GROUP BY view", "k1 k5 k10 k20")
def _(spark, sf):
    p = deltas(spark, sf).filter("model = 'rf'").groupBy("view").pivot("k_pct", fx.K_PCTS).agg(F.max("delta"))
    return p.withColumnsRenamed({str(k): f"k{k}" for k in fx.K_PCTS})


@query("shape_pivot_ari", f"WITH {RESULTS} SELECT view, " + ", ".join(f"avg(value) FILTER (strategy = '{s}') AS {s}_avg, max(value) FILTER (strategy = '{s}') AS {s}_max" for s in ("all", "var", "shap")) + " FROM res GROUP BY view", " ".join(f"{s}_{x}" for s in ("all", "var", "shap") for x in ("avg", "max")))
def _(spark, sf):
    return fx.results(spark, sf).groupBy("view").pivot("strategy", ["all", "var", "shap"]).agg(F.avg("value").alias("avg"), F.max("value").alias("max"))


@query("join_inner_dsview_k", f"WITH {SCATTER}, dl AS (SELECT dataset, view, model, k_pct, avg(value) AS v FROM res GROUP BY ALL) SELECT dataset, view, model, di, v FROM sc JOIN dl USING (dataset, view) WHERE k_pct = 10", "di v")
def _(spark, sf):
    r = fx.results(spark, sf).filter("k_pct = 10").groupBy("dataset", "view", "model").agg(F.avg("value").alias("v"))
    return fx.scatter(spark, sf).join(r, ["dataset", "view"]).select("dataset", "view", "model", "di", "v")


@query("join_final_calls", f"WITH {SCATTER}, dl AS (SELECT dataset, view, model, k_pct, avg(value) FILTER (strategy = 'var') - avg(value) FILTER (strategy = 'random') AS delta FROM res GROUP BY ALL), {_PIVOT} SELECT sc.view, di, rf, xgb, CAST(rf < -0.01 AS INT) + CAST(xgb < -0.01 AS INT) AS n_harm FROM sc LEFT JOIN (SELECT * FROM pv WHERE k_pct = 10) USING (view)", "di rf xgb", "n_harm")
def _(spark, sf):
    p = by_model(spark, sf).filter("k_pct = 10").drop("k_pct")
    return fx.scatter(spark, sf).join(p, "view", "left").select("view", "di", "rf", "xgb", ((F.col("rf") < -0.01).cast("int") + (F.col("xgb") < -0.01).cast("int")).alias("n_harm"))


@query("join_left_enrich_regime", f"WITH {_DELTA}, s AS ({'SELECT view, CASE WHEN length(view) % 3 = 0 THEN ' + chr(39) + 'UNKNOWN' + chr(39) + ' ELSE ' + chr(39) + 'COUPLED' + chr(39) + ' END AS regime, ' + chr(39) + 'MIXED' + chr(39) + ' AS consensus FROM (SELECT DISTINCT view FROM res) WHERE length(view) < 9'}) SELECT dl.view, model, delta, CASE WHEN regime = 'UNKNOWN' THEN consensus ELSE regime END AS regime FROM dl LEFT JOIN s USING (view) WHERE k_pct = 10", "delta")
def _(spark, sf):
    d = deltas(spark, sf).filter("k_pct = 10")
    s = fx.results(spark, sf).select("view").distinct().filter(F.length("view") < 9).select("view", F.when(F.length("view") % 3 == 0, "UNKNOWN").otherwise("COUPLED").alias("regime"), F.lit("MIXED").alias("consensus"))
    return d.join(s, "view", "left").select("view", "model", "delta", F.when(F.col("regime") == "UNKNOWN", F.col("consensus")).otherwise(F.col("regime")).alias("regime"))


@query("join_outer_models", f"WITH {_DELTA}, a AS (SELECT view, delta AS rf FROM dl WHERE model = 'rf' AND k_pct = 10 AND delta < 0.05), b AS (SELECT view, delta AS xgb FROM dl WHERE model = 'xgb' AND k_pct = 10 AND delta > -0.05) SELECT coalesce(a.view, b.view) AS view, rf, xgb FROM a FULL JOIN b ON a.view = b.view", "rf xgb")
def _(spark, sf):
    d = deltas(spark, sf).filter("k_pct = 10")
    a = d.filter("model = 'rf' and delta < 0.05").select("view", F.col("delta").alias("rf"))
    return a.join(d.filter("model = 'xgb' and delta > -0.05").select("view", F.col("delta").alias("xgb")), "view", "full")


@query("tbl_fig1_curves", f"WITH {GRID_SQL} SELECT view, k_pct, di, delta_j FROM grid", "di delta_j", "k_pct")
def _(spark, sf):
    return grid(spark, sf).select("view", "k_pct", "di", "delta_j")


for _name, _cols in (("tbl_fig3", ["all_mean", "var_mean", "random_mean"]), ("tbl_st4", ["all_mean", "saf_mean", "shap_mean"]), ("tbl_st2", ["all_mean"])):

    @query(_name, f"WITH {_MASTER} SELECT dataset, view, model, k_pct, {', '.join(_cols)} FROM ms", " ".join(_cols), "k_pct")
    def _(spark, sf, cols=_cols):
        m = master(spark, sf)
        return m.filter("model = 'rf'").unionByName(m.filter("model = 'xgb'")).select("dataset", "view", "model", "k_pct", *cols)


@query("tbl_st3", f"WITH {SCATTER} SELECT s.view, s.di, c.di_lo, c.di_hi FROM sc s LEFT JOIN (SELECT view, di_lo, di_hi FROM sc WHERE di < 1) c USING (view)", "di di_lo di_hi")
def _(spark, sf):
    s = fx.scatter(spark, sf)
    return s.select("view", "di").join(s.filter("di < 1").select("view", "di_lo", "di_hi"), "view", "left")


@query("tbl_st15", f"WITH {_MASTER} SELECT view, model, saf_mean, var_mean FROM ms WHERE k_pct = 10", "saf_mean var_mean")
def _(spark, sf):
    return master(spark, sf).filter("k_pct = 10").select("view", "model", "saf_mean", "var_mean")


@query("tbl_fix_filter", "WITH u AS (SELECT 'a' AS table_source, n_name AS name, NULL AS empty FROM nation UNION ALL SELECT 'b', r_name, NULL FROM region) SELECT table_source, name FROM u WHERE table_source = 'a'")
def _(spark, sf):
    parts = {"a": fx.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("empty")), "b": fx.table(spark, sf, "region").select(F.col("r_name").alias("name"))}
    return transform.drop_all_null(transform.union_tagged(parts).filter("table_source = 'a'"))


@query("tbl_fix_all_na", "SELECT r_regionkey, r_name FROM region", "", "r_regionkey")
def _(spark, sf):
    return transform.drop_all_null(fx.table(spark, sf, "region").withColumn("nothing", F.lit(None).cast("double")).select("r_regionkey", "r_name", "nothing"))


@query("set_union_tagged", "SELECT 'nation' AS table_source, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region", "", "region")
def _(spark, sf):
    n, r = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    return transform.union_tagged({"nation": n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "region": r.select(F.col("r_name").alias("name"))}).select("table_source", "name", "region")


@query("set_union_concat", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(spark, sf):
    return fx.table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(fx.table(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("tbl_convergence", f"WITH {FEATURES_SQL}, g AS (SELECT count(*) FILTER (v_rank <= 12 AND eta_rank <= 12) / CAST(count(*) FILTER (v_rank <= 12 OR eta_rank <= 12) AS DOUBLE) AS gj FROM vp), p AS (SELECT substr(feature, 1, 3) AS s, max(CAST(v_rank <= 12 AS INT)) AS a, max(CAST(eta_rank <= 12 AS INT)) AS b FROM vp GROUP BY s), q AS (SELECT sum(a * b) / CAST(sum(greatest(a, b)) AS DOUBLE) AS pj FROM p) SELECT gj AS gene_jaccard, pj AS pathway_jaccard, CASE WHEN gj > 0 THEN pj / gj END AS convergence FROM g, q", "gene_jaccard pathway_jaccard convergence")
def _(spark, sf):
    vp = fx.vp(spark, sf)
    a, b = F.col("v_rank") <= 12, F.col("eta_rank") <= 12
    g = vp.agg(overlap.jaccard(a, b, None).alias("gene_jaccard"))
    p = vp.groupBy(F.substring("feature", 1, 3).alias("s")).agg(F.max(a).alias("a"), F.max(b).alias("b")).agg(overlap.jaccard(F.col("a"), F.col("b"), None).alias("pathway_jaccard"))
    return g.join(p).withColumn("convergence", F.when(F.col("gene_jaccard") > 0, F.col("pathway_jaccard") / F.nullif("gene_jaccard", F.lit(0.0))))


@query("tbl_perm_vs_shap", f"WITH {FEATURES_SQL}, c AS (SELECT view, feature, v_rank, fis_rank FROM vp WHERE feature >= 'f010') SELECT k, count(*) FILTER (v_rank <= k AND fis_rank <= k) / CAST(count(*) FILTER (v_rank <= k OR fis_rank <= k) AS DOUBLE) AS j FROM c, unnest([10, 20, 30]) t(k) GROUP BY k", "j", "k")
def _(spark, sf):
    rows = fx.vp(spark, sf).filter("feature >= 'f010'").withColumn("k", F.explode(F.array(*map(F.lit, (10, 20, 30)))))
    return rows.groupBy("k").agg(overlap.jaccard(F.col("v_rank") <= F.col("k"), F.col("fis_rank") <= F.col("k")).alias("j"))


@query("tbl_di_forest", f"WITH {SCATTER} SELECT dataset, avg(di) AS mean, quantile_cont(di, 0.5) AS median, quantile_cont(di, 0.025) AS lo, quantile_cont(di, 0.975) AS hi FROM sc GROUP BY dataset", "mean median lo hi")
def _(spark, sf):
    p = F.percentile("di", F.array(*map(F.lit, (0.5, 0.025, 0.975))))
    return fx.scatter(spark, sf).groupBy("dataset").agg(F.avg("di").alias("mean"), p[0].alias("median"), p[1].alias("lo"), p[2].alias("hi"))


@query("tbl_modality_dumbbell", f"WITH {SCATTER} SELECT substr(view, 1, 1) AS modality, count(DISTINCT dataset) AS n_datasets, min(di) AS lo, max(di) AS hi FROM sc GROUP BY modality HAVING count(DISTINCT dataset) > 1", "lo hi", "n_datasets")
def _(spark, sf):
    return fx.scatter(spark, sf).groupBy(F.substring("view", 1, 1).alias("modality")).agg(F.countDistinct("dataset").alias("n_datasets"), F.min("di").alias("lo"), F.max("di").alias("hi")).filter("n_datasets > 1")


@query("tbl_perm_raincloud", f"WITH {SCATTER} SELECT view, (di_hi - di_lo) / (2 * 1.645) AS null_sd FROM sc", "null_sd")
def _(spark, sf):
    return fx.scatter(spark, sf).select("view", ((F.col("di_hi") - F.col("di_lo")) / (2 * 1.645)).alias("null_sd"))


@query("tbl_zone_consistency", f"WITH {SCATTER}, z AS (SELECT view, {_DI_ZONE} AS a, {_DI_ZONE_CI} AS b FROM sc) SELECT view, a, b FROM z WHERE a <> b")
def _(spark, sf):
    z = fx.scatter(spark, sf).select("view", rules.di_zone(F.col("di"), 0.9, 1.0).alias("a"), rules.di_zone(F.col("di"), 0.9, 1.0, F.col("di_lo"), F.col("di_hi")).alias("b"))
    return z.filter("a <> b")


for _name in ("set_except", "join_feature_set_equality"):

    @query(_name, "SELECT name, side FROM (SELECT n_name AS name, 'left_only' AS side FROM nation WHERE n_nationkey % 3 <> 0 EXCEPT SELECT n_name, 'left_only' FROM nation WHERE n_nationkey % 2 = 0) UNION ALL (SELECT n_name, 'right_only' FROM nation WHERE n_nationkey % 2 = 0 EXCEPT SELECT n_name, 'right_only' FROM nation WHERE n_nationkey % 3 <> 0)")
    def _(spark, sf):
        n = fx.table(spark, sf, "nation")
        a = n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"))
        b = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
        return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))


@query("rank_unit_hash", f"SELECT n_name, {UNIT.format('n_name')} AS u FROM nation", "u")
def _(spark, sf):
    return fx.table(spark, sf, "nation").select("n_name", resample.unit(F.col("n_name")).alias("u"))


_DRAWN = "concat_ws('|', 6, draw, i)"
_BOOT_FIT = f"nb AS (SELECT *, row_number() OVER (ORDER BY view) AS i, count(*) OVER () AS m FROM sc), bt AS (SELECT draw, CAST(floor(({UNIT.format(_DRAWN)}) * m) + 1 AS INT) AS i FROM nb, range(0, 500) t(draw)), bf AS (SELECT draw, regr_intercept(delta, di) AS a, regr_slope(delta, di) AS b FROM bt JOIN nb USING (i) GROUP BY draw)"


def boot_lines(scatter):
    """intercept and slope of 500 bootstrap draws of the scatter."""
    return resample.bootstrap(scatter, [], 500, 6, "view").groupBy("draw").agg(*stats.ols(F.col("di"), F.col("delta"))[1:3])
