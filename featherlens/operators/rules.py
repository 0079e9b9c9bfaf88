"""Decision rules as column expressions, and threshold scans over a scatter of (di, delta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regime(di: Column, coupled: float = 0.85, anti: float = 1.05, middle: str = "DECOUPLED", closed: bool = False) -> Column:
    """COUPLED under coupled, ANTI_ALIGNED over anti (or from it on, if closed), else middle; NULL stays UNKNOWN."""
    above = di >= anti if closed else di > anti
    return F.when(di.isNull(), "UNKNOWN").when(above, "ANTI_ALIGNED").when(di < coupled, "COUPLED").otherwise(middle)


def regime_with_gain(di: Column, delta_j: Column, rho: Column, stability: Column, eps: float = 0.01, rho_eps: float = 0.05, stable: float = 0.5) -> Column:
    """Any overlap above chance with any positive correlation is COUPLED; near nothing counts only if it is stable."""
    return (
        F.when(di > 1, "ANTI_ALIGNED")
        .when((di <= 1) & (delta_j > 0) & (rho > 0), "COUPLED")
        .when((F.abs(delta_j) <= eps) & (F.abs(rho) <= rho_eps) & (stability >= stable), "DECOUPLED")
        .otherwise("MIXED")
    )


def regime_two_point(di_10: Column, dj_10: Column, di_last: Column, dj_last: Column, coupled: float = 0.10, share: float = 0.85, anti: float = 1.11, below: float = 0.10) -> Column:
    """From the overlap at K = 10 and at the largest K."""
    return F.when((dj_10 >= coupled) & (di_10 <= share), "COUPLED").when((dj_last <= -below) & (di_last >= anti), "ANTI_ALIGNED").otherwise("DECOUPLED")


def sign_eps(x: Column, eps: float) -> Column:
    return F.when(x.isNull(), None).when(x > eps, 1).when(x < -eps, -1).otherwise(0)


#: The calls that tables of results hold.
RED, GREEN, YELLOW = "RED_HARMFUL", "GREEN_SAFE", "YELLOW_INCONCLUSIVE"
DECOUPLED, ALIGNED, INCONCLUSIVE = "VARIANCE_SIGNAL_DECOUPLED", "VARIANCE_SIGNAL_ALIGNED", "INCONCLUSIVE"
BOOSTING, BAGGING = ["xgb", "hgb", "gbc"], ["rf", "extratrees"]


def vad_zone(eta_es: Column, vsa: Column, es_lo: Column, es_hi: Column, vsa_lo: Column, vsa_hi: Column, margin: float = 0.05) -> Column:
    """By confidence limits where all four are there; else a margin around 1 for eta_es and the sign of vsa."""
    ci = es_lo.isNotNull() & es_hi.isNotNull() & vsa_lo.isNotNull() & vsa_hi.isNotNull()
    red = F.when(ci, (es_hi < 1) & (vsa_hi < 0)).otherwise((eta_es < 1 - margin) & (vsa < 0))
    green = F.when(ci, (es_lo > 1) & (vsa_lo > 0)).otherwise((eta_es > 1 + margin) & (vsa > 0))
    return F.when(red, RED).when(green, GREEN).otherwise(YELLOW)


def diagnostic_state(eta_es: Column, vsa: Column) -> Column:
    return (
        F.when(eta_es.isNull() | vsa.isNull(), "UNKNOWN")
        .when((eta_es < 1) & (vsa < 0), DECOUPLED)
        .when((eta_es > 1) & (vsa > 0), ALIGNED)
        .otherwise(INCONCLUSIVE)
    )


def nominal_zone(state: Column) -> Column:
    return F.when(state == DECOUPLED, "RED_RISK").when(state == ALIGNED, "GREEN_SAFE").when(state == INCONCLUSIVE, YELLOW).otherwise("UNKNOWN")


def promising(state: Column, zone: Column) -> Column:
    """Worth an ablation: not aligned, and not excluded as a strong green."""
    return state.isin(DECOUPLED, INCONCLUSIVE) & (zone != "STRONG_GREEN_EXCLUDE")


def risk_score(eta_es: Column, vsa: Column, state: Column, zone: Column) -> Column:
    """Shortfall of eta_es (at most 2, times 3), of vsa (at most 0.5, times 6), 5 for a decoupled state, less 3 for a strong green."""
    short = lambda c, most, by: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(most)) * by
    return short(1 - eta_es, 2.0, 3) + short(-vsa, 0.5, 6) + F.when(state == DECOUPLED, 5.0).otherwise(0.0) - F.when(zone == "STRONG_GREEN_EXCLUDE", 3.0).otherwise(0.0)


def di_zone(di: Column, safe: float, harm: float, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Closed limits on the value; open ones on its confidence limits, if given."""
    if lo is None:
        return F.when(di <= safe, "SAFE").when(di >= harm, "HARMFUL").otherwise("INCONCLUSIVE")
    return F.when(hi < safe, "SAFE").when(lo > harm, "HARMFUL").otherwise("INCONCLUSIVE")


def risk(regime_: Column, agreement: Column, stable: Column) -> Column:
    """HIGH asks for all models and stability, OK for half of the models and stability, NEUTRAL for stability."""
    sure = F.coalesce(stable, F.lit(False))
    return (
        F.when((regime_ == "ANTI_ALIGNED") & (agreement >= 1) & sure, "HIGH")
        .when((regime_ == "COUPLED") & (agreement >= 0.5) & sure, "OK")
        .when((regime_ == "DECOUPLED") & sure, "NEUTRAL")
        .otherwise("UNCERTAIN")
    )


def harm_verdict(delta_pp: Column) -> Column:
    return F.when(delta_pp.isNull(), None).when(delta_pp <= -5, "CONFIRMED_HARM").when(delta_pp < -1, "MILD_HARM").when(F.abs(delta_pp) <= 1, "TIE").otherwise("TOPVAR_HELP")


def panel_call(delta_pp: dict[str, Column], state: Column) -> Column:
    """One verdict from a panel of tree models; NULL differences are models that weren't run."""
    count = lambda models, test: sum((F.when(test(delta_pp[m]), 1).otherwise(0) for m in models if m in delta_pp), F.lit(0))
    there, harmful = (lambda d: d.isNotNull()), (lambda d: d <= -5)
    half = lambda n: F.greatest(F.lit(2), F.ceil(n / 2))
    n, harm, boosted = count(delta_pp, there), count(delta_pp, harmful), count(BOOSTING, there)
    xgb = F.coalesce(delta_pp["xgb"] <= -5, F.lit(False))
    return (
        F.when(n == 0, F.when(state.isin(DECOUPLED), DECOUPLED + "_ONLY").when(state.isin(ALIGNED), ALIGNED).otherwise(INCONCLUSIVE))
        .when(xgb & (harm >= 3), "TREE_PANEL_CONFIRMED_HARM")
        .when(xgb & (count(BOOSTING, harmful) >= half(boosted)), "BOOSTING_FAMILY_CONFIRMED_HARM")
        .when(xgb, "XGB_CONFIRMED_HARM_MODEL_DEPENDENT")
        .when(harm >= 2, "NON_XGB_TREE_HARM_CHECK_REQUIRED")
        .when(count(delta_pp, lambda d: d > 1) >= half(n), "TOPVAR_HELP_TREE_PANEL")
        .when(state == DECOUPLED, DECOUPLED + "_ONLY")
        .when(count(delta_pp, lambda d: d < -1) > 0, "MILD_OR_MODEL_SPECIFIC_HARM")
        .when(state == ALIGNED, ALIGNED)
        .otherwise(INCONCLUSIVE)
    )


def predicts_harm(metric: Column, x: Column) -> Column:
    """By the metric's own boundary; NULL for one without."""
    return F.when(metric == "pcla", None).when(metric == "eta_es", x < 1).when(metric == "f_di", x > 1).otherwise(x < 0)


def sign_metrics(rows: DataFrame, keys: list[str], metric: str = "metric", x: str = "x", y: str = "y") -> DataFrame:
    """keys, metric, n, accuracy, sensitivity, specificity of predicting y < 0; NULL for fewer than three rows."""
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    p, bad = predicts_harm(F.col(metric), F.col(x)), F.col(y) < 0
    num = lambda c: c.cast("double")
    s = ok.groupBy(*keys, metric).agg(F.count("*").alias("n"), F.avg(num(p == bad)).alias("accuracy"), F.avg(F.when(bad, num(p))).alias("sensitivity"), F.avg(F.when(~bad, num(~p))).alias("specificity"))
    return s.withColumns({c: F.when(F.col("n") >= 3, F.col(c)) for c in ("accuracy", "sensitivity", "specificity")})


def majority(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """consensus and confidence: the most frequent label, the first by name among ties; exactly half is MIXED with 0.5."""
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    n = n.withColumns({"share": F.col("c") / F.sum("c").over(by), "n": F.row_number().over(by.orderBy(F.desc("c"), label))})
    return n.filter("n = 1").select(*keys, F.when(F.col("share") == 0.5, "MIXED").otherwise(F.col(label)).alias("consensus"), F.col("share").alias("confidence"))


def candidates(scatter: DataFrame, x: str = "di", keys: list[str] | None = None) -> DataFrame:
    """Cut points: distinct values to six places, the middles between neighbours, and one just outside either end."""
    keys = keys or []
    v = scatter.select(*keys, F.round(x, 6).alias("t")).distinct()
    mid = v.withColumn("t", (F.col("t") + F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))) / 2).filter("t is not null")
    ends = v.groupBy(*keys).agg(F.array(F.min("t") - 1e-6, F.max("t") + 1e-6).alias("e")).select(*keys, F.explode("e").alias("t"))
    return v.unionByName(mid).unionByName(ends).filter("t is not null").distinct()


def threshold_scan(scatter: DataFrame, harm: float, ratios: list[float], x: str = "di", delta: str = "delta", keys: list[str] | None = None) -> DataFrame:
    """Confusion counts, sensitivity, specificity and utility of calling x >= t harmful, for each cut point and cost ratio.

    Utility is the mean cost with its sign turned: a missed harm costs the ratio, a false alarm one. keys: a scan for each
    of them. Rows without x or delta don't count. One pass over the scatter per cut point would square it, so both sides
    are counted once per distinct value and summed by a window over the cut points.
    """
    keys = keys or []
    known = scatter.filter(F.col(x).isNotNull() & F.col(delta).isNotNull())
    bad = (F.col(delta) < -harm).cast("long")
    none = F.lit(0).cast("long")
    # a point is called harmful by every cut at or under it
    cuts = candidates(known, x, keys).select(*keys, "t", none.alias("p"), none.alias("q"), F.lit(True).alias("cut"))
    marks = known.select(*keys, F.col(x).alias("t"), bad.alias("p"), (1 - bad).alias("q"), F.lit(False).alias("cut")).unionByName(cuts)
    sums = marks.groupBy(*keys, "t").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.max("cut").alias("cut"))
    every = Window.partitionBy(*keys)
    up = every.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    s = sums.select(*keys, "t", "cut", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("q").over(every).alias("neg")).filter("cut")
    s = s.withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")}).withColumn("cost_ratio", F.explode(F.array(*map(F.lit, ratios))))
    cost = F.col("cost_ratio") * F.col("fn") + F.col("fp")
    return s.select(*keys, "t", "cost_ratio", "tp", "fp", "fn", "tn", F.try_divide("tp", "pos").alias("sensitivity"), F.try_divide("tn", "neg").alias("specificity"), (-cost / (F.col("pos") + F.col("neg"))).alias("utility"))


def best_threshold(scan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The cut with the highest utility for each cost ratio; the smallest among ties."""
    order = Window.partitionBy(*(keys or []), "cost_ratio").orderBy(F.desc(F.round("utility", 9)), "t")
    return scan.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def pick_thresholds(scan: DataFrame, sensitivity: float = 0.9, specificity: float = 0.9) -> DataFrame:
    """cost_ratio, t_opt, t_safe, t_harm: the highest cut that is sensitive, the lowest that is specific.

    One that doesn't exist is t_opt; both are if they cross.
    """
    best = F.min(F.struct((-F.round("utility", 9)).alias("u"), F.col("t"))).getField("t")
    safe, harm = F.max(F.when(F.col("sensitivity") >= sensitivity, F.col("t"))), F.min(F.when(F.col("specificity") >= specificity, F.col("t")))
    s = scan.groupBy("cost_ratio").agg(best.alias("t_opt"), safe.alias("_s"), harm.alias("_h"))
    crossed = F.coalesce(F.col("_s") > F.col("_h"), F.lit(False))
    pick = lambda c: F.when(crossed, F.col("t_opt")).otherwise(F.coalesce(c, "t_opt"))
    return s.select("cost_ratio", "t_opt", pick("_s").alias("t_safe"), pick("_h").alias("t_harm"))


def transferred(scatter: DataFrame, harm: float, ratio: float, group: str = "dataset", x: str = "di", delta: str = "delta") -> DataFrame:
    """held, t, n, n_correct, accuracy: each group judged by the best cut of all the others, in one scan keyed by the group left out."""
    held = scatter.select(F.col(group).alias("held")).distinct()
    train = scatter.join(held, F.col(group) != F.col("held"))
    best = best_threshold(threshold_scan(train, harm, [ratio], x, delta, ["held"]), ["held"]).select(F.col("held").alias(group), "t")
    right = ((F.col(x) >= F.col("t")) == (F.col(delta) < -harm)).cast("long")
    s = scatter.join(best, group).groupBy(F.col(group).alias("held"), "t").agg(F.count("*").alias("n"), F.sum(right).alias("n_correct"))
    return s.withColumn("accuracy", F.col("n_correct") / F.col("n"))


#: Dead zone of signs, bounds of the categories, weights of the scores.
HERO_EPS, HERO_GAP = 0.005, 0.02


def hero_rank(rows: DataFrame) -> DataFrame:
    """rows with agree, validated, tier, category, score and rank: which views make the strongest case.

    rows: dataset, view; dvr_xgb, dvr_rf (variance minus random by model), dsv_xgb (importance minus variance), di,
    perf_var, perf_random; dvr_lo, dvr_hi, dsv_lo, dsv_hi (limits under permuted labels); convergence. NULL means that a
    part is missing, which never counts for a view. Tiers: models that agree in sign outside the dead zone, an effect
    outside the permutation limits, and biology at hand; all three are HIGH, two of them MEDIUM.
    """
    col = F.col
    yes = lambda c: F.coalesce(c, F.lit(False))
    outside = lambda x, lo, hi: yes(col(x) < col(lo)) | yes(col(x) > col(hi))
    a, b = sign_eps(col("dvr_xgb"), HERO_EPS), sign_eps(col("dvr_rf"), HERO_EPS)
    rows = rows.withColumns({"agree": yes((a != 0) & (a == b)), "validated": outside("dvr_xgb", "dvr_lo", "dvr_hi") | outside("dsv_xgb", "dsv_lo", "dsv_hi")})
    held = col("agree").cast("int") + col("validated").cast("int") + col("convergence").isNotNull().cast("int")
    dvr, dsv = col("dvr_xgb"), col("dsv_xgb")
    category = F.when((dvr < -HERO_GAP) & (dsv > HERO_GAP), "ANTI_ALIGNED").when((dvr > HERO_GAP) & (F.abs(dsv) < HERO_GAP), "COUPLED").otherwise("MIXED")
    plus = lambda c: F.greatest(F.lit(0.0), c)
    anti = plus(-dvr) * 2.0 + plus(dsv) * 1.5 + F.coalesce(col("di"), F.lit(0.0)) * 0.2
    coupled = plus(dvr) * 2.0 + plus(col("perf_var") - col("perf_random")) + plus(0.05 - F.abs(dsv)) * 0.5
    rows = rows.withColumns({"tier": F.when(held == 3, "HIGH").when(held == 2, "MEDIUM").otherwise("LOW"), "category": category})
    rows = rows.withColumn("score", F.when(col("category") == "ANTI_ALIGNED", anti).when(col("category") == "COUPLED", coupled).otherwise((anti + coupled) / 2))
    order = Window.partitionBy("category").orderBy(F.desc(F.round("score", 9)), "dataset", "view")
    return rows.withColumn("rank", F.row_number().over(order))


def first_known(base: DataFrame, sources: list[tuple[str, DataFrame, list[str], str]], out: str, unknown: str = "UNKNOWN") -> DataFrame:
    """base with out and out_source: the value of the first source, by precedence, that knows the row's key.

    sources: (name, table, key columns, value column); a table has one row a key, NULL values count as not known.
    """
    names = []
    for i, (_, table, keys, value) in enumerate(sources):
        base = base.join(table.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
        names.append(f"_v{i}")
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, (n, *_) in zip(names, sources, strict=True)], F.lit("none"))
    return base.withColumns({out: F.coalesce(*names, F.lit(unknown)), f"{out}_source": source}).drop(*names)
