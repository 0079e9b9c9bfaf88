"""Hand-computed and property tests of the operators."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featherlens.operators import folds, moments, overlap, ranking, resample, rules, stats, transform

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = "sample_id long, feature string, x double, label long"


def long(spark, rows):
    return spark.createDataFrame([("v", *r) for r in rows], "view string, " + VALUES)


def test_eta2_by_hand(spark):
    rows = [(i, "a", float(i), i // 2) for i in range(4)] + [(i, "b", 1.0, i // 2) for i in range(4)] + [(i, "c", float("nan"), i // 2) for i in range(4)]
    got = {r.feature: r for r in moments.eta2(long(spark, rows), ["view"]).collect()}
    assert got["a"].v_total == pytest.approx(1.25) and got["a"].v_between == pytest.approx(1.0) and got["a"].eta_sq == pytest.approx(0.8)
    assert got["b"].eta_sq == 0.0
    assert got["c"].v_total is None


@few
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-100, 100)), min_size=2, max_size=30))
def test_parts_sum_to_total(spark, rows):
    d = moments.decomposition(long(spark, [(i, "f", x, c) for i, (c, x) in enumerate(rows)]), ["view"]).first()
    assert d.var_between + d.var_within == pytest.approx(d.var_total, abs=1e-6) and 0 <= d.r_frac <= 1 + 1e-9


def test_k_rules(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 25, 50, 64)], "n long")
    got = df.select("n", *[ranking.k_count(F.col("n"), F.lit(10), r).alias(r) for r in ("floor", "ceil", "round")]).collect()
    assert [(r.floor, r.ceil, r.round) for r in got] == [(1, 1, 1), (1, 1, 1), (2, 3, 2), (5, 5, 5), (6, 7, 6)]
    assert df.select(ranking.k_count(F.col("n"), F.lit(100)).alias("k")).collect()[0].k == 1


def test_ties(spark):
    df = spark.createDataFrame([("v", "a", 1.0), ("v", "b", 2.0), ("v", "c", 2.0), ("v", "d", 3.0)], "view string, feature string, s double")
    rank = lambda tie: {r.feature: r["rank"] for r in ranking.ranked(df, ["view"], "s", tie).collect()}
    assert rank("name") == {"d": 1, "b": 2, "c": 3, "a": 4}
    assert rank("average") == {"d": 1, "b": 2.5, "c": 2.5, "a": 4}
    assert rank("min") == {"d": 1, "b": 2, "c": 2, "a": 4}
    with pytest.raises(ValueError):
        rank("other")


@pytest.mark.parametrize("reverse", [False, True])
def test_di_extremes(spark, reverse):
    rows = [("v", f"f{i:02d}", i + 1, 40 - i if reverse else i + 1) for i in range(40)]
    g = overlap.k_grid(spark.createDataFrame(rows, "view string, feature string, v long, p long"), ["view"], "v", "p", [10, 20]).collect()
    for r in g:
        jr = r.q / (2 - r.q)
        assert r.di == pytest.approx(1 / (1 - jr) if reverse else 0.0) and 0 <= r.di <= 1 / (1 - jr) + 1e-12
        assert 1 - r.tilde_j == pytest.approx(r.di)


def test_bh(spark):
    df = spark.createDataFrame([("v", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.5, 0.5])], "view string, id string, p double")
    q = {r.id: r.fdr for r in stats.bh_fdr(df, ["view"]).collect()}
    assert q["0"] == pytest.approx(0.05) and q["2"] == q["1"] == pytest.approx(0.04 * 5 / 3) and q["3"] is None and q["4"] == pytest.approx(0.5)


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([("v", str(i), 1.0, float(i)) for i in range(5)], "view string, feature string, a double, b double")
    assert stats.spearman(df, ["view"], "a", "b").first().rho is None
    assert stats.spearman(df.limit(2), ["view"], "b", "b").first().rho is None


def test_hypergeometric(spark):
    df = spark.createDataFrame([("s", 20, 5, 6, 3), ("all", 10, 10, 4, 4)], "id string, population long, marked long, drawn long, hits long")
    got = {r.id: r.p for r in stats.hypergeometric_tail(df, ["id"]).collect()}
    want = sum(math.comb(5, x) * math.comb(15, 6 - x) for x in range(3, 6)) / math.comb(20, 6)
    assert got["s"] == pytest.approx(want) and got["all"] == pytest.approx(1.0)


def test_threshold_scan(spark):
    pts = [(0.7, 0.1), (0.8, -0.2), (0.9, 0.0), (1.0, -0.3), (1.0, 0.2)]
    scan = rules.threshold_scan(spark.createDataFrame(pts, "di double, delta double"), 0.05, [1.0]).collect()
    for r in scan:
        assert r.tp == sum(x >= r.t and d < -0.05 for x, d in pts) and r.fn == sum(x < r.t and d < -0.05 for x, d in pts)
        assert r.tp + r.fp + r.fn + r.tn == len(pts)
    ends = [0.7 - 1e-6, 1.0 + 1e-6]
    assert sorted(r.t for r in scan) == pytest.approx(sorted([0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0, *ends]))
    assert all(r.utility == pytest.approx(-(r.fn + r.fp) / 5) for r in scan)


def test_majority_tie(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X"), ("b", "X"), ("b", "Y")], "view string, label string")
    assert {tuple(r) for r in rules.majority(df, ["view"]).collect()} == {("a", "MIXED", 0.5), ("b", "X", 2 / 3)}


def test_missingness_boundary(spark):
    rows = [(i, "keep", None if i < 30 else float(i), 0) for i in range(100)] + [(i, "drop", None if i < 31 else float(i), 0) for i in range(100)] + [(i, "flat", 2.0, 0) for i in range(100)]
    kept, report = transform.missingness(long(spark, rows), ["view"])
    assert {r.feature for r in kept.select("feature").distinct().collect()} == {"keep"}
    assert kept.filter("x is null").count() == 0 and kept.agg(F.min("x")).first()[0] == 30.0
    r = report.first()
    assert (r.n_features, r.n_dropped_missing, r.n_constant) == (3, 1, 1)


def test_permutation_keeps_labels(spark):
    s = spark.createDataFrame([(i, i % 3, i % 4) for i in range(40)], "sample_id long, label long, group_id long")
    p = resample.permuted(s, ["group_id"], "label", 3, 5)
    before = sorted((r.group_id, r.label) for r in s.collect())
    for k in range(3):
        assert sorted((r.group_id, r.label) for r in p.filter(F.col("perm") == k).collect()) == before


def test_bootstrap_sizes(spark):
    s = spark.createDataFrame([(i, i % 3) for i in range(31)], "sample_id long, label long")
    n = resample.bootstrap(s, ["label"], 4, 1).groupBy("draw", "label").count().collect()
    assert {(r.label, r["count"]) for r in n} == {(0, 11), (1, 10), (2, 10)} and len(n) == 12


def test_group_folds_do_not_leak(spark):
    s = spark.createDataFrame([(i, i % 2, i // 5) for i in range(100)], "sample_id long, label long, group_id long")
    g = folds.grouped_greedy(s, 4)
    both = s.join(g, "group_id")
    assert overlap.group_leakage(both, []).count() == 0
    sizes = [r["count"] for r in both.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 5


def test_leakage_found(spark):
    f = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "group_id long, fold long")
    assert [tuple(r) for r in overlap.group_leakage(f, []).collect()] == [(1, 2)]


@pytest.mark.parametrize("op", ["eta2", "decomposition", "fisher"])
def test_empty(spark, op):
    assert getattr(moments, op)(long(spark, []), ["view"]).count() == 0


def test_rules_at_their_limits(spark):
    rows = [(1.0, 0.0, 0.1, 0.6), (1.1, 0.5, 0.5, 0.6), (0.9, 0.005, -0.05, 0.5), (0.9, 0.005, -0.05, 0.4), (0.8, 0.001, 0.001, 0.1)]
    df = spark.createDataFrame(rows, "di double, dj double, rho double, st double")
    got = [r[0] for r in df.select(rules.regime_with_gain(F.col("di"), F.col("dj"), F.col("rho"), F.col("st"))).collect()]
    assert got == ["MIXED", "ANTI_ALIGNED", "DECOUPLED", "MIXED", "COUPLED"]
    two = spark.createDataFrame([(0.85, 0.1, 1.2, -0.2), (0.86, 0.1, 1.11, -0.1), (0.86, 0.1, 1.11, -0.09)], "a double, b double, c double, d double")
    assert [r[0] for r in two.select(rules.regime_two_point(*map(F.col, "abcd"))).collect()] == ["COUPLED", "ANTI_ALIGNED", "DECOUPLED"]
    risky = spark.createDataFrame([("ANTI_ALIGNED", 1.0, True), ("ANTI_ALIGNED", 0.9, True), ("COUPLED", 0.5, True), ("DECOUPLED", 0.0, True), ("DECOUPLED", 1.0, False), ("MIXED", 1.0, True), ("COUPLED", 1.0, None)], "r string, a double, s boolean")
    assert [r[0] for r in risky.select(rules.risk(F.col("r"), F.col("a"), F.col("s"))).collect()] == ["HIGH", "UNCERTAIN", "OK", "NEUTRAL", "UNCERTAIN", "UNCERTAIN", "UNCERTAIN"]


def test_panel_call(spark):
    names = ["xgb", "hgb", "gbc", "rf", "extratrees"]
    cases = [
        ((-6.0, -6.0, 0.0, -7.0, None), "x", "TREE_PANEL_CONFIRMED_HARM"),
        ((-6.0, -6.0, 0.0, 0.0, 0.0), "x", "BOOSTING_FAMILY_CONFIRMED_HARM"),
        ((-5.0, 0.0, 0.0, 0.0, 0.0), "x", "XGB_CONFIRMED_HARM_MODEL_DEPENDENT"),
        ((0.0, -5.0, 0.0, -9.0, 0.0), "x", "NON_XGB_TREE_HARM_CHECK_REQUIRED"),
        ((2.0, 2.0, 2.0, 0.0, 0.0), rules.DECOUPLED, "TOPVAR_HELP_TREE_PANEL"),
        ((0.0, None, None, -2.0, 0.0), rules.DECOUPLED, "VARIANCE_SIGNAL_DECOUPLED_ONLY"),
        ((0.0, None, None, -2.0, 0.0), rules.ALIGNED, "MILD_OR_MODEL_SPECIFIC_HARM"),
        ((0.0, None, None, 0.0, 0.0), rules.ALIGNED, "VARIANCE_SIGNAL_ALIGNED"),
        ((None,) * 5, rules.DECOUPLED, "VARIANCE_SIGNAL_DECOUPLED_ONLY"),
        ((None,) * 5, None, "INCONCLUSIVE"),
    ]
    df = spark.createDataFrame([(*d, s, i) for i, (d, s, _) in enumerate(cases)], ", ".join(f"{n} double" for n in names) + ", s string, i int")
    got = [r[0] for r in df.orderBy("i").select(rules.panel_call({n: F.col(n) for n in names}, F.col("s"))).collect()]
    assert got == [c for _, _, c in cases]


def test_transferred_thresholds(spark):
    pts = [("a", 0.7, 0.1), ("a", 0.9, -0.2), ("b", 0.8, 0.1), ("b", 1.0, -0.3), ("c", 0.6, -0.1), ("c", 1.1, None)]
    df = spark.createDataFrame(pts, "dataset string, di double, delta double")

    def best(train):
        xs = sorted({round(x, 6) for x, _ in train})
        cuts = sorted({*xs, *[(a + b) / 2 for a, b in zip(xs, xs[1:])], xs[0] - 1e-6, xs[-1] + 1e-6})
        return max(cuts, key=lambda t: (-round(sum(5 * (x < t and d < 0) + (x >= t and d >= 0) for x, d in train) / len(train), 9), -t))

    known = [p for p in pts if p[2] is not None]
    got = {r.held: r.t for r in rules.transferred(df.dropna(), 0.0, 5.0).collect()}
    assert got == pytest.approx({h: best([(x, d) for g, x, d in known if g != h]) for h in "abc"})


def test_majority_half_is_mixed(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y"), ("a", "Z")], "view string, label string")
    assert [tuple(r) for r in rules.majority(df, ["view"]).collect()] == [("a", "MIXED", 0.5)]


def test_feature_without_values(spark):
    rows = [(i, "none", None, i % 2) for i in range(4)] + [(i, "some", float(i), i % 2) for i in range(4)]
    got = {r.feature: r for r in moments.eta2(long(spark, rows), ["view"]).collect()}
    assert (got["none"].v_total, got["none"].v_between, got["none"].eta_sq) == (None, None, 0.0)
    assert got["some"].eta_sq == pytest.approx(0.2)


def test_index_of_all_features(spark):
    rows = [("v", f"f{i}", i, 4 - i) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "view string, feature string, a long, b long")
    grid = {r.k_pct: r.di for r in overlap.k_grid(df, ["view"], "a", "b", [34, 100]).collect()}
    assert grid[100] == 1.0 and grid[34] > 1  # nothing left to gain is not below chance
    assert overlap.f_di(df, ["view"], "a", "b", 100).first().f_di == 0.0
    assert overlap.f_di(df.limit(2), ["view"], "a", "b", 10).first().f_di is None


def test_hypergeometric_tail_of_large_populations(spark):
    from math import exp, lgamma

    n, k, d, hits = 200_000, 8_000, 20_000, 850
    log_c = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    want = sum(exp(log_c(k, x) + log_c(n - k, d - x) - log_c(n, d)) for x in range(hits, k + 1))
    rows = spark.createDataFrame([(1, n, k, d, hits), (2, 100, 200, 10, 5)], "id long, population long, marked long, drawn long, hits long")
    got = {r.id: r.p for r in stats.hypergeometric_tail(rows, ["id"]).collect()}
    assert abs(got[1] - want) < 1e-7 and 0.03 < want < 0.031 and got[2] is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_keys_of_rank_correlations_are_spread(spark):
    """Ties, nulls, a null key, one key with most rows; no window over a key."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), float(rng.randint(0, 30)), rng.choice([None, *range(9)])) for _ in range(900)] + [("one", 1.0, 2)]
    df = spark.createDataFrame(rows, "view string, a double, b long")
    found = stats.spearman(df, ["view"], "a", "b")
    assert "Window [rank(" not in plan_of(found) and "windowspecdefinition(view" not in plan_of(found)

    def ranks(v):
        return [sum(y < x for y in v) + (v.count(x) + 1) / 2 for x in v]

    for r in found.collect():
        pairs = [(x, y) for k, x, y in rows if k == r.view and y is not None]
        a, b = (ranks([p[i] for p in pairs]) for i in (0, 1))
        m = (len(pairs) + 1) / 2
        cov = lambda u, v: sum((x - m) * (y - m) for x, y in zip(u, v, strict=True))
        assert r.n == len(pairs) and (r.rho is None if r.n < 3 else r.rho == pytest.approx(cov(a, b) / math.sqrt(cov(a, a) * cov(b, b))))
    whole = stats.spearman(df.filter("view = 'a'"), [], "a", "b").first()
    assert whole.rho == pytest.approx({r.view: r.rho for r in found.collect()}["a"])


def test_hypergeometric_terms_are_not_rows(spark):
    cases = [(30, 12, 9, 0), (30, 12, 9, 4), (30, 12, 9, 9), (30, 12, 9, 10), (30, 25, 20, 3), (10, 10, 10, 10), (10, 0, 4, 0), (10, 0, 4, 1), (5, 6, 2, 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, population long, marked long, drawn long, hits long")
    found = stats.hypergeometric_tail(df, ["id"])
    assert "Generate" not in plan_of(found) and "Exchange" not in plan_of(found)
    for r in found.collect():
        n, k, d, hits = cases[r.id]
        want = sum(math.comb(k, x) * math.comb(n - k, d - x) for x in range(hits, min(k, d) + 1)) / math.comb(n, d) if k <= n else None
        assert r.p is want is None or r.p == pytest.approx(want)


def test_shares_of_large_matrices_are_not_shuffled(spark):
    df = spark.createDataFrame([("s", 0.0), ("s", 0.5), ("m", 2.0), ("m", 0.5)], "feature string, x double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = transform.m_values_where_shares(df, ["feature"])
        assert "SortMergeJoin" not in plan_of(found)
        got = sorted((r.feature, round(r.x, 6)) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("m", 0.5), ("m", 2.0), ("s", round(math.log2(1e-6 / (1 - 1e-6)), 6)), ("s", 0.0)]
