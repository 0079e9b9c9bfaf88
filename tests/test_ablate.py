"""Ablation units against plain loops, the learner's properties, and readers that queries don't reach."""

import numpy as np
import pytest

from featherlens.operators import ablate, trees, folds, learn
from featherlens.sources import readers


def made(n=90, p=12):
    """Two features tell the classes apart, others vary more and tell nothing."""
    rng = np.random.default_rng(4)
    y = np.arange(n) % 3
    x = rng.normal(0, 3, (n, p))
    x[:, :2] = rng.normal(0, 0.2, (n, 2)) + np.stack([2.0 * y, (y == 1) * 3.0], 1)
    return x, y


@pytest.fixture(scope="module")
def tables(spark):
    x, y = made()
    values = spark.createDataFrame([(i, f"f{j:02d}", float(x[i, j]), int(y[i])) for i in range(len(x)) for j in range(x.shape[1])], "sample_id long, feature string, x double, label long")
    fold = spark.createDataFrame([(r, i, (i // 3 + r) % 3) for r in range(2) for i in range(len(x))], "repeat int, sample_id long, fold long")
    return values, fold, x, y


def test_learner():
    x, y = made()
    m = ablate.Softmax(x, y, np.unique(y))
    assert ablate.balanced_accuracy(y, m.predict(x)) > 0.95
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    p = trees.shares(z @ m.w)
    grad = z.T @ ((p - (y[:, None] == np.arange(3))) / len(y)) + ablate.RIDGE * np.append(np.ones(x.shape[1]), 0)[:, None] * m.w
    assert np.abs(grad).max() < 1e-3  # at the optimum
    w = m.w[:-1] - m.w[:-1].mean(1, keepdims=True)
    slow = [np.mean([abs(w[j, c] * (x[i, j] - x[:, j].mean()) / x[:, j].std()) for i in range(len(x)) for c in range(3)]) for j in range(x.shape[1])]
    assert m.mean_abs_shap(x) == pytest.approx(slow)


def test_rankings_and_counts():
    x, y = made()
    names = [f"f{j:02d}" for j in range(x.shape[1])]
    r = ablate.rankings(x, y, names, np.unique(y))
    assert set(r["saf"][:2]) == set(r["shap"][:2]) == {0, 1} and not {0, 1} & set(r["var"][:5])
    assert [ablate.k_features(64, 10, rule) for rule in ("floor", "ceil", "round")] == [6, 7, 6] and ablate.k_features(3, 1, "floor") == 1
    assert ablate.drawn(names, 4, 0, 1) == ablate.drawn(names, 4, 0, 1) != ablate.drawn(names, 4, 0, 2)


def test_ablation_equals_plain_loops(spark, tables):
    values, fold, x, y = tables
    got = {(r.k_pct, r.strategy, r.repeat): (r.n_features, r.balanced_accuracy) for r in ablate.ablation(values, fold, [20, 50], 3).collect()}
    names = [f"f{j:02d}" for j in range(x.shape[1])]
    ranks, classes = ablate.rankings(x, y, names, np.unique(y)), np.unique(y)
    of = np.array([[(i // 3 + r) % 3 for i in range(len(x))] for r in range(2)])

    def score(at, r, f):
        train = of[r] != f
        return ablate.balanced_accuracy(y[~train], ablate.Softmax(x[train][:, at], y[train], classes).predict(x[~train][:, at]))

    assert len(got) == 2 * 5 * 2
    for (k_pct, strategy, r), (n, value) in got.items():
        k = round(12 * k_pct / 100)
        if strategy == "random":
            want = np.mean([score(ablate.drawn(names, k, 0, r, f, k_pct, d), r, f) for f in range(3) for d in range(3)])
        else:
            want = np.mean([score(list(range(12)) if strategy == "all" else ranks[strategy][:k], r, f) for f in range(3)])
        assert n == (12 if strategy == "all" else k) and value == pytest.approx(want)
    best = {s: got[20.0, s, 0][1] for s in ("saf", "shap", "var", "all")}
    assert min(best["saf"], best["shap"], best["all"]) > 0.9 > 0.6 > best["var"]


def test_permutations_and_subsets(spark, tables):
    values, fold, x, y = tables
    rows = ablate.label_permutations(values, fold, [20], 3).collect()
    real = [r.balanced_accuracy for r in rows if r.perm == -1 and r.strategy == "all"][0]
    null = [r.balanced_accuracy for r in rows if r.perm >= 0 and r.strategy == "all"]
    assert real > 0.9 and len(null) == 3 and max(null) < 0.6
    assert sorted(ablate.permuted(y, np.arange(len(y)), 1)) == sorted(y)
    r = ablate.subset_scores(values, fold, [20], 4).first()
    assert r.n_features == 3 and r.delta == pytest.approx(r.topvar - r.random) and r.delta < 0
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError):
        m.setattr(ablate, "MAX_CELLS", 10)
        ablate.subset_scores(values, fold, [20], 4)


def test_the_softmax_takes_larger_matrices(spark, tables, monkeypatch):
    values, fold, _, _ = tables
    want = sorted(ablate.label_permutations(values, fold, [20], 1).collect())
    monkeypatch.setattr(ablate, "MAX_CELLS", 600)
    assert sorted(ablate.label_permutations(values, fold, [20], 1).collect()) == want
    with pytest.raises(ValueError):
        ablate.scores(values, fold, [20], ("var",), 0, learners=("rf",))


def test_splits_components_and_silhouette(spark, tables):
    values, fold, x, y = tables
    s = spark.createDataFrame([(i, "ab"[i % 2], i % 4) for i in range(40)], "sample_id long, label string, group_id long")
    assert folds.feasible_group_splits(s, 5).first().n_splits == 4  # with two folds, each has one class alone
    assert folds.feasible_group_splits(s.filter("group_id < 2"), 5).first().n_splits is None
    data, _ = learn.vectors(values)
    r = learn.pc_class_signal(data, 3).first()
    c = x - x.mean(0)
    _, sv, vt = np.linalg.svd(c, full_matrices=False)
    share, z = sv**2 / (sv**2).sum(), c @ vt.T
    eta = [sum((y == k).mean() * (z[y == k, j].mean()) ** 2 for k in range(3)) / z[:, j].var() for j in range(3)]
    assert r.weighted_sum == pytest.approx((share[:3] * eta).sum(), rel=1e-6) and r.weighted_mean == pytest.approx((share[:3] * eta).sum() / share[:3].sum(), rel=1e-6)
    perms = {r.perm: r.pcla for r in learn.pcla_of_permutations(data, 3, 4).collect()}
    assert sorted(perms) == [-1, 0, 1, 2, 3] and perms[-1] == pytest.approx(r.weighted_mean)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    a = [d[i, (y == y[i]) & (np.arange(len(y)) != i)].mean() for i in range(len(y))]
    b = [min(d[i, y == k].mean() for k in range(3) if k != y[i]) for i in range(len(y))]
    want = np.mean([(q - p) / max(p, q) for p, q in zip(a, b, strict=True)])
    assert learn.silhouette(data.withColumn("prediction", data["label"].cast("int"))).first().silhouette == pytest.approx(want, rel=1e-6)


def test_reader_edges(spark, tmp_path):
    v = spark.createDataFrame([("a", i, "f", 1.0) for i in range(5)] + [("b", i, "f", 1.0) for i in range(1, 5)] + [("c", 9, "f", 1.0)], "view string, sample_id long, feature string, x double")
    kept = readers.views_with_common_samples(v, 3).collect()
    assert {r.view for r in kept} == {"a", "b"} and {r.sample_id for r in kept} == {1, 2, 3, 4}
    assert readers.views_with_common_samples(v, 100).count() == 0
    m = readers.chunked_moments(spark.createDataFrame([(1.0, None), (2.0, float("nan")), (4.0, 3.0)], "a double, b double").repartition(3), ["a", "b"], 1)
    assert {(r.feature, r.n, round(r["mean"], 6), round(r.variance, 6)) for r in m.collect()} == {("a", 3, 2.333333, 1.555556), ("b", 1, 3.0, 0.0)}
    for name in ("model_a", "model_b"):
        (tmp_path / name / "importance__ds__rna").mkdir(parents=True)
        (tmp_path / name / "importance__ds__rna" / "x.csv").write_text("1\n")
    assert [tuple(r) for r in readers.discover_predictions(spark, str(tmp_path)).collect()] == [("model_a", "ds", "rna"), ("model_b", "ds", "rna")]


def test_the_driver_gets_an_array_a_sample(spark, monkeypatch):
    """Missing cells, nulls and values that single precision can't hold, against the cells themselves."""
    cells = [(i, f"f{j:02d}", None if i == 2 and j == 1 else i + j / 10, i % 3) for i in range(9) for j in range(12) if (i, j) not in {(4, 0), (4, 11), (7, 5)}]
    df, sent = spark.createDataFrame(cells, "sample_id long, feature string, x double, label int").repartition(5), []
    whole = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: sent.append(whole(self)) or sent[-1])
    m = ablate.Matrix.of(df)
    assert [t.num_rows for t in sent] == [9]
    want = np.zeros((9, 12))
    for i, f, x, _ in cells:
        want[i, int(f[1:])] = x or 0.0
    assert m.ids.tolist() == list(range(9)) and m.names == [f"f{j:02d}" for j in range(12)] and m.y.tolist() == [i % 3 for i in range(9)]
    assert m.x.dtype == np.float64 and (m.x == want).all()
    short = ablate.Matrix.of(df.withColumn("x", (df.x * 10).cast("int").cast("double") / 4))
    assert short.x.dtype == np.float32 and short.part(np.ones(9, bool), [3]).dtype == np.float64
    assert ablate.Matrix.of(df.limit(0)).x.shape == (0, 0)
