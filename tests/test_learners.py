import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherlens.operators import ablate, boost, folds, learn, linear, trees


def sample(n=160, p=6, classes=3, seed=1, apart=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.round(rng.normal(size=(n, p)) + (np.arange(p) < 2) * apart * y[:, None], 1)
    x[:, 3] = rng.integers(0, 2, n)
    x[:, 4] = 1.0
    return x, y, np.arange(classes)


def plain_tree(codes, g, h, s, depth=0):
    """(value, None) or (value, (feature, cut, left, right)) by trying every cut of every feature."""
    value, best = -g.sum() / (h.sum() + s.l2), None
    if depth < s.depth:
        for f in range(codes.shape[1]):
            for c in range(codes[:, f].max()):
                left = codes[:, f] <= c
                if min(left.sum(), (~left).sum()) < max(1, s.least_rows) or min(h[left].sum(), h[~left].sum()) < s.least_hessian:
                    continue
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
                gain = part(left) + part(~left) - part(np.ones(len(g), bool))
                if gain > max(best[0] + 1e-12 if best else 0.0, trees.LEAST_GAIN):
                    best = (gain, f, c, left)
    if not best:
        return value, None
    _, f, c, left = best
    return value, (f, c, plain_tree(codes[left], g[left], h[left], s, depth + 1), plain_tree(codes[~left], g[~left], h[~left], s, depth + 1))


def unrolled(nodes, i):
    if nodes.feature[i] < 0:
        return nodes.value[i], None
    return nodes.value[i], (nodes.feature[i], nodes.cut[i], unrolled(nodes, nodes.left[i]), unrolled(nodes, nodes.left[i] + 1))


def same(a, b):
    assert a[0] == pytest.approx(b[0], rel=1e-9, abs=1e-12)
    assert (a[1] is None) == (b[1] is None)
    if a[1]:
        assert a[1][:2] == b[1][:2]
        same(a[1][2], b[1][2])
        same(a[1][3], b[1][3])


@pytest.mark.parametrize("cells", [1 << 22, 100])
def test_trees_against_every_cut(monkeypatch, cells):
    monkeypatch.setattr(trees, "CELLS", cells)
    x, y, _ = sample()
    cuts = trees.quantile_cuts(x)
    codes, rng = trees.binned(x, cuts), np.random.default_rng(2)
    grad, hess, use = rng.normal(size=(3, len(y))), rng.uniform(0.1, 1, (3, len(y))), rng.random(len(y)) < 0.8
    for s in (trees.Boosting(depth=4), trees.Boosting(depth=3, least_rows=5, least_hessian=0.0, l2=0.1)):
        nodes = trees.grow(codes, 1 + max(map(len, cuts)), grad, hess, use, s, np.repeat(np.arange(6)[None, :], 3, 0))
        for t in range(3):
            same(unrolled(nodes, t), plain_tree(codes[use], grad[t, use], hess[t, use], s))


def test_best_first_takes_the_highest_gains():
    x, y, _ = sample(300)
    cuts = trees.quantile_cuts(x)
    codes, rng = trees.binned(x, cuts), np.random.default_rng(3)
    grad, hess, use = rng.normal(size=(2, len(y))), np.ones((2, len(y))), np.ones(len(y), bool)
    columns = np.repeat(np.arange(6)[None, :], 2, 0)
    s = replace(trees.BOOSTING["hgb"], depth=8)
    whole = trees.grow(codes, 1 + max(map(len, cuts)), grad, hess, use, replace(s, leaves=None), columns)
    few = trees.grow(codes, 1 + max(map(len, cuts)), grad, hess, use, s, columns)
    for t in range(2):
        front, taken = [t], []
        for _ in range(14):
            i = max((j for j in front if whole.feature[j] >= 0), key=lambda j: whole.gain[j])
            front.remove(i)
            front += [whole.left[i], whole.left[i] + 1]
            taken.append((whole.feature[i], whole.cut[i], round(whole.gain[i], 9)))
        todo, kept = [t], []
        while todo:
            i = todo.pop()
            if few.feature[i] >= 0:
                kept.append((few.feature[i], few.cut[i], round(few.gain[i], 9)))
                todo += [few.left[i], few.left[i] + 1]
        assert sorted(kept) == sorted(taken)


@pytest.mark.parametrize("name", ["xgb", "hgb", "gbc"])
@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_learns(name, classes):
    x, y, c = sample(300, classes=classes, apart=2.0)
    m = trees.boosted(x[:200], y[:200], c, replace(trees.BOOSTING[name], rounds=40))
    assert all(b <= a + 1e-3 for a, b in zip(m.losses, m.losses[1:]))
    assert m.losses[-1] < 0.75 * m.losses[0]
    assert (m.predict(x[200:]) == y[200:]).mean() > 0.75


@pytest.mark.parametrize("extra", [False, True])
def test_forests_learn(extra):
    x, y, c = sample(300, apart=2.0)
    f = trees.forest(x[:200], y[:200], c, extra, trees=60)
    assert (f.predict(x[200:]) == y[200:]).mean() > 0.75
    assert np.allclose(f.shares(x).sum(1), 1)
    again = trees.forest(x[:200], y[:200], c, extra, trees=60)
    assert np.array_equal(f.shares(x), again.shares(x))
    one = trees.forest(x[:50], np.zeros(50, int), c, extra, trees=3)
    assert (one.predict(x) == 0).all()


@pytest.mark.parametrize("extra", [False, True])
def test_forests_hold_a_batch_of_trees(extra):
    """Memory doesn't grow with the trees."""
    x, y, c = sample(1500)
    x = x + np.random.default_rng(2).normal(size=x.shape)

    def peak(size):
        tracemalloc.start()
        trees.forest(x, y, c, extra, size).predict(x)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(8 * trees.BATCH) < 1.1 * peak(2 * trees.BATCH)


def squares_over_weight(y, w):
    return sum(w[y == c].sum() ** 2 for c in np.unique(y)) / w.sum()


@pytest.mark.parametrize("extra", [False, True])
def test_forest_splits_against_every_cut(extra):
    x, y, c = sample(120)
    w = np.random.default_rng(5).integers(0, 3, (3, len(y))) * np.array([0.5, 1.0, 1.7])[y]
    nodes = trees.grow_forest(x, (y[:, None] == c).astype(float), w, extra, 7, 25 << 20)
    for t in range(3):
        todo = [(t, np.flatnonzero(w[t]))]
        while todo:
            i, rows = todo.pop()
            own = np.array([w[t, rows[y[rows] == k]].sum() for k in c])
            assert nodes.value[i] == pytest.approx(own / own.sum())
            drawn = np.argsort(trees.unit(7, 3, np.array([[(25 << 20) + i]]), np.arange(6)[None, :]))[0, :2]
            cuts = {f: np.unique(x[rows, f])[:-1] for f in drawn}
            if nodes.feature[i] < 0:
                assert len(np.unique(y[rows])) == 1 or not any(len(v) for v in cuts.values())
                continue
            score = lambda left: squares_over_weight(y[left], w[t, left]) + squares_over_weight(y[rest := np.setdiff1d(rows, left)], w[t, rest])  # noqa: B023, E731
            left = rows[x[rows, nodes.feature[i]] <= nodes.cut[i]]
            assert nodes.feature[i] in drawn and 0 < len(left) < len(rows)
            if not extra:
                assert score(left) == pytest.approx(max(score(rows[x[rows, f] <= v]) for f in drawn for v in cuts[f]), rel=1e-8)
            todo += [(nodes.left[i], left), (nodes.left[i] + 1, np.setdiff1d(rows, left))]


def test_forest_in_parts_equals_the_forest_of_a_task(spark):
    x, y, _ = sample(90)
    values = long(spark, x, y)
    dealt = folds.stratified(values.select("sample_id", "label").distinct(), 2, 2, 9)
    ours = {(r["repeat"], r.sample_id): (r.y, r.p) for r in ablate.forest_predictions(values, dealt, 60, 3).collect()}
    want = {}
    for r in dealt.select("repeat", "fold").distinct().collect():
        rows = {s["sample_id"]: s.fold for s in dealt.filter(F.col("repeat") == r["repeat"]).collect()}
        test = np.array([rows[i] == r.fold for i in range(len(y))])
        p = trees.forest(x[~test], y[~test], np.unique(y), False, 60, 3 + 1000 * r["repeat"]).predict(x[test])
        want |= {(r["repeat"], int(i)): (y[i], v) for i, v in zip(np.flatnonzero(test), p, strict=True)}
    assert ours == want and len(ours) == 2 * len(y)


def test_large_matrices_have_exact_forests_too(spark, monkeypatch):
    """Beyond MAX_CELLS the forest still parts every mixed node that its features can part, in smaller batches of trees."""
    x, y, c = sample(90)
    values = long(spark, x, y)
    dealt = folds.stratified(values.select("sample_id", "label").distinct(), 2, 1, 9)
    monkeypatch.setattr(ablate, "MAX_CELLS", x.size // 2)
    monkeypatch.setitem(learn.SIZES, "rf", learn.SIZES["rf"] | {"numTrees": 7})
    ours = {r.sample_id: (r.y, r.p) for r in ablate.forest_out_of_fold(values, dealt, 3).collect()}
    fold, want = {r.sample_id: r.fold for r in dealt.collect()}, {}
    for f in range(2):
        test = np.array([fold[i] == f for i in range(len(y))])
        votes = 0
        for a in range(0, 7, 2):
            b = min(7, a + 2)
            nodes = trees.forest_part(x[~test], y[~test], c, False, a, b, 3)
            votes = votes + np.rint(nodes.value[nodes.leaf(x[test], b - a)] * ablate.SHARE).astype(np.int64).sum(0)
        want |= {int(i): (y[i], v) for i, v in zip(np.flatnonzero(test), c[votes.argmax(1)], strict=True)}
    assert ours == want and len(ours) == len(y)
    monkeypatch.setattr(ablate, "MAX_CELLS", x.size // 3)
    with pytest.raises(ValueError):
        ablate.forest_predictions(values, dealt, 7, 3)


def test_shap_of_deep_trees_with_features_that_recur():
    """Paths of up to 19 features in three bytes, each taken up to three times, with leaves of one class and of several."""
    rng = np.random.default_rng(3)
    p, c, depth = 19, 3, 26
    feature, cut, left, right, value, weight = [], [], [], [], [], []

    def grown(level, w, order):
        i = len(feature)
        for column, v in zip((feature, cut, left, right, value, weight), (-1, 0.0, -1, -1, None, w), strict=True):
            column.append(v)
        shares = rng.random(c) if rng.random() < 0.3 else np.eye(c)[rng.integers(c)]
        value[i] = shares / shares.sum()
        if level < depth and w > 0.05 and (level < 3 or order):
            feature[i], cut[i] = int(order[0]), float(rng.normal(0, 0.7))
            part = rng.uniform(0.85, 0.97)
            left[i] = grown(level + 1, w * part, order[1:])
            right[i] = grown(level + 20, w * (1 - part), order[1:3])
        return i

    grown(0, 1.0, np.concatenate([rng.permutation(p), rng.permutation(p)]).tolist())
    tree = tuple(map(np.array, (feature, cut, left, right, value, weight)))
    x = rng.normal(size=(40, p))
    assert len(feature) > 50
    assert learn.tree_shaps(tree, x) == pytest.approx(np.stack([learn.tree_shap(tree, row) for row in x]), abs=1e-9)


def test_a_task_explains_many_samples_at_once():
    """A walk's own cost is that of thousands of samples, so 0.1 GB (10 256 samples, 64 features, 10 classes) is one piece."""
    assert ablate.explained_rows(10, 64) > 10_256
    for c, p in ((1, 1), (10, 64), (3, 20_000), (1000, 1000)):
        assert ablate.explained_rows(c, p) % ablate.CHUNK == 0 and ablate.explained_rows(c, p) * c * p <= max(ablate.SHAPS, c * p * ablate.CHUNK)


def test_forest_shap_against_the_published_method(spark):
    """Deep trees (over eight features on a path, repeats among them), samples of several groups."""
    x, y, c = sample(150, 12)
    want, leaves = np.zeros((len(y), 12, 3)), 0
    for a, b in ((0, 25), (25, 30)):
        nodes = trees.forest_part(x, y, c, False, a, b, 2)
        for t in range(b - a):
            tree = nodes.tree(t)
            leaves += (tree[0] < 0).sum()
            want += learn.tree_shaps(tree, x)
            if t < 2:
                some = x[:: 30]
                assert learn.tree_shaps(tree, some) == pytest.approx(np.stack([learn.tree_shap(tree, row) for row in some]), abs=1e-9)
    got = {r.feature: r.mean_abs_shap for r in ablate.forest_shap(long(spark, x, y), 30, 2).collect()}
    assert leaves > 30 * 10
    assert [got[f"f{j:02d}"] for j in range(12)] == pytest.approx(np.abs(want / 30).mean((0, 2)))


def test_histograms_are_held_a_column_at_a_time(monkeypatch):
    """Every sum goes over the rows of one column; cells of all columns at once took eight bytes a row and feature."""
    x, y, c = sample(400)
    sizes, count = [], np.bincount
    monkeypatch.setattr(trees.np, "bincount", lambda at, *rest, **named: (sizes.append(len(at)), count(at, *rest, **named))[1])
    trees.boosted(x, y, c, replace(trees.BOOSTING["xgb"], rounds=2))
    assert max(sizes) <= len(y) * len(c)


def test_units_are_dealt_evenly(spark):
    units = ablate.spread([(i,) for i in range(30)], spark, "unit int")
    assert [len(p) for p in units.rdd.glom().collect()] == [1] * 30


def objective_gradient(m, x, y, c, k, classes):
    z = np.column_stack([(x - m.mean) / m.scale, np.ones(len(x))])
    side, n = np.where(y == c, 1.0, -1.0), len(y)
    own, rest = n / (classes * (y == c).sum()), 1.0 if classes > 2 else n / (2 * (y != c).sum())
    slack = np.maximum(0, 1 - side * (z @ m.w[:, k]))
    return m.w[:, k] - 2 * z.T @ (np.where(side > 0, own, rest) * side * slack)


@pytest.mark.parametrize(("classes", "p"), [(2, 6), (3, 6), (3, 400)])
def test_linear_svc_reaches_the_optimum(classes, p):
    x, y, c = sample(classes=classes, p=p)
    m = linear.LinearSvc(x, y, c)
    for k, name in enumerate(c if classes > 2 else c[1:]):
        assert np.abs(objective_gradient(m, x, y, name, k, classes)).max() < 1e-4
    assert (m.predict(x) == y).mean() > 0.6


def long(spark, x, y):
    rows = [(i, f"f{j:02d}", float(v), int(y[i])) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "sample_id long, feature string, x double, label int")


def test_linear_svc_on_the_cluster_equals_the_one_of_a_task(spark):
    x, y, _ = sample()
    values = long(spark, x, y)
    dealt = folds.stratified(values.select("sample_id", "label").distinct(), 2, 2, 9)
    data, _ = learn.vectors(values)
    ours = {(r.sample_id, r["repeat"]): r.p for r in linear.out_of_fold(data, dealt).collect()}
    want = {(r.sample_id, r["repeat"]): r.p for r in ablate.predictions(values, dealt, ("linear_svc",)).collect()}
    assert ours == want and len(ours) == 2 * len(y)


def test_predictions_of_the_panel(spark):
    x, y, _ = sample(90)
    values = long(spark, x, y)
    dealt = folds.stratified(values.select("sample_id", "label").distinct(), 3, 1, 9)
    rows = ablate.predictions(values, dealt, ("hgb", "extratrees"))
    assert rows.groupBy("learner").count().filter("count = 90").count() == 2
    assert rows.filter(~F.col("p").isin(0, 1, 2)).count() == 0
    scores = ablate.scores(values, dealt, [50], ("all", "random"), 2, learners=("extratrees", "softmax"))
    assert scores.count() == 2 * 3 * 3


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_on_the_cluster_equals_the_one_of_a_task(spark, monkeypatch, classes):
    monkeypatch.setattr(boost, "REFRESH", 2)
    x, y, c = sample(classes=classes)
    s = replace(trees.BOOSTING["xgb"], rounds=3, depth=3, rate=0.3)
    data = boost.arrays(learn.vectors(long(spark, x, y))[0]).repartition(3)
    cuts = trees.quantile_cuts(x)
    ours, want = boost.fit(data, s, seed=4, cuts=cuts), trees.boosted(x, y, c, s, seed=4)
    assert np.allclose(ours.scores(x), want.scores(x), atol=1e-9)
    rows = {r.sample_id: r.p for r in boost.predict(ours, data).collect()}
    assert [rows[i] for i in range(len(y))] == want.predict(x).tolist()


def test_bin_ends_on_the_cluster(spark):
    x, y, _ = sample()
    found = boost.cut_points(boost.arrays(learn.vectors(long(spark, x, y))[0]), 16)
    for ends, column in zip(found, x.T, strict=True):
        assert set(ends) <= set(column) and (not len(ends) or ends[-1] < column.max())
        if len(np.unique(column)) > 16:
            shares = np.diff([0, *np.searchsorted(np.sort(column), ends, "right"), len(column)]) / len(column)
            assert shares.max() < 0.2
