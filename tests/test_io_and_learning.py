"""Readers, sinks, streams, simulation and learners."""

import gzip
import json

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from featherlens import plans
from featherlens.operators import folds, learn, simulate, trees
from featherlens.sources import readers, sinks
from featherlens.streaming import moments as running

from .oracle import compare, connect


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\ts1\ts2\ng1\t1.5\tn/a\ng2\t2\t3\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("a,b\n1,x\noops,y\n")
    long = readers.read_wide_matrix(spark, str(tmp_path / "a.tsv"), "k")
    assert {tuple(r) for r in long.collect()} == {("s1", "g1", 1.5), ("s2", "g1", None), ("s1", "g2", 2.0), ("s2", "g2", 3.0)}
    got = readers.read_delimited(spark, str(tmp_path / "b.csv.gz"), "a int, b string").collect()
    assert [(r.a, r.b, r._corrupt is None) for r in got] == [(1, "x", True), (None, "y", False)]
    assert readers.read_table(spark, str(tmp_path / "b.csv.gz")).count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "c.xlsx"))
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a.tsv")]) == str(tmp_path / "a.tsv")


def test_bundle_splits_and_hashes(spark, tmp_path):
    np.savez(tmp_path / "ds.npz", X_rna=np.array([[1, np.nan], [3, 4]], np.float32), features_rna=np.array(["a", "b"]), y=np.array([0, 1]), sample_ids=np.array(["s0", "s1"]))
    got = readers.read_npz_views(spark, str(tmp_path / "ds.npz"))
    assert {tuple(r) for r in got.drop("path").collect()} == {("rna", "s0", "a", 1.0, 0), ("rna", "s0", "b", None, 0), ("rna", "s1", "a", 3.0, 1), ("rna", "s1", "b", 4.0, 1)}
    (tmp_path / "sp.json").write_text(json.dumps({"y": [0, 1], "sample_ids": ["a", "b"], "groups": ["g", "g"], "fold_ids": [[0, 1], [1, 0]]}))
    assert {tuple(r) for r in readers.read_splits(spark, str(tmp_path / "sp.json")).collect()} == {(0, "a", 0, 0), (0, "b", 1, 1), (1, "a", 1, 0), (1, "b", 0, 1)}
    h = readers.file_hashes(spark, str(tmp_path / "*.json")).first()
    assert len(h.sha256) == 64 and not h.is_gzip and not h.looks_like_error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "v", "s", "f", 1.0), ("d", "w", "s", "f", 2.0)], "dataset string, view string, sample_id string, feature string, x double")
    out = str(tmp_path / "values")
    sinks.write_values(df, out)
    assert spark.read.parquet(out).filter("view = 'w'").first().x == 2.0
    named = readers.with_filename_keys(spark.read.parquet(out).drop("dataset", "view"), r"^(part)-(\d+)", ["kind", "number"])
    assert {r.kind for r in named.collect()} == {"part"}
    for name in ("t.csv.gz", "t.json", "t"):
        sinks.write_table(df, str(tmp_path / name))
    assert spark.read.option("header", True).csv(str(tmp_path / "t.csv.gz")).count() == 2
    work = df.select("dataset", "view")
    assert sinks.remaining(work, str(tmp_path / "none"), ["view"]).count() == 2
    df.filter("view = 'v'").write.parquet(str(tmp_path / "done"))
    assert [r.view for r in sinks.remaining(work, str(tmp_path / "done"), ["view"]).collect()] == ["w"]
    sinks.write_manifest(spark, str(tmp_path / "runs"), "p", ["a"], ["b"], {"k": 1})
    sinks.write_manifest(spark, str(tmp_path / "runs"), "p", ["a"], ["b"], {"k": 2})
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = running.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running_moments").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(r["mean"], 9), round(r.variance, 9)) for r in df.collect())
    assert key(spark.table("running_moments")) == key(running.windowed(e))


def test_simulated_regimes(spark):
    di = {}
    for name, s in simulate.SCENARIOS.items():
        di[name] = simulate.di_curve(simulate.matrix(spark, s, 3), [10]).first().di
    assert di["coupled"] < 0.7 < di["decoupled"] and di["anti_aligned"] > 1.0
    with pytest.raises(ValueError):
        simulate.Scenario("x", ((0.5, 1.0, 1.0),))


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    rows = [("v", i, f, float(rng.normal(3 * (i % 2) if f == "a" else 0)), i % 2) for i in range(80) for f in ("a", "b", "c")]
    return spark.createDataFrame(rows, "view string, sample_id long, feature string, x double, label long")


def test_learning(spark, separable):
    data, names = learn.vectors(separable)
    data = data.cache()
    f = folds.stratified(separable.select("sample_id", "label").distinct(), 2, 1, 1)
    good = folds.confusion_metrics(learn.out_of_fold(data, f, "logistic"), ["repeat"]).first()
    none = folds.confusion_metrics(learn.dummy(data, f), ["repeat"]).first()
    assert good.balanced_accuracy > 0.8 and none.balanced_accuracy == pytest.approx(0.5)
    imp = {r.feature: r.p_score for r in learn.importances(data, names).collect()}
    assert imp["a"] > imp["b"] + imp["c"]


def test_tree_shap_adds_up(spark, separable):
    data, names = learn.vectors(separable)
    model = RandomForestClassifier(numTrees=2, maxDepth=3, seed=2).fit(data)
    for feature, threshold, left, right, value, weight in (trees := learn.tree_arrays(model)):
        for x in ([0.0, 0.0, 0.0], [3.0, 1.0, -1.0]):
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] <= threshold[at] else right[at]
            leaves = feature < 0
            expected = (value[leaves] * weight[leaves][:, None]).sum(0) / weight[0]
            phi = learn.tree_shap((feature, threshold, left, right, value, weight), np.array(x))
            assert phi.sum(0) == pytest.approx(value[at] - expected, abs=1e-9)
    assert len(trees) == 2
    top = learn.mean_abs_shap(model, data, names).orderBy(F.desc("mean_abs_shap")).first()
    assert top.feature == "a"


def test_projection(spark, separable):
    data, names = learn.vectors(separable)
    scores, loadings, share = learn.pca(data, 2)
    assert loadings.shape == (3, 2) and share[0] >= share[1]
    assert scores.groupBy("pc").agg(F.avg("score").alias("m")).agg(F.max(F.abs("m"))).first()[0] < 1e-9
    assert learn.top_loadings(data, names, 1, 1).first().feature == "a"
    r = learn.pca_alignment(data, 2).first()
    assert 0 < r.pcla <= 1


def test_learners_have_the_reference_sizes():
    get = lambda name, **sizes: learn.LEARNERS[name](1, **sizes)
    assert (get("rf").getNumTrees(), get("rf").getMaxDepth()) == (600, 30)
    g = trees.BOOSTING["xgb"]
    assert (g.rounds, g.depth, g.rate, g.row_share, g.column_share, g.l2) == (400, 6, 0.05, 0.8, 0.8, 1.0)
    assert get("logistic").getMaxIter() == 2000
    assert get("rf", numTrees=3).getNumTrees() == 3


def test_shap_explains_the_trained_forest(spark, separable, monkeypatch):
    data, names = learn.vectors(separable)
    model = learn.LEARNERS["rf"](4, numTrees=3).fit(learn.weighted(data))
    x = np.random.default_rng(1).normal(1, 2, (7, 3))
    for tree in learn.tree_arrays(model):
        assert learn.tree_shaps(tree, x) == pytest.approx(np.stack([learn.tree_shap(tree, row) for row in x]), abs=1e-9)
    seen = []
    monkeypatch.setattr(learn, "mean_abs_shap", lambda model, data, names: seen.append(model))
    learn.forest_shap(data, names, 4, numTrees=3)
    assert seen[0].getNumTrees == 3 and seen[0].getOrDefault("maxDepth") == 30


def test_small_learners_predict(spark, separable):
    data, _ = learn.vectors(separable)
    f = folds.stratified(separable.select("sample_id", "label").distinct(), 2, 1, 1)
    for learner, sizes in (("logistic", {"maxIter": 20}), ("rf", {"numTrees": 5})):
        got = folds.confusion_metrics(learn.out_of_fold(data.cache(), f, learner, **sizes), ["repeat"]).first()
        assert got.balanced_accuracy > 0.8


def test_wide_files_with_recurring_names(spark, tmp_path):
    """Keys beyond the id's width give ids that recur; files of two columns each."""
    rows = [(k, k % 7, float(k) / 4 if k != 7 else None) for k in (1, 7, 999, 1234, 1235, 1236, 1238, 12361)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    assert compare(spark, connect(str(tmp_path)), plans.QUERIES["scan_raw_xena_matrix"], plans.SQL["scan_raw_xena_matrix"], str(tmp_path)) == ""
    s = spark.createDataFrame([(i, "a" if i < 3 else None, i / 8) for i in range(5)], "k long, id string, x double")
    sinks.write_wide_rows(s, str(tmp_path / "wide"), "k", "id", ["x"], columns=2)
    got = readers.read_wide_rows(spark, str(tmp_path / "wide"), "feature").collect()
    assert sorted(map(tuple, got)) == [("", "x", 0.375), ("", "x", 0.5), ("a", "x", 0.0), ("a", "x", 0.125), ("a", "x", 0.25)]
