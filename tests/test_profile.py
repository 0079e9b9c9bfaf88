"""Kinds, tail probabilities, rank-test p-values and imputation policies against plain versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featherlens.functions import tails
from featherlens.operators import enrich, learn, profile, resample, stats, transform


def test_incomplete_beta_closed_forms():
    x = np.array([0.0, 0.01, 0.5, 0.9, 1.0])
    assert tails.incomplete_beta(1, 3, x) == pytest.approx(1 - (1 - x) ** 3, abs=1e-13)
    t = np.array([0.0, 0.3, 2.0, 40.0])
    assert tails.incomplete_beta(0.5, 0.5, 1 / (1 + t * t)) == pytest.approx(1 - 2 / math.pi * np.arctan(t), abs=1e-13)
    assert tails.incomplete_beta(1, 0.5, 2 / (2 + t * t)) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-13)


def test_spearman_p(spark):
    rows = [("v", f"f{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(range(10), [2, 1, 4, 3, 6, 5, 8, 7, 10, 9]))] + [("w", f"f{i}", float(i), float(i)) for i in range(5)] + [("x", "f", 1.0, 2.0)]
    got = {r.view: r for r in stats.spearman_p(spark.createDataFrame(rows, "view string, feature string, a double, b double"), ["view"], "a", "b").collect()}
    rho = got["v"].rho
    assert rho == pytest.approx(1 - 6 * 10 / 990)
    # Student's t with an even number of degrees has a finite sum: df = 8
    u = 1 - rho * rho
    tail = 1 - rho * (1 + u / 2 + 3 * u**2 / 8 + 5 * u**3 / 16)
    assert got["v"].p == pytest.approx(tail, rel=1e-9)
    assert got["w"].p == 0.0 and got["x"].p is None


def test_mann_whitney_p(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0], [2.0, 3.0, 8.0, 9.0, 9.0, 10.0]
    rows = [("k", x, True) for x in a] + [("k", x, False) for x in b] + [("one", 1.0, True)]
    got = {r.k: r for r in stats.mann_whitney_p(spark.createDataFrame(rows, "k string, x double, f boolean"), ["k"], "x", "f").collect()}
    u = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))
    n1, n0, n, ties = 5, 6, 11, (27 - 3) + (8 - 2)
    z = (abs(u - 15) - 0.5) / math.sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got["k"].u == u and got["k"].p == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert got["one"].p is None


@pytest.mark.parametrize(("few", "many"), [(1, 1), (1, 6), (3, 5), (4, 9), (8, 8)])
def test_exact_law_of_the_rank_test(few, many):
    counts = tails.mann_whitney_counts(few, many, few * many)
    want = [0] * (few * many + 1)
    for places in itertools.combinations(range(few + many), few):
        want[sum(places) - few * (few - 1) // 2] += 1
    assert counts.tolist() == want


def test_mann_whitney_p_of_small_sides(spark):
    sides = {"a": ([1.0, 9.0, 4.0], [2.0, 3.0, 8.0, 10.0, 11.0]), "b": ([1.0], [2.0]), "c": (list(range(0, 16, 2)), list(range(1, 31, 2)))}
    rows = [(k, float(x), flag) for k, (one, other) in sides.items() for side, flag in ((one, True), (other, False)) for x in side]
    for r in stats.mann_whitney_p(spark.createDataFrame(rows, "k string, x double, f boolean"), ["k"], "x", "f").collect():
        one, other = sides[r.k]
        counts = tails.mann_whitney_counts(len(one), len(other), len(one) * len(other))
        low = int(min(r.u, len(one) * len(other) - r.u))
        assert r.p == pytest.approx(min(1.0, 2 * counts[: low + 1].sum() / counts.sum()), rel=1e-12)


def test_enrichment_counts_each_list_in_each_set(spark):
    rng = random.Random(2)
    sets = [(f"g{i}", "s" if k % 2 else "t", f"set{k}") for i in range(120) for k in range(6) if rng.random() < 0.3]
    lists = [(v, n, f"g{rng.randrange(130)}") for v in "xy" for n in ("one", "two") for _ in range(25)]
    s = spark.createDataFrame(sets + sets[:5] + [(None, "s", "set1"), ("g1", "s", None)], "gene string, source string, gene_set string")
    ls = spark.createDataFrame([*lists, ("x", "one", None)], "view string, list_name string, gene string")
    found = enrich.enrichment(ls, s, ["view", "list_name"], least=5)
    universe = {g for g, _, _ in sets}
    members = {}
    for g, source, name in sets:
        members.setdefault((source, name), set()).add(g)
    tested = {}
    for v, n in {(v, n) for v, n, _ in lists}:
        wanted = {g for a, b, g in lists if (a, b) == (v, n)} & universe
        for key, own in members.items():
            hits = len(own & wanted)
            if hits:
                total, c = len(universe), math.comb
                p = sum(c(len(own), x) * c(total - len(own), len(wanted) - x) for x in range(hits, min(len(own), len(wanted)) + 1)) / c(total, len(wanted))
                tested[(v, n, *key)] = (hits, len(own), len(wanted), total, p)
    got = {(r.view, r.list_name, r.source, r.gene_set): r for r in found.collect()}
    assert got.keys() == tested.keys()
    for key, r in got.items():
        assert (r.hits, r.marked, r.drawn, r.population) == tested[key][:4] and r.p == pytest.approx(tested[key][4], rel=1e-9)
    over = {r.view: r for r in enrich.overlaps(found, ls, ["view"], "list_name", "one", "two", 1.0).collect()}
    for v in "xy":
        one, two = ({k[2:] for k, r in got.items() if k[:2] == (v, n) and r.fdr <= 1.0} for n in ("one", "two"))
        assert (over[v].n_a, over[v].n_b) == (len(one), len(two)) and over[v].pathway_jaccard == pytest.approx(len(one & two) / len(one | two))
        genes = [{g for a, b, g in lists if (a, b) == (v, n)} for n in ("one", "two")]
        assert over[v].gene_jaccard == pytest.approx(len(genes[0] & genes[1]) / len(genes[0] | genes[1]))


def test_silhouette_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(learn, "TILE", 7)
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(60, 3)), np.append(np.arange(59) % 3, 9)
    df = spark.createDataFrame([(i, row.tolist(), int(k)) for i, (row, k) in enumerate(zip(x, c, strict=True))], "sample_id long, x array<double>, prediction int").withColumn("features", array_to_vector("x"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = [d[i, (c == c[i]) & (np.arange(60) != i)].mean() if (c == c[i]).sum() > 1 else 0 for i in range(60)]
    other = [min(d[i, c == k].mean() for k in set(c) if k != c[i]) for i in range(60)]
    want = np.mean([(b - a) / max(a, b) if (c == c[i]).sum() > 1 else 0 for i, (a, b) in enumerate(zip(own, other, strict=True))])
    assert learn.silhouette(df).first().silhouette == pytest.approx(want, rel=1e-9)
    assert -1 < learn.silhouette(df, sample=40).first().silhouette < 1
    assert learn.silhouette(df.withColumn("prediction", F.lit(1))).first().silhouette is None


@pytest.mark.parametrize(("n", "p"), [(12, 40), (671, 3000)])
def test_wide_pca_equals_the_decomposition(spark, n, p):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, p)) * (1 + np.arange(p) % 7)
    if n < 100:
        x[rng.random(x.shape) < 0.2] = 0
    rows = spark.createDataFrame(pa.table({"sample_id": np.repeat(np.arange(n), p) * 3, "feature": np.tile([f"f{j}" for j in range(p)], n), "x": x.ravel(), "label": np.repeat(np.arange(n) % 2, p)}))
    scores, loadings, shares = learn.wide_pca(rows.filter("x <> 0"), 3)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:3], rel=1e-6)
    got = np.zeros((n, 3))
    for r in scores.collect():
        got[r.sample_id // 3, r.pc] = r.score
    load = np.zeros((p, 3))
    for r in loadings.collect():
        load[int(r.feature[1:]), r.pc] = r.loading
    for k in range(3):
        sign = np.sign(got[:, k] @ u[:, k])
        assert got[:, k] == pytest.approx(sign * u[:, k] * s[k], abs=1e-6 * s[0]) and load[:, k] == pytest.approx(sign * v[k], abs=1e-6)
        assert got[np.abs(got[:, k]).argmax(), k] > 0


def test_kinds(spark):
    rows = [(f"{i:05d}" * 7, f"id{i}", "2020-01-02 x", "ab"[i % 2], None, i, i / 2, i > 3) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, h string, d string, c string, e string, i long, f double, b boolean")
    want = {"t": "text", "h": "categorical_highcard", "d": "datetime_like", "c": "categorical", "e": "empty", "i": "int", "f": "float", "b": "bool"}
    assert {r.column: r.kind for r in profile.infer_kinds(df).collect()} == want
    assert {r.column: r.kind for r in profile.infer_kinds(df.limit(0)).collect()} == want | dict.fromkeys("thdce", "empty")


def test_sets_and_claims(spark):
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    parts = {"a": of("x", "y", "y"), "b": of("x", "z"), "c": of("y", "x")}
    assert {(r.a, r.b): (r.n_a_only, r.n_b_only, r.equal) for r in profile.set_comparison(parts, "v").collect()} == {("a", "b"): (1, 1, False), ("a", "c"): (0, 0, True), ("b", "c"): (1, 1, False)}
    assert {r.value: (r.tables, r.everywhere) for r in profile.membership(parts, "v").collect()} == {"x": ("a,b,c", True), "y": ("a,c", False), "z": ("b", False)}
    row = spark.createDataFrame([(1.0, None)], "p double, q double")
    assert {r.claim: r.passed for r in profile.claims(row, {"p": (1.05, 0.1), "q": (0, 1)}).collect()} == {"p": True, "q": False}


def test_policies(spark):
    rows = [(view, i, f, x) for view in ("m", "z") for f, xs in (("a", [1.0, None, 5.0, 7.0]), ("b", [None, None, 1.0, 2.0])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "view string, sample_id long, feature string, x double")
    got = {(r.view, r.feature): r.x for r in transform.impute_by_policy(df, ["view"], {"m": "median"}).filter("sample_id = 1").collect()}
    assert got == {("m", "a"): 5.0, ("z", "a"): 0.0}  # half of b is missing


def test_binned_density_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(9)
    x = np.append(rng.normal(size=500), rng.normal(6, 0.3, 300))
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("k", None), ("one", 2.0)], "k string, x double")
    got = {(r.k, r.i): (r.x_at, r.density) for r in stats.kde(df, ["k"], "x", 41).collect()}
    h = 0.15 * (x.max() - x.min()) / len(x) ** 0.2
    direct = {i: np.exp(-(((at - x) / h) ** 2) / 2).mean() / (h * math.sqrt(2 * math.pi)) for (k, i), (at, _) in got.items() if k == "k"}
    error = ((x.max() - x.min()) / (stats.KDE_BINS - 1) / h) ** 2 / 8 * max(direct.values())
    assert len(direct) == 41 and all(abs(got["k", i][1] - d) <= 2 * error for i, d in direct.items())
    assert got["one", 0][1] is None


def test_density_is_the_direct_sum(spark):
    """A narrow peak beside a far value, where bins over the range would be as wide as the bandwidth."""
    x = np.append(np.random.default_rng(3).normal(size=400), [9.0])
    df = spark.createDataFrame([("k", float(v)) for v in x], "k string, x double")
    h = 1e-4 * (x.max() - x.min()) / len(x) ** 0.2
    for keys in (["k"], []):
        got = {r.i: (r.x_at, r.density) for r in stats.kde(df, keys, "x", 5, 1e-4).collect()}
        for at, density in got.values():
            assert density == pytest.approx(np.exp(-(((at - x) / h) ** 2) / 2).mean() / (h * math.sqrt(2 * math.pi)), rel=1e-9, abs=1e-12)
        assert sorted(got) == list(range(5))


def test_quantiles_of_many_groups(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([0.0, round(rng.gauss(0, 1), 1), None]), i) for k in ("a", "b", None) for i in range(rng.randint(50, 90))] + [("one", 3.5, 1), ("none", None, 1)]
    got = {r.k: r.q for r in transform.quantiles(spark.createDataFrame(rows, "k string, x double, sample_id int"), ["k"], F.col("x"), [0.1, 0.5, 1.0]).collect() if r.k is not None}
    for k in ("a", "b", "one"):
        assert got[k] == pytest.approx(np.quantile([x for g, x, _ in rows if g == k and x is not None], [0.1, 0.5, 1.0]).tolist())
    assert "none" not in got


def test_permutations_and_bootstraps_equal_their_windows(spark):
    rows = [(i * 7 % 101, i % 3, f"l{i % 4}") for i in range(100)]
    df = spark.createDataFrame(rows, "sample_id long, g int, label string")
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    want = set()
    for perm in range(3):
        for g in range(3):
            mine = sorted(r for r in rows if r[1] == g)
            order = sorted(mine, key=lambda r: (md5(5, perm, r[0]), r[0]))  # noqa: B023
            want |= {(a[0], perm, g, b[2]) for a, b in zip(mine, order, strict=True)}
    assert {(r.sample_id, r.perm, r.g, r.label) for r in resample.permuted(df, ["g"], "label", 3, 5).collect()} == want
    unit = lambda *x: int(md5(*x)[:8], 16) / 4294967296
    want = []
    for g in range(3):
        mine = sorted(r for r in rows if r[1] == g)
        want += [(d, *mine[int(unit(4, d, i, g) * len(mine))]) for d in range(2) for i in range(1, len(mine) + 1)]
    got = resample.bootstrap(df, ["g"], 2, 4).select("draw", "sample_id", "g", "label").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bundle_checks(spark):
    inf, nan = math.inf, math.nan
    rows = [("a", i, f, x) for i, xs in enumerate([(1.0, 2.0, None), (1.0, 3.0, nan), (1.0, inf, 4.0)]) for f, x in zip(("p", "q", ""), xs, strict=True)]
    rows += [("b", i, "p", 5.0) for i in range(2)] + [("c_raw", i, "p", float(i)) for i in range(3)] + [("d", i, "p", float(i)) for i in range(3)]
    v = spark.createDataFrame(rows, "view string, sample_id long, feature string, x double")
    s = spark.createDataFrame([(0, "x"), (1, "y"), (2, "y"), (2, "y")], "sample_id long, label string")
    found = profile.bundle_checks(v, s, {"a": 2, "b": 3, "z": 1}, 3, 3, ("_raw",))
    got = {(r.view, r.check): (r.value, r.level) for r in found.collect()}
    assert got["a", "missing"] == (pytest.approx(2 / 9), "WARN") and got["a", "infinite"] == (1, "ERROR") and got["a", "nameless"] == (1, "WARN") and got["a", "constant"] == (pytest.approx(2 / 3), "WARN")
    assert got["a", "samples"] == (3, "OK") and got["b", "samples"] == (2, "ERROR") and got["b", "features"] == (1, "WARN") and got["b", "constant"] == (1, "WARN")
    assert got["z", "present"] == (0, "WARN") and ("z", "samples") not in got
    assert got["c_raw", "expected"] == (0, "OK") and got["d", "expected"] == (0, "WARN")
    assert got["", "bundle_samples"] == (3, "OK") and got["", "bundle_classes"] == (2, "WARN") and got["", "repeated_samples"] == (1, "ERROR")
    assert {r.view: r.status for r in profile.verdict(found, ["view"]).collect()} == {"a": "FAIL", "b": "FAIL", "c_raw": "PASS", "d": "WARN", "z": "WARN", "": "FAIL"}
