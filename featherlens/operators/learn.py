"""Learners, out-of-fold predictions, importances and projections on pyspark.ml.

ablate has many small fits at once, boost boosted trees and linear support vectors are in linear.

The long matrix becomes one vector a sample only here. Fits run one after another on the cluster, each of them distributed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from . import folds as fold_ops
from . import moments, ranking, resample, stats

#: The reference's sizes and iteration limits; depth 30 is the most that Spark's trees take, where the reference has no limit.
SIZES = {
    "rf": {"numTrees": 600, "maxDepth": 30},
    "logistic": {"maxIter": 2000},
}
#: name -> (seed, sizes other than SIZES) -> estimator over features, label, weight.
LEARNERS: dict[str, Callable[..., Estimator]] = {
    "rf": lambda seed, **sizes: RandomForestClassifier(featureSubsetStrategy="sqrt", seed=seed, weightCol="weight", **(SIZES["rf"] | sizes)),
    "logistic": lambda seed, **sizes: LogisticRegression(regParam=0.01, weightCol="weight", **(SIZES["logistic"] | sizes)),
}


def vectors(values: DataFrame, features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(sample_id, label, features) in name order, missing as 0, and the names; a feature list is the ML boundary's schema."""
    names = sorted(features or [r.feature for r in values.select("feature").distinct().collect()])
    kept = values.filter(F.col("feature").isin(names)) if features else values
    wide = kept.groupBy("sample_id", "label").pivot("feature", names).agg(F.first("x")).fillna(0.0, names)
    return wide.select("sample_id", F.col("label").cast("double").alias("label"), array_to_vector(F.array(*[F.col(f"`{n}`").cast("double") for n in names])).alias("features")), names


def weighted(train: DataFrame) -> DataFrame:
    """With class weights n / (classes * n_class)."""
    w = fold_ops.class_weights(train.select("label")).select("label", "weight")
    return train.join(F.broadcast(w), "label")


def out_of_fold(data: DataFrame, fold_rows: DataFrame, learner: str, seed: int = 0, **sizes) -> DataFrame:
    """sample_id, repeat, y, p: each sample predicted by a model that hasn't seen its fold; sizes as in SIZES."""
    pairs = sorted(tuple(r) for r in fold_rows.select("repeat", "fold").distinct().collect())
    joined = data.join(fold_rows.select("sample_id", "repeat", "fold"), "sample_id").cache()
    out = None
    for repeat, fold in pairs:
        mine = joined.filter(F.col("repeat") == repeat)
        model = LEARNERS[learner](seed + 1000 * repeat, **sizes).fit(weighted(mine.filter(F.col("fold") != fold)))
        p = model.transform(mine.filter(F.col("fold") == fold)).select("sample_id", "repeat", F.col("label").alias("y"), F.col("prediction").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def dummy(data: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """The most frequent class of the training folds as the prediction."""
    j = data.select("sample_id", "label").join(fold_rows.select("sample_id", "repeat", "fold"), "sample_id")
    every = j.groupBy("repeat", "label").agg(F.count("*").alias("n"))
    inside = j.groupBy("repeat", "fold", "label").agg(F.count("*").alias("m"))
    grid = every.join(j.select("repeat", "fold").distinct(), "repeat").join(inside, ["repeat", "fold", "label"], "left").withColumn("left", F.col("n") - F.coalesce("m", F.lit(0)))
    top = ranking.ranked(grid, ["repeat", "fold"], "left", name="label").filter("rank = 1").select("repeat", "fold", F.col("label").alias("p"))
    return j.join(F.broadcast(top), ["repeat", "fold"]).select("sample_id", "repeat", F.col("label").alias("y"), "p")


def importances(data: DataFrame, names: list[str], learner: str = "rf", seed: int = 0) -> DataFrame:
    """feature, p_score: impurity importance of the forest, or the mean absolute coefficient."""
    model = LEARNERS[learner](seed).fit(weighted(data))
    if hasattr(model, "featureImportances"):
        scores = model.featureImportances.toArray()
    else:
        scores = np.abs(model.coefficientMatrix.toArray()).mean(0)
    return data.sparkSession.createDataFrame([(n, float(s)) for n, s in zip(names, scores, strict=True)], "feature string, p_score double")


# ---- Shapley values of trees


def tree_arrays(model) -> list[tuple[np.ndarray, ...]]:
    """For each tree (feature or -1, threshold, left, right, class distribution, weight) of its nodes, from the saved model."""
    spark = SparkSession.getActiveSession()
    path = sinks.workspace(spark, "forest")
    model.save(path)
    trees: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r.treeID, []).append(r.nodeData)
    out = []
    for _, nodes in sorted(trees.items()):
        nodes.sort(key=lambda n: n.id)  # numbered from the root, 0
        inner = [n.leftChild >= 0 for n in nodes]
        stats_ = np.array([n.impurityStats for n in nodes])
        weight = stats_.sum(1)
        feature = np.array([n.split.featureIndex if i else -1 for n, i in zip(nodes, inner, strict=True)])
        threshold = np.array([n.split.leftCategoriesOrThreshold[0] if i else 0.0 for n, i in zip(nodes, inner, strict=True)])
        out.append((feature, threshold, np.array([n.leftChild for n in nodes]), np.array([n.rightChild for n in nodes]), stats_ / np.maximum(weight, 1e-12)[:, None], weight))
    return out


def tree_shap(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values (features, classes) of one tree for one sample, by the published polynomial method."""
    feature, threshold, left, right, value, weight = tree
    phi = np.zeros((len(x), value.shape[1]))

    def extend(path, zero, one, d):
        path = [list(p) for p in path] + [[d, zero, one, 1.0 if not path else 0.0]]
        n = len(path)
        for i in range(n - 2, -1, -1):
            path[i + 1][3] += one * path[i][3] * (i + 1) / n
            path[i][3] = zero * path[i][3] * (n - 1 - i) / n
        return path

    def unwound(path, i):
        """The path without step i."""
        n, (_, zero, one, _) = len(path), path[i]
        path = [list(p) for p in path]
        carry = path[-1][3]
        for j in range(n - 2, -1, -1):
            if one != 0:
                kept = path[j][3]
                path[j][3] = carry * n / ((j + 1) * one)
                carry = kept - path[j][3] * zero * (n - 1 - j) / n
            else:
                path[j][3] = path[j][3] * n / (zero * (n - 1 - j))
        for j in range(i, n - 1):
            path[j][:3] = path[j + 1][:3]
        return path[:-1]

    def visit(node, path, zero, one, d):
        path = extend(path, zero, one, d)
        if feature[node] < 0:
            for i in range(1, len(path)):
                w = sum(p[3] for p in unwound(path, i))
                phi[path[i][0]] += w * (path[i][2] - path[i][1]) * value[node]
            return
        goes_left = x[feature[node]] <= threshold[node]
        hot, cold = (left[node], right[node]) if goes_left else (right[node], left[node])
        in_zero = in_one = 1.0
        for i in range(1, len(path)):
            if path[i][0] == feature[node]:
                in_zero, in_one = path[i][1], path[i][2]
                path = unwound(path, i)
                break
        visit(hot, path, in_zero * weight[hot] / weight[node], in_one, feature[node])
        visit(cold, path, in_zero * weight[cold] / weight[node], 0.0, feature[node])

    visit(0, [], 1.0, 1.0, -1)
    return phi


#: Rows are the patterns of four bits, the lowest first.
PATTERNS = ((np.arange(16)[:, None] >> np.arange(4)) & 1).astype(bool)[..., None]


@functools.cache
def quadrature(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on (0, 1)."""
    u, w = np.polynomial.legendre.leggauss(n)
    return (u + 1) / 2, w / 2


def add_shaps(tree: tuple[np.ndarray, ...], x: np.ndarray, phi: np.ndarray) -> None:
    """Adds tree_shap of many samples, x (features, samples), to phi (classes, features, samples).

    A leaf gives feature i of its path (one - zero) times the integral over u in (0, 1) of the other features' product of
    zero * (1 - u) + one * u, a polynomial that Gauss-Legendre nodes integrate exactly. Eight features' ones are a byte, which
    looks their product up. Where one is 0 the integral times -zero is the same for all features: that of -product / (1 - u).
    """
    Explained(tree, x, phi).walk()


class Explained:
    """One tree and some samples of add_shaps.

    The state is the path to the node: its features, their zeros, their ones by sample and as bytes. What the leaves below a
    split give its feature has the same ones, so it is summed by class and place in the path, and multiplied by the ones when
    the walk leaves the split.
    """

    def __init__(self, tree: tuple[np.ndarray, ...], x: np.ndarray, phi: np.ndarray) -> None:
        self.tree, self.x, self.phi = tree, x, phi
        self.at, self.zeros, self.ones, self.codes = [], [], [], []
        self.place: dict[int, int] = {}
        #: class -> by place what samples give whose one is 1, and what all give
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: by place the classes, as bits, whose sums are not empty
        self.given, self.all = [], []
        self.tables: dict[tuple[int, int], tuple] = {}
        self.products: dict[int, tuple] = {}
        self.room = np.empty((0, x.shape[1]))
        self.scratch: dict[int, np.ndarray] = {}

    def walk(self) -> None:
        feature, threshold, left, right, _, weight = (a.tolist() if a.ndim == 1 else a for a in self.tree)
        todo: list[tuple] = [(0, None, 0.0, None)]
        while todo:
            node, side, share, back = todo.pop()
            if back is not None:
                self.leave(*back)
                continue
            if side is not None:
                todo.append((0, None, 0.0, self.enter(*side, share)))
            f = feature[node]
            if f < 0:
                self.leaf(self.tree[4][node])
                continue
            goes = self.x[f] <= threshold[node]
            todo += [(child, (f, s), weight[child] / weight[node], None) for child, s in ((left[node], goes), (right[node], ~goes)) if weight[child] > 0]

    def enter(self, f: int, side: np.ndarray, share: float) -> tuple:
        """Takes a split; returns what leave needs."""
        i = self.place.get(f, len(self.at))
        byte, bit = divmod(i, 8)
        if i < len(self.at):
            self.flush(i)
            before = (i, self.zeros[i], self.ones[i], self.codes[byte])
            self.zeros[i] *= share
            self.ones[i] = self.ones[i] & side
            self.codes[byte] = self.codes[byte] & (side.view(np.uint8) << np.uint8(bit) | np.uint8(255 - (1 << bit)))
            return before
        code = side.view(np.uint8) << np.uint8(bit)
        before = (i, None, None, self.codes[byte] if bit else None)
        if bit:
            self.codes[byte] = self.codes[byte] | code
        else:
            self.codes.append(code)
        self.place[f] = i
        for path, mine in ((self.at, f), (self.zeros, share), (self.ones, side), (self.given, 0), (self.all, 0)):
            path.append(mine)
        return before

    def leave(self, i: int, zero: float | None, ones: np.ndarray | None, code: np.ndarray | None) -> None:
        self.flush(i)
        if zero is not None:
            self.zeros[i], self.ones[i], self.codes[i // 8] = zero, ones, code
            return
        classes = self.all[i]
        if i:
            self.all[i - 1] |= classes
        f = self.at.pop()
        for path in (self.zeros, self.ones, self.given, self.all):
            path.pop()
        for c in bits_of(classes):
            every = self.sums[c][1]
            mine = self.phi[c, f]
            np.add(mine, every[i], out=mine)
            if i:
                np.add(every[i - 1], every[i], out=every[i - 1])
            every[i].fill(0)
        del self.place[f]
        if code is None:
            self.codes.pop()
        else:
            self.codes[-1] = code

    def flush(self, i: int) -> None:
        for c in bits_of(self.given[i]):
            row, mine = self.sums[c][0][i], self.phi[c, self.at[i]]
            np.multiply(row, self.ones[i], out=row)
            np.add(mine, row, out=mine)
            row.fill(0)
        self.given[i] = 0

    def product(self, u: np.ndarray) -> np.ndarray:
        """(samples, nodes) of the whole path; that of all bytes but the last is kept for the next leaf."""
        q, last = len(u), len(self.codes) - 1
        if q not in self.scratch:
            self.scratch[q] = np.empty((self.x.shape[1], q))
        out = self.table(last, u).take(self.codes[last], axis=0, out=self.scratch[q], mode="clip")
        if last:
            codes, zeros = self.codes[:last], self.zeros[: 8 * last]
            kept = self.products.get(q)
            if kept is None or len(kept[0]) != last or any(a is not b for a, b in zip(kept[0], codes, strict=True)) or kept[1] != zeros:
                whole = self.table(0, u).take(codes[0], axis=0)
                for byte in range(1, last):
                    np.multiply(whole, self.table(byte, u).take(codes[byte], axis=0), out=whole)
                kept = self.products[q] = codes, zeros, whole
            np.multiply(out, kept[2], out=out)
        return out

    def table(self, byte: int, u: np.ndarray) -> np.ndarray:
        """The product of a byte's features for each pattern of their ones."""
        zeros = self.zeros[8 * byte : 8 * byte + 8]
        kept = self.tables.get((byte, len(u)))
        if kept is None or kept[0] != zeros:
            off = np.array(zeros)[:, None] * (1 - u)
            low, high = (np.where(PATTERNS[: 1 << len(part), : len(part)], part + u, part).prod(1) for part in (off[:4], off[4:]))
            kept = self.tables[byte, len(u)] = zeros, (high[:, None] * low).reshape(-1, len(u))
        return kept[1]

    def leaf(self, value: np.ndarray) -> None:
        if not (d := len(self.at)):
            return
        u, w = quadrature((d + 1) // 2)
        if len(self.room) <= d:
            self.room = np.empty((d + 8, self.x.shape[1]))
        zero = np.array(self.zeros)[:, None]
        factor = np.empty((d + 1, len(u)))
        factor[d] = -w / (1 - u)
        np.subtract(w * (1 - zero) / (zero * (1 - u) + u), factor[d], out=factor[:d])
        given = np.matmul(factor, self.product(u).T, out=self.room[: d + 1])
        classes = np.flatnonzero(value).tolist()
        for c in classes:
            mine = given if value[c] == 1 else value[c] * given
            ones, every = self.sums.get(c, (np.zeros((0, given.shape[1])),) * 2)
            if len(ones) < d:
                ones, every = self.sums[c] = tuple(np.concatenate([s, np.zeros((d + 8 - len(s), s.shape[1]))]) for s in (ones, every))
            np.add(ones[:d], mine[:d], out=ones[:d])
            np.add(every[d - 1], mine[d], out=every[d - 1])
        mask = sum(1 << c for c in classes)
        self.given = [g | mask for g in self.given]
        self.all[-1] |= mask


def bits_of(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def tree_shaps(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """tree_shap of many samples: (samples, features, classes)."""
    phi = np.zeros((tree[4].shape[1], x.shape[1], len(x)))
    add_shaps(tree, np.ascontiguousarray(x.T), phi)
    return phi.transpose(2, 1, 0)


def mean_abs_shap(model, data: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean_abs_shap of a forest over data, classes averaged; samples in parallel, sums combined."""
    trees = data.sparkSession.sparkContext.broadcast(tree_arrays(model))

    def explain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(names)), 0
        for frame in frames:
            for a in range(0, len(frame), 500):
                x = np.stack(frame["x"].iloc[a : a + 500].to_list())
                phi = sum(tree_shaps(t, x) for t in trees.value) / len(trees.value)
                total += np.abs(phi).mean(2).sum(0)
                n += len(x)
        yield pd.DataFrame({"feature": names, "total": total, "n": n})

    parts = data.select(vector_to_array("features").alias("x")).mapInPandas(explain, "feature string, total double, n long")
    return parts.groupBy("feature").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_abs_shap"))


def forest_shap(data: DataFrame, names: list[str], seed: int = 0, **sizes) -> DataFrame:
    """feature, mean_abs_shap of the forest that "rf" trains on data."""
    data = data.cache()
    return mean_abs_shap(LEARNERS["rf"](seed, **sizes).fit(weighted(data)), data, names)


# ---- projections and clusters


def scaled(data: DataFrame) -> DataFrame:
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(data)
    return model.transform(data).drop("features").withColumnRenamed("scaled", "features")


def pca(data: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(sample_id, label, pc, score) rows, loadings (features, k) and shares of variance."""
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(data)
    mean = data.select(F.posexplode(vector_to_array("features")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
    shift = np.array([r.m for r in mean]) @ model.pc.toArray()
    rows = model.transform(data).select("sample_id", "label", F.posexplode(vector_to_array("pcs")).alias("pc", "raw"))
    lookup = F.element_at(F.array(*[F.lit(float(s)) for s in shift]), F.col("pc") + 1)
    return rows.select("sample_id", "label", "pc", (F.col("raw") - lookup).alias("score")), model.pc.toArray(), model.explainedVariance.toArray()


def pca_alignment(data: DataFrame, k: int) -> DataFrame:
    """sas (rank correlation of the components' variances and eta squared) and pcla (share-weighted eta squared)."""
    scores, _, share = pca(data, k)
    e = moments.eta2(scores.select("sample_id", F.format_string("pc%02d", "pc").alias("feature"), F.col("score").alias("x"), "label").withColumn("view", F.lit("pc")), ["view"])
    w = data.sparkSession.createDataFrame([(f"pc{i:02d}", float(s)) for i, s in enumerate(share)], "feature string, share double")
    j = e.join(w, "feature")
    rho = stats.spearman(j, ["view"], "share", "eta_sq").select("view", F.col("rho").alias("sas"))
    return j.groupBy("view").agg((F.sum(F.col("share") * F.col("eta_sq")) / F.sum("share")).alias("pcla")).join(rho, "view")


def _component_rows(scores: DataFrame) -> DataFrame:
    return scores.select("sample_id", F.format_string("pc%02d", "pc").alias("feature"), F.col("score").alias("x"), "label")


def _shares(spark: SparkSession, share: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(f"pc{i:02d}", float(s)) for i, s in enumerate(share)], "feature string, share double")


def pc_class_signal(data: DataFrame, k: int) -> DataFrame:
    """weighted_mean and weighted_sum of the components' eta squared, weighted by their shares of variance."""
    scores, _, share = pca(data, k)
    e = moments.eta2(_component_rows(scores), []).join(F.broadcast(_shares(data.sparkSession, share)), "feature")
    total = F.sum(F.col("share") * F.col("eta_sq"))
    return e.agg((total / F.sum("share")).alias("weighted_mean"), total.alias("weighted_sum"))


def pcla_of_permutations(data: DataFrame, k: int, perms: int) -> DataFrame:
    """perm, pcla: the share-weighted eta squared under permuted labels (perm -1: as they are).

    Components don't hang on labels, so they are computed and written once; permutations are a key of one plan.
    """
    spark = data.sparkSession
    scores, _, share = pca(data, k)
    path = sinks.workspace(spark, "components")
    _component_rows(scores).write.parquet(path)
    rows = spark.read.parquet(path)
    labels = rows.select("sample_id", "label").distinct()
    own = labels.select(F.lit(-1).alias("perm"), "sample_id", "label")
    dealt = own if not perms else own.unionByName(resample.permuted(labels, [], "label", perms, 0).select("perm", "sample_id", "label"))
    e = moments.eta2(rows.drop("label").join(dealt, "sample_id"), ["perm"]).join(F.broadcast(_shares(spark, share)), "feature")
    return e.groupBy("perm").agg((F.sum(F.col("share") * F.col("eta_sq")) / F.sum("share")).alias("pcla"))


#: Samples whose silhouette is measured, as in the reference, and those of one side of a tile of distances.
SILHOUETTE_SAMPLE, TILE = 5000, 250


def silhouette(pred: DataFrame, features: str = "features", sample: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """silhouette (Euclidean) of (sample_id, features, prediction); NULL for fewer than two clusters, or one a sample.

    Beyond sample rows, those first in hash order are measured. Distances are summed in tiles of TILE by TILE samples, by sample
    and cluster, so no task holds them all.
    """
    rows = pred.select("sample_id", F.col("prediction").cast("long").alias("c"), vector_to_array(features).alias("x"))
    rows = rows.orderBy(resample.hash_order(0, F.col("sample_id")), "sample_id").limit(sample)
    path = sinks.workspace(pred.sparkSession, "silhouette")
    rows.withColumn("i", F.monotonically_increasing_id()).write.parquet(path)
    rows = pred.sparkSession.read.parquet(path)
    blocks = max(1, -(-rows.count() // TILE))
    block, other = F.pmod(F.xxhash64("i"), F.lit(blocks)), F.explode(F.sequence(F.expr("0L"), F.lit(blocks - 1).cast("long"))).alias("other")
    placed = rows.withColumn("block", block).select("*", other)
    tiles = placed.select(F.col("block").alias("a"), F.col("other").alias("b"), F.lit(0).alias("side"), "i", "c", "x").unionAll(placed.select("other", "block", F.lit(1), "i", "c", "x"))

    def distances(t: pa.Table) -> pa.Table:
        side, i, c = (t[k].to_numpy() for k in ("side", "i", "c"))
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)
        mine, theirs = side == 0, side == 1
        names, at = np.unique(c[theirs], return_inverse=True)
        if not mine.any() or not len(names):
            return pa.table({"i": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "to": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        a, b = x[mine], x[theirs]
        d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
        d[i[mine][:, None] == i[theirs][None, :]] = 0
        hot = (at[:, None] == np.arange(len(names))).astype(float)
        rows_ = np.repeat(np.arange(len(a)), len(names))
        return pa.table({"i": i[mine][rows_], "c": c[mine][rows_], "to": np.tile(names, len(a)), "d": (d @ hot).ravel(), "n": np.tile(hot.sum(0).astype(np.int64), len(a))})

    summed = tiles.groupBy("a", "b").applyInArrow(distances, "i long, c long, to long, d double, n long").groupBy("i", "c", "to").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("c") == F.col("to")
    each = summed.groupBy("i").agg(F.max(F.when(own, F.try_divide("d", F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    score = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    clusters_ = rows.agg(F.count_distinct("c").alias("k"), F.count("*").alias("rows"))
    return each.agg(F.avg(score).alias("s")).crossJoin(clusters_).select(F.when((F.col("k") > 1) & (F.col("k") < F.col("rows")), F.col("s")).alias("silhouette"))


#: Samples of a matrix whose Gram matrix the driver takes apart.
MAX_SAMPLES = 4000


def wide_pca(values: DataFrame, k: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """(scores (sample_id, label, pc, score), loadings (feature, pc, loading), shares of variance) of few samples and any features.

    values: (sample_id, feature, x, label), missing as 0. The samples' Gram matrix of centred features is summed over the
    features, a matrix of features at a time; its eigenvectors give the scores, and one aggregate over the features the
    loadings. Nothing has a column a feature. Of a component's two signs, that with its largest score positive.
    """
    spark = values.sparkSession
    samples = values.select("sample_id", "label").distinct()
    if (n := samples.count()) > MAX_SAMPLES:
        raise ValueError(f"{n} samples are too many for their Gram matrix; use pca")
    ids = sorted(r.sample_id for r in samples.collect())  # at most MAX_SAMPLES
    at = spark.createDataFrame(list(zip(ids, range(n))), "sample_id long, i int")
    cells = values.select("sample_id", "feature", F.coalesce(F.nanvl(F.col("x").cast("double"), F.lit(None)), F.lit(0.0)).alias("x")).join(F.broadcast(at), "sample_id").select("feature", "i", "x")
    dealt = cells.repartition("feature").sortWithinPartitions("feature")
    step = max(1, (1 << 22) // max(1, n))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block, columns, last = np.zeros((n, n)), np.zeros((step, n)), 0, None
        for batch in batches:
            names, i, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = np.flatnonzero(names[1:] != names[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(names)], strict=True):
                if a == b:
                    continue
                if names[a] != last:
                    if columns == step:
                        m = block - block.mean(1, keepdims=True)
                        total += m.T @ m
                        block[:], columns = 0, 0
                    last, columns = names[a], columns + 1
                np.add.at(block[columns - 1], i[a:b], x[a:b])
        m = block[:columns] - block[:columns].mean(1, keepdims=True)
        total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"i": t["i"][:1], "row": pa.array([np.sum([np.array(r) for r in t["row"].to_pylist()], axis=0)], pa.list_(pa.float64()))})

    rows = dealt.mapInArrow(gram, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").toArrow()
    g = np.zeros((n, n))
    for i, row in zip(rows["i"].to_pylist(), rows["row"].to_pylist(), strict=True):
        g[i] = row
    value, vector = np.linalg.eigh(g)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    k = min(k, n)
    u, size = vector[:, :k].copy(), np.sqrt(value[:k])
    u *= np.where(u[np.abs(u).argmax(0), np.arange(k)] < 0, -1.0, 1.0) if n else 1.0
    scores = spark.createDataFrame([(ids[i], c, float(u[i, c] * size[c])) for i in range(n) for c in range(k)], "sample_id long, pc int, score double").join(F.broadcast(samples), "sample_id")
    known = spark.createDataFrame([(i, [float(v) for v in u[i]]) for i in range(n)], "i int, u array<double>")
    sums = cells.join(F.broadcast(known), "i").groupBy("feature").agg(*[F.sum(F.col("x") * F.col("u")[c]).alias(f"s{c}") for c in range(k)])
    # left vectors add up to 0, so the features' means drop out
    parts = [F.struct(F.lit(c).alias("pc"), F.when(F.lit(bool(size[c] > 1e-9 * size[0])), F.col(f"s{c}") / float(max(size[c], 1e-300))).alias("loading")) for c in range(k)]
    loadings = sums.select("feature", F.explode(F.array(*parts)).alias("p")).select("feature", "p.pc", "p.loading")
    total = value.sum()
    return scores.select("sample_id", "label", "pc", "score"), loadings, [float(v / total) if total > 0 else 0.0 for v in value[:k]]


def latent_axis_scores(data: DataFrame, names: list[str], k: int) -> DataFrame:
    """feature, score: squared loadings weighted by the components' variances."""
    _, loadings, share = pca(data, k)
    return data.sparkSession.createDataFrame([(n, float(s)) for n, s in zip(names, (loadings**2) @ share, strict=True)], "feature string, score double")


def top_loadings(data: DataFrame, names: list[str], k: int, m: int) -> DataFrame:
    """pc, feature, loading: the m largest of each component by size."""
    _, loadings, _ = pca(data, k)
    rows = [(pc, n, float(loadings[i, pc])) for pc in range(k) for i, n in enumerate(names)]
    df = data.sparkSession.createDataFrame(rows, "pc int, feature string, loading double").withColumn("size", F.abs("loading"))
    return ranking.ranked(df, ["pc"], "size").filter(F.col("rank") <= m).drop("size")


def clusters(data: DataFrame, k: int, n_pcs: int, seed: int = 0) -> DataFrame:
    """ari, nmi, silhouette of k-means on scaled components; silhouette NULL for fewer than two clusters."""
    model = PCA(k=n_pcs, inputCol="features", outputCol="pcs").fit(scaled(data))
    fit = KMeans(k=k, seed=seed, featuresCol="pcs", initSteps=5).fit(model.transform(scaled(data)))
    path = sinks.workspace(data.sparkSession, "clusters")
    fit.transform(model.transform(scaled(data))).select("sample_id", "label", "pcs", "prediction").write.parquet(path)
    pred = data.sparkSession.read.parquet(path)
    return fold_ops.ari_nmi(pred, F.col("label"), F.col("prediction")).crossJoin(F.broadcast(silhouette(pred, "pcs")))


def huber_line(rows: DataFrame, x: str, y: str, epsilon: float = 1.35) -> tuple[float, float]:
    """(intercept, slope) with Huber's loss."""
    data = rows.select(array_to_vector(F.array(F.col(x).cast("double"))).alias("features"), F.col(y).cast("double").alias("label"))
    m = LinearRegression(loss="huber", epsilon=epsilon).fit(data)
    return float(m.intercept), float(m.coefficients[0])


