"""Linear support vector classifiers: squared hinge loss, one class against the rest, all classes and folds in one optimiser.

Minimises |w|^2 / 2 + cost * sum of weight * max(0, 1 - t (w x + b))^2 with b penalised like a coefficient, on standardised
features; a class's samples weigh n / (classes * n_class) in its problem and the rest 1 (with two classes, each side its own
weight): the reference's objective. The loss is piecewise
quadratic, so Newton's method over the samples inside the margin ends at the optimum after a few steps. LinearSvc fits a
matrix in one task; fit_all sums the steps of every (fold, class) over the cluster in one job a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COST, STEPS, TOLERANCE = 1.0, 50, 1e-8
#: Features (and the intercept) that fit_all takes; a step's sums have their square for every class and fold.
MAX_FEATURES = 1000


def sums(z: np.ndarray, side: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the hinge part at w: over the samples inside the margin."""
    slack = 1 - side * (z @ w)
    inside = slack > 0
    zi, wi, si = z[inside], weight[inside], slack[inside]
    return float((wi * si * si).sum()), -2 * zi.T @ (wi * side[inside] * si), 2 * (zi * wi[:, None]).T @ zi


def side_weights(own: int, n: int, classes: int) -> tuple[float, float]:
    """Weights of a class's samples and of the rest."""
    return n / (classes * max(own, 1)), 1.0 if classes > 2 else n / (2 * max(n - own, 1))


class Newton:
    """One problem's iterate: damped steps, each accepted when it lowers the objective enough; done at a small gradient."""

    def __init__(self, size: int, cost: float) -> None:
        self.cost, self.w, self.done = cost, np.zeros(size), False
        self.value, self.step, self.slope, self.size = np.inf, np.zeros(size), 0.0, 1.0
        self.at = self.w  # where sums are wanted

    def take(self, loss: float, grad: np.ndarray, hess: np.ndarray) -> None:
        value = 0.5 * self.at @ self.at + self.cost * loss
        if value > self.value + 1e-4 * self.size * self.slope + 1e-12 * abs(value):
            self.size /= 2
            self.done = self.size < 1e-10
            self.at = self.w + self.size * self.step
            return
        self.w, self.value = self.at, value
        g = self.w + self.cost * grad
        self.done = np.abs(g).max() <= TOLERANCE * max(1.0, self.cost * len(g))
        self.step = -np.linalg.solve(np.eye(len(g)) + self.cost * hess, g)
        self.slope, self.size = float(g @ self.step), 1.0
        self.at = self.w + self.step


class LinearSvc:
    """The fitted classifier of a matrix; predicts the class of the highest score (two classes: by the score's sign)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: np.ndarray, cost: float = COST) -> None:
        self.classes, self.mean = classes, x.mean(0)
        scale = x.std(0)
        self.scale = np.where(scale > 0, scale, 1.0)
        z, back = (x - self.mean) / self.scale, None
        if x.shape[1] > len(x):  # the optimum lies in the samples' span
            u, s, v = np.linalg.svd(z, full_matrices=False)
            z, back = u * s, v
        z = np.column_stack([z, np.ones(len(x))])
        self.w = []
        for c in classes if len(classes) > 2 else classes[1:]:
            side = np.where(y == c, 1.0, -1.0)
            inside, rest = side_weights(int((y == c).sum()), len(y), len(classes))
            weight, fit = np.where(side > 0, inside, rest), Newton(z.shape[1], cost)
            for _ in range(STEPS):
                fit.take(*sums(z, side, weight, fit.at))
                if fit.done:
                    break
            self.w.append(np.append(fit.w[:-1] @ back, fit.w[-1]) if back is not None else fit.w)
        self.w = np.array(self.w).T

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w[:-1] + self.w[-1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        return self.classes[s.argmax(1) if s.shape[1] > 1 else (s[:, 0] > 0).astype(int)]


def fit_all(data: DataFrame, folds: DataFrame, cost: float = COST) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray, dict, np.ndarray]:
    """(coefficients (features + 1, classes) by (repeat, fold) left out, classes, moments, names of the folds).

    data: sample_id, label, features; folds: sample_id, repeat, fold. Every Newton step of all folds and classes is one job
    whose tasks send sums of their rows; the driver solves systems of the features' size only.
    """
    spark = data.sparkSession
    joined = data.join(folds.select("sample_id", "repeat", "fold"), "sample_id").select("repeat", "fold", "label", vector_to_array("features").alias("x")).persist()
    try:
        pairs = sorted((r["repeat"], r["fold"]) for r in joined.select("repeat", "fold").distinct().collect())
        counts = joined.groupBy("repeat", "fold", "label").count().collect()
        classes = np.unique([r.label for r in counts])
        first = joined.first()
        p = len(first.x) if first else 0
        if p > MAX_FEATURES:
            raise ValueError(f"{p} features are too many for joint Newton steps; fit the matrix by the work list (ablate.predictions)")
        held = joined.select("repeat", "fold", F.posexplode("x").alias("i", "v")).groupBy("repeat", "fold", "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q"))
        own = {key: np.zeros((3, p)) for key in pairs}
        for r in held.collect():  # features times folds
            own[r["repeat"], r["fold"]][:, r.i] = r.n, r.s, r.q
        moments, problems, n_side = {}, {}, {}
        for repeat, fold in pairs:
            n, s, q = sum(v for (r, f), v in own.items() if r == repeat and f != fold) + np.zeros((3, p))
            n = np.maximum(n, 1)
            sd = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
            moments[repeat, fold] = (s / n, np.where(sd > 1e-12 * np.maximum(1, np.abs(s / n)), sd, 1.0))
            for c in classes if len(classes) > 2 else classes[1:]:
                inside = sum(x["count"] for x in counts if x["repeat"] == repeat and x["fold"] != fold and x["label"] == c)
                total = sum(x["count"] for x in counts if x["repeat"] == repeat and x["fold"] != fold)
                problems[repeat, fold, c], n_side[repeat, fold, c] = Newton(p + 1, cost), side_weights(inside, total, len(classes))
        for _ in range(STEPS):
            open_ = {k: v.at for k, v in problems.items() if not v.done}
            if not open_:
                break
            for key, (loss, grad, hess) in newton_sums(joined, open_, moments, n_side, spark).items():
                problems[key].take(loss, grad, hess)
        out = {pair: np.column_stack([v.w for k, v in problems.items() if k[:2] == pair]) for pair in pairs}
        return out, classes, moments, np.array(pairs)
    finally:
        joined.unpersist()


def newton_sums(joined: DataFrame, at: dict, moments: dict, n_side: dict, spark) -> dict:
    """(loss, gradient, Hessian) of each open problem in one job."""
    shared = spark.sparkContext.broadcast((at, moments, n_side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, scales, weights = shared.value
        total: dict = {}
        for batch in batches:
            repeat, fold, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            for r, f in {k[:2] for k in points}:
                train = (repeat == r) & (fold != f)
                mean, sd = scales[r, f]
                z = np.column_stack([(x[train] - mean) / sd, np.ones(int(train.sum()))])
                for key in (k for k in points if k[:2] == (r, f)):
                    side = np.where(label[train] == key[2], 1.0, -1.0)
                    found = sums(z, side, np.where(side > 0, *weights[key]), points[key])
                    total[key] = [a + b for a, b in zip(total[key], found, strict=True)] if key in total else list(found)
        flat = [np.concatenate([[loss], grad, hess[np.triu_indices(len(grad))]]) for loss, grad, hess in total.values()]
        sizes = [len(x) for x in flat]
        columns = [np.repeat([float(key[i]) for key in total], sizes) for i in range(3)]
        place = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(place, pa.int64()), pa.array(np.concatenate(flat) if flat else np.zeros(0))], ["repeat", "fold", "label", "i", "v"])

    parts = joined.mapInArrow(run, "repeat double, fold double, label double, i long, v double").groupBy("repeat", "fold", "label", "i").agg(F.sum("v").alias("v")).toArrow()
    shared.unpersist()
    keys = np.column_stack([parts[c].to_numpy() for c in ("repeat", "fold", "label")])
    place, value, out = parts["i"].to_numpy(), parts["v"].to_numpy(), {}
    for key, w in at.items():
        mine = (keys == np.array(key, float)).all(1)
        flat = np.zeros(1 + len(w) + len(w) * (len(w) + 1) // 2)
        flat[place[mine]] = value[mine]
        upper = np.zeros((len(w), len(w)))
        upper[np.triu_indices(len(w))] = flat[1 + len(w) :]
        out[key] = (float(flat[0]), flat[1 : 1 + len(w)], upper + np.triu(upper, 1).T)
    return out


def out_of_fold(data: DataFrame, folds: DataFrame, cost: float = COST) -> DataFrame:
    """sample_id, repeat, y, p by fit_all."""
    w, classes, moments, _ = fit_all(data, folds, cost)
    shared = data.sparkSession.sparkContext.broadcast((w, classes, moments))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, names, scales = shared.value
        for batch in batches:
            repeat, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            x = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
            p = np.zeros(batch.num_rows)
            for r, f in {*zip(repeat.tolist(), fold.tolist(), strict=True)}:
                mine, (mean, sd) = (repeat == r) & (fold == f), scales[r, f]
                s = (x[mine] - mean) / sd @ models[r, f][:-1] + models[r, f][-1]
                p[mine] = names[s.argmax(1) if s.shape[1] > 1 else (s[:, 0] > 0).astype(int)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(p)], ["sample_id", "repeat", "y", "p"])

    rows = data.join(folds.select("sample_id", "repeat", "fold"), "sample_id").select("sample_id", "repeat", "fold", F.col("label").cast("double").alias("y"), vector_to_array("features").alias("x"))
    return rows.mapInArrow(run, "sample_id long, repeat int, y double, p double")
