"""Histogram boosting over a cluster: the trees of trees.boosted for matrices that no task holds.

Features are cut into quantile bins once and the codes written. A level of all trees of a round is one job: each task routes its
rows through the splits made so far, sums first and second derivatives by (node, feature, bin) and sends the cells that are not
empty; Spark adds them up, running sums over a node's bins give every split's gain, and the best row of each node goes to the
driver. So what the driver holds is the trees, whose size is set by rounds, classes and depth alone. Every REFRESH rounds the
rows' scores are written anew, so a task never applies more trees than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks
from . import ablate, learn, trees

REFRESH = 10
#: Bin ends that the driver gathers: bins times features.
MAX_CUTS = 8_000_000
ROW = "sample_id long, label int, weight double, code array<int>, score array<double>"


def cut_points(data: DataFrame, bins: int) -> list[np.ndarray]:
    """Upper ends of each feature's bins, by quantile sketches of all features at once."""
    first = data.first()
    p = len(first.x) if first else 0
    if p * bins > MAX_CUTS:
        raise ValueError(f"{p} features with {bins} bins are too many; take fewer bins")
    quantiles = F.percentile_approx("v", F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(10_000))
    found = data.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(quantiles.alias("q"), F.max("v").alias("top")).collect()  # a row a feature
    out = [np.zeros(0)] * p
    for r in found:
        ends = np.unique(np.array(r.q))
        out[r.i] = ends[ends < r.top]
    return out


def write(rows: DataFrame) -> DataFrame:
    path = sinks.workspace(rows.sparkSession, "boost")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(ROW).parquet(path)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def coded(data: DataFrame, cuts: list[np.ndarray], classes: np.ndarray, weights: np.ndarray, start: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label = np.searchsorted(classes, batch.column(1).to_numpy())
                codes = trees.binned(matrix(batch.column(2)), cuts)
                scores = np.repeat(start[None, :], len(label), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), pa.array(weights[label]), pa.array(list(codes), pa.list_(pa.int32())), pa.array(list(scores), pa.list_(pa.float64()))], ["sample_id", "label", "weight", "code", "score"])

    return write(data.select("sample_id", F.col("label").cast("double").alias("label"), "x").mapInArrow(run, ROW))


def added(scores: np.ndarray, codes: np.ndarray, rounds: list[trees.Nodes]) -> np.ndarray:
    for nodes in rounds:
        scores = scores + nodes.value[nodes.leaf(codes, scores.shape[1])].T
    return scores


def rescored(rows: DataFrame, rounds: list[trees.Nodes]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = added(matrix(batch.column(4)), matrix(batch.column(3)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(scores), pa.list_(pa.float64()))], batch.schema.names)

    return write(rows.mapInArrow(run, ROW))


def level_splits(rows: DataFrame, rounds: list[trees.Nodes], nodes: trees.Nodes, open_nodes: np.ndarray, columns: np.ndarray, classes: int, bins: int, round_: int, s: trees.Boosting, seed: int) -> list:
    """(node, gain, feature, bin, g, h, gl, hl) of each open node: its best split (gain NULL without one) and its sums."""
    shared = rows.sparkSession.sparkContext.broadcast((rounds, nodes, open_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, now, wanted = shared.value
        place = np.full(len(now.feature), -1)
        place[wanted] = np.arange(len(wanted))
        p = columns.shape[1]
        step = max(1, trees.CELLS // (p * bins))
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            use = trees.drawn_rows(seed, round_, ids, s.row_share)
            if not use.any():
                continue
            label, weight, codes, scores = batch.column(1).to_numpy()[use], batch.column(2).to_numpy()[use], matrix(batch.column(3))[use], matrix(batch.column(4))[use]
            hot = (label[:, None] == np.arange(classes)).astype(float)
            grad, hess = trees.gradients(added(scores, codes, past), hot, weight, s.hessian_factor)
            tree, row = np.nonzero(place[leaves := now.leaf(codes, len(grad))] >= 0)
            at = place[leaves[tree, row]]
            g, h, code = grad[tree, row], hess[tree, row], codes[row[:, None], columns[tree]]
            for a in range(0, len(wanted), step):
                mine = (at >= a) & (at < a + step)
                cell = (((at[mine] - a) * p)[:, None] + np.arange(p)) * bins + code[mine]
                size = min(step, len(wanted) - a) * p * bins
                found = np.stack([np.bincount(cell.ravel(), np.repeat(w[mine], p), size) for w in (g, h)] + [np.bincount(cell.ravel(), minlength=size)])
                held[a] = held[a] + found if a in held else found
        for a, found in held.items():
            cell = np.flatnonzero(found[2])
            node, rest = np.divmod(cell, p * bins)
            at_column, bin_ = np.divmod(rest, bins)
            ids = wanted[a + node]
            root = now.value[ids].astype(int)  # while a round grows, a node's value is its tree
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(columns[root, at_column]), pa.array(bin_), *(pa.array(x[cell]) for x in found)], ["node", "feature", "bin", "g", "h", "n"])

    cells = rows.mapInArrow(run, "node long, feature long, bin long, g double, h double, n double").groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    of = Window.partitionBy("node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.withColumns({f"{c}l": F.sum(c).over(upto) for c in "ghn"} | {f"{c}a": F.sum(c).over(of) for c in "ghn"})
    ok = (F.col("nl") < F.col("na")) & (F.least("nl", F.col("na") - F.col("nl")) >= s.least_rows) & (F.least("hl", F.col("ha") - F.col("hl")) >= s.least_hessian)
    part = lambda g, h: g * g / (h + s.l2)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")) - part(F.col("ga"), F.col("ha"))
    row = F.struct(F.when(ok, gain).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", F.col("ga").alias("g"), F.col("ha").alias("h"))
    best = sums.select("node", row.alias("s")).groupBy("node").agg(F.max("s").alias("s")).select("node", "s.*").collect()
    shared.unpersist()
    return best


def grow(rows: DataFrame, rounds: list[trees.Nodes], columns: np.ndarray, classes: int, bins: int, round_: int, s: trees.Boosting, seed: int) -> trees.Nodes:
    """The trees of one round, level by level."""
    count = len(columns)
    feature, cut, left, tree = np.full(count, -1), np.zeros(count, int), np.zeros(count, int), np.arange(count)
    g, h = np.zeros(count), np.zeros(count)
    front = np.arange(count)
    for level in range(s.depth):
        growing = trees.Nodes(feature, cut, left, tree.astype(float))
        found = {r.node: r for r in level_splits(rows, rounds, growing, front, columns, classes, bins, round_, s, seed)}
        if level == 0:
            for i, r in found.items():
                g[i], h[i] = r.g, r.h
        split = [i for i in front.tolist() if i in found and found[i].gain is not None and found[i].gain > trees.LEAST_GAIN]
        if not split:
            break
        size = len(feature)
        for k, i in enumerate(split):
            feature[i], cut[i], left[i] = -found[i].f, -found[i].b, size + 2 * k
        grow_by = 2 * len(split)
        feature, cut, left = np.append(feature, np.full(grow_by, -1)), np.append(cut, np.zeros(grow_by, int)), np.append(left, np.zeros(grow_by, int))
        tree = np.append(tree, np.repeat(tree[split], 2))
        g = np.append(g, [x for i in split for x in (found[i].gl, g[i] - found[i].gl)])
        h = np.append(h, [x for i in split for x in (found[i].hl, h[i] - found[i].hl)])
        front = size + np.flatnonzero(h[size:] >= 2 * s.least_hessian)
        if not len(front):
            break
    return trees.Nodes(feature, cut, left, np.where(h + s.l2 > 0, -s.rate * g / np.maximum(h + s.l2, 1e-300), 0.0))


def fit(data: DataFrame, s: trees.Boosting = trees.BOOSTING["xgb"], seed: int = 0, bins: int = trees.MAX_BINS, cuts: list[np.ndarray] | None = None) -> trees.Boosted:
    """The booster of data (sample_id, label, x array<double>); levels only, no best-first or first-order growth."""
    if s.leaves or s.first_order:
        raise ValueError("only level-wise second-order boosting runs over a cluster")
    counts = {float(r.label): r["count"] for r in data.groupBy("label").count().collect()}  # a row a class
    classes = np.array(sorted(counts))
    n = np.array([counts[c] for c in classes])
    weights = n.sum() / (len(n) * np.maximum(n, 1))
    cuts = cut_points(data, bins) if cuts is None else cuts
    count, p = 1 if len(classes) == 2 else len(classes), len(cuts)
    model = trees.Boosted(cuts, classes, np.zeros(count))
    rows, pending = coded(data, cuts, classes, weights, model.start), []
    for r in range(s.rounds):
        nodes = grow(rows, pending, trees.drawn_columns(seed, r, count, p, s.column_share), len(classes), 1 + max(map(len, cuts), default=0), r, s, seed)
        model.rounds.append(nodes)
        pending.append(nodes)
        if len(pending) == REFRESH and r + 1 < s.rounds:
            rows, pending = rescored(rows, pending), []
    return model


def predict(model: trees.Boosted, data: DataFrame) -> DataFrame:
    """sample_id, y, p."""
    shared = data.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.predict(matrix(batch.column(2))), pa.float64())], ["sample_id", "y", "p"])

    return data.select("sample_id", F.col("label").cast("double").alias("y"), "x").mapInArrow(run, "sample_id long, y double, p double")


def arrays(data: DataFrame) -> DataFrame:
    """learn.vectors' rows as this module takes them."""
    return data.select("sample_id", F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))


def out_of_fold(values: DataFrame, folds: DataFrame, seed: int = 0) -> DataFrame:
    """sample_id, repeat, y, p of the xgb settings: fits in tasks if the matrix fits into one, else one after another on the cluster."""
    if values.count() <= ablate.MAX_CELLS:
        return ablate.predictions(values, folds, ("xgb",), seed).drop("learner")
    data, out = arrays(learn.vectors(values)[0]), None
    for repeat, fold in sorted(tuple(r) for r in folds.select("repeat", "fold").distinct().collect()):
        held = folds.filter((F.col("repeat") == repeat) & (F.col("fold") == fold)).select("sample_id")
        known = folds.filter((F.col("repeat") == repeat) & (F.col("fold") != fold)).select("sample_id")
        p = predict(fit(data.join(known, "sample_id"), seed=seed + 1000 * repeat), data.join(held, "sample_id"))
        p = p.select("sample_id", F.lit(repeat).alias("repeat"), "y", "p")
        out = p if out is None else out.unionByName(p)
    return out
