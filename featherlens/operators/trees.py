"""Trees of small fits, all trees of a round or a batch grown level by level at once; the work list of ablate runs them.

boosted: second-order boosting on quantile bins, one softmax over all classes. Three settings: xgb (levels), hgb (best leaf
first) and gbc (first-order splits). forest: random forests and extremely random trees by Gini impurity. Every draw is a hash
of the seed and the place it is for, so a fit is the same wherever it runs. boost.py grows the trees of xgb over a cluster.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

MAX_BINS = 256
#: Trees of a forest that grow at once.
BATCH = 25
#: Rows that a forest predicts at a time.
ROWS = 8192


def unit(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) by mixing seed and parts, which broadcast."""
    mask = (1 << 64) - 1
    h = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & mask)
    with np.errstate(over="ignore"):
        for p in (*parts, 0x5851F42D):
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def quantile_cuts(x: np.ndarray, most: int = MAX_BINS) -> list[np.ndarray]:
    """Of each column the upper ends of all bins but the last: all values if they are few, else quantiles."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > most:
            values = np.unique(np.quantile(column, np.arange(1, most) / most, method="lower"))
            cuts.append(values)
        else:
            cuts.append(values[:-1])
    return cuts


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)]).astype(np.int32)


def columnwise(codes: np.ndarray) -> np.ndarray:
    """A row a feature, in bytes where they hold the codes."""
    return np.ascontiguousarray(codes.T, np.uint8 if codes.max(initial=0) < 256 else codes.dtype)


def shares(scores: np.ndarray) -> np.ndarray:
    """Softmax of each row."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Boosting:
    """rounds of trees with learning rate; leaves: best-first up to so many; first_order: splits by squared error of residuals."""

    rounds: int = 400
    rate: float = 0.05
    depth: int = 6
    leaves: int | None = None
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    row_share: float = 0.8
    column_share: float = 0.8
    hessian_factor: float = 2.0
    first_order: bool = False

    @property
    def counts_rows(self) -> bool:
        return self.least_rows > 1 or self.least_hessian <= 0


#: The reference's settings; hgb's depth is what 15 leaves can reach.
BOOSTING = {
    "xgb": Boosting(),
    "xgb4": Boosting(depth=4),
    "hgb": Boosting(depth=14, leaves=15, l2=0.1, least_hessian=1e-3, least_rows=5, row_share=1.0, column_share=1.0, hessian_factor=1.0),
    "gbc": Boosting(depth=3, l2=0.0, least_hessian=0.0, row_share=1.0, column_share=1.0, first_order=True),
}
LEAST_GAIN = 1e-9
#: Histogram cells that are held at once.
CELLS = 1 << 22
#: Cells whose splits are compared at once, few enough for a processor's cache.
NEAR = 1 << 16


@dataclass
class Nodes:
    """Nodes of several trees; tree t's root is node t. feature is -1 at leaves; rows with a code (or value) up to cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray | None = None
    weight: np.ndarray | None = None

    def tree(self, t: int) -> tuple[np.ndarray, ...]:
        """(feature or -1, cut, left, right, value, weight) of tree t's own nodes, its root first."""
        ids = level = np.array([t])
        while len(level := np.concatenate([self.left[inner := level[self.feature[level] >= 0]], self.left[inner] + 1])):
            ids = np.concatenate([ids, level])
        place = np.full(len(self.feature), -1)
        place[ids] = np.arange(len(ids))
        split = self.feature[ids] >= 0
        left, right = (np.where(split, place[np.where(split, self.left[ids] + side, 0)], -1) for side in (0, 1))
        return self.feature[ids], self.cut[ids], left, right, self.value[ids], self.weight[ids]

    def leaf(self, x: np.ndarray, trees: int) -> np.ndarray:
        """(trees, rows): the leaf that each row of x reaches."""
        at = np.repeat(np.arange(trees)[:, None], len(x), 1)
        rows = np.arange(len(x))[None, :]
        while (inner := self.feature[at] >= 0).any():
            right = x[rows, np.maximum(self.feature[at], 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return at


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray | None, s: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of each node from its histograms (nodes, features, bins); gain -inf where nothing may be parted.

    A split's gain is GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2); ties go to the smallest feature, then bin. n, the
    rows, may be left out where the least hessian already keeps both sides from being empty.
    """
    gl, hl = g.cumsum(2), h.cumsum(2)
    g, h, gl, hl = gl[..., -1:], hl[..., -1:], gl[..., :-1], hl[..., :-1]
    hr, gr = h - hl, g - gl
    bad = np.minimum(hl, hr) < s.least_hessian
    if n is not None:
        nl = n.cumsum(2)
        bad |= np.minimum(nl[..., :-1], nl[..., -1:] - nl[..., :-1]) < s.least_rows
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl
        gain /= hl + s.l2
        gr *= gr
        hr += s.l2
        gr /= hr
        gain += gr
        gain[bad] = -np.inf
        gain -= g * g / (h + s.l2)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1) if flat.shape[1] else np.zeros(len(gain), int)
    top = flat[np.arange(len(gain)), best] if flat.shape[1] else np.full(len(gain), -np.inf)
    return top, *np.divmod(best, max(1, gain.shape[2]))


def grow(codes: np.ndarray, bins: int, grad: np.ndarray, hess: np.ndarray, use: np.ndarray, s: Boosting, columns: np.ndarray, by_column: np.ndarray | None = None) -> Nodes:
    """One tree for each row of grad and hess (trees, samples), from the samples in use; columns (trees, some), ascending: its
    features; by_column: columnwise(codes), if known."""
    trees, p, own = len(grad), columns.shape[1], np.flatnonzero(use)
    tree, row = np.repeat(np.arange(trees), len(own)), np.tile(own, trees)
    used = (columnwise(codes) if by_column is None else by_column).take(own, axis=1)
    g, h, code = grad[:, own].ravel(), hess[:, own].ravel(), np.concatenate([used[mine] for mine in columns], axis=1)
    at, tree_of, out = tree, np.arange(trees), Nodes(*(np.zeros(0, kind) for kind in (int, int, int, float, float)))
    for level in range(s.depth + 1):
        k, size = len(tree_of), len(out.feature)
        n_node, g_node, h_node = np.bincount(at, minlength=k), np.bincount(at, g, k), np.bincount(at, h, k)
        feature, cut, gain = np.full(k, -1), np.zeros(k, int), np.zeros(k)
        may = (h_node >= 2 * s.least_hessian) & (n_node >= 2 * s.least_rows) & (level < s.depth)
        ids = np.flatnonzero(may)
        for a in range(0, len(ids), step := max(1, CELLS // (p * bins))):
            part = ids[a : a + step]
            number = np.full(k + 1, -1)
            number[part] = np.arange(len(part))
            mine = np.flatnonzero(number[at] >= 0)
            whole = len(mine) == len(at)
            first, weights = number[at[mine]] * bins, [g[mine], h[mine], *([None] if s.counts_rows else [])]
            hist = np.empty((len(weights), len(part), p, bins))
            for j in range(p):
                cell = first + (code[j] if whole else code[j].take(mine))
                for found, w in zip(hist, weights, strict=True):
                    found[:, j] = np.bincount(cell, w, len(part) * bins).reshape(len(part), bins)
            few = max(1, NEAR // (p * bins))
            top, f, c = (np.concatenate(found) for found in zip(*(best_splits(*part_of, *([] if s.counts_rows else [None]), s) for b in range(0, len(part), few) for part_of in [hist[:, b : b + few]]), strict=True))
            found = top > LEAST_GAIN
            feature[part[found]] = columns[tree_of[part[found]], f[found]]
            cut[part[found]], gain[part[found]] = c[found], top[found]
        split = feature >= 0
        left = np.where(split, size + k + 2 * (np.cumsum(split) - 1), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.nan_to_num(-g_node / (h_node + s.l2))
        out = Nodes(*(np.concatenate([x, y]) for x, y in zip((out.feature, out.cut, out.left, out.value, out.gain), (feature, cut, left, value, gain), strict=True)))
        if not split.any():
            break
        goes_on = np.flatnonzero(split[at])
        at = 2 * (np.cumsum(split) - 1)[at[goes_on]] + (codes[row[goes_on], feature[at[goes_on]]] > cut[at[goes_on]])
        tree, row, g, h, code = tree[goes_on], row[goes_on], g[goes_on], h[goes_on], code.take(goes_on, axis=1)
        tree_of = np.repeat(tree_of[split], 2)
        if s.leaves:  # what the queue passes over with few splits known it never takes with more
            kept = best_first(out, trees, s.leaves)
            alive = np.flatnonzero(np.repeat(kept[size : size + k][split], 2)[at])
            at, tree, row, g, h, code = at[alive], tree[alive], row[alive], g[alive], h[alive], code.take(alive, axis=1)
    if s.leaves:
        out.feature = np.where(best_first(out, trees, s.leaves), out.feature, -1)
    return out


def best_first(nodes: Nodes, trees: int, leaves: int) -> np.ndarray:
    """Which splits a queue of the best leaf makes until a tree has its leaves; gains don't hang on the order of splits."""
    keep, known = np.zeros(len(nodes.feature), bool), len(nodes.feature)
    for t in range(trees):
        queue = [(-nodes.gain[t], t)]
        for _ in range(leaves - 1):
            while queue and nodes.feature[queue[0][1]] < 0:
                heapq.heappop(queue)
            if not queue:
                break
            _, i = heapq.heappop(queue)
            keep[i] = True
            for c in (nodes.left[i], nodes.left[i] + 1):
                if c < known:
                    heapq.heappush(queue, (-nodes.gain[c], c))
    return keep


def gradients(scores: np.ndarray, hot: np.ndarray, weight: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives (classes, samples) of the weighted log loss; two classes have one score."""
    p = shares(scores) if scores.shape[1] > 1 else 1 / (1 + np.exp(-scores))
    hot = hot if scores.shape[1] > 1 else hot[:, 1:]
    factor = factor if scores.shape[1] > 1 else 1.0
    return ((p - hot) * weight[:, None]).T, np.maximum(factor * p * (1 - p) * weight[:, None], 1e-16).T


def drawn_rows(seed: int, round_: int, row: np.ndarray, share: float) -> np.ndarray:
    """Which rows (by their hashes or numbers) a round takes."""
    return unit(seed, 1, round_, row) < share if share < 1 else np.ones(len(row), bool)


def drawn_columns(seed: int, round_: int, trees: int, p: int, share: float) -> np.ndarray:
    """(trees, some), ascending: the features of each tree."""
    take = max(1, int(share * p))
    return np.sort(np.argsort(unit(seed, 2, round_, np.arange(trees)[:, None], np.arange(p)[None, :]), axis=1)[:, :take], axis=1)


class Boosted:
    """A fitted booster: nodes of each round, one tree a class (one for two classes), and the scores to start from."""

    def __init__(self, cuts: list[np.ndarray], classes: np.ndarray, start: np.ndarray) -> None:
        self.cuts, self.classes, self.start, self.rounds = cuts, classes, start, []
        self.losses: list[float] = []

    def scores(self, x: np.ndarray) -> np.ndarray:
        codes = binned(x, self.cuts)
        return self.start + sum((nodes.value[nodes.leaf(codes, len(self.start))].T for nodes in self.rounds), np.zeros((len(x), len(self.start))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        return self.classes[s.argmax(1) if s.shape[1] > 1 else (s[:, 0] > 0).astype(int)]


def class_weight(y: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Of each sample n / (classes * n_class)."""
    n = np.array([(y == c).sum() for c in classes])
    return len(y) / ((n > 0).sum() * np.maximum(n, 1))[np.searchsorted(classes, y)]


def boosted(x: np.ndarray, y: np.ndarray, classes: np.ndarray, s: Boosting, seed: int = 0, cuts: list[np.ndarray] | None = None) -> Boosted:
    """losses holds the weighted log loss before each round."""
    hot, weight, n = (y[:, None] == classes).astype(float), class_weight(y, classes), len(y)
    cuts = quantile_cuts(x) if cuts is None else cuts
    codes = binned(x, cuts)
    bins, by_column = 1 + max(map(len, cuts), default=0), columnwise(codes)
    trees = 1 if len(classes) == 2 else len(classes)
    share = np.maximum((hot * weight[:, None]).sum(0) / weight.sum(), 1e-12)
    start = np.zeros(trees)
    if s.hessian_factor == 1.0 or s.first_order:  # these start from the classes' log shares
        start = np.log(share) if trees > 1 else np.log(share[1:] / share[:1])
    model, scores = Boosted(cuts, classes, start), np.repeat(start[None, :], n, 0)
    for r in range(s.rounds):
        p = shares(scores) if trees > 1 else np.column_stack([1 / (1 + np.exp(scores)), 1 / (1 + np.exp(-scores))])
        model.losses.append(float(-(weight[:, None] * hot * np.log(np.maximum(p, 1e-300))).sum() / weight.sum()))
        grad, hess = gradients(scores, hot, weight, s.hessian_factor)
        use = drawn_rows(seed, r, np.arange(n), s.row_share)
        if s.first_order:
            curve, hess = hess, np.repeat(weight[None, :], trees, 0)
        nodes = grow(codes, bins, grad, hess, use, s, drawn_columns(seed, r, trees, x.shape[1], s.column_share), by_column)
        leaf = nodes.leaf(codes, trees)
        if s.first_order:  # Newton's step in each leaf
            g, h = (np.bincount(leaf.ravel(), x_.ravel(), len(nodes.value)) for x_ in (grad, curve))
            nodes.value = -(1 - 1 / len(classes) if trees > 1 else 1) * g / np.maximum(h, 1e-150)
        nodes.value = s.rate * nodes.value
        scores = scores + nodes.value[leaf].T
        model.rounds.append(nodes)
    return model


class Forest:
    """Averages of the leaves' class shares; a batch of trees is grown when it is asked and not kept, since leaves grow with the rows."""

    def __init__(self, classes: np.ndarray, trees: int, grown: Callable[[int, int], Nodes]) -> None:
        """grown(first, until): these trees."""
        self.classes, self.trees, self.grown = classes, trees, grown

    def shares(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(self.classes)))
        for a in range(0, self.trees, BATCH):
            b = min(self.trees, a + BATCH)
            nodes = self.grown(a, b)
            for i in range(0, len(x), ROWS):
                total[i : i + ROWS] += nodes.value[nodes.leaf(x[i : i + ROWS], b - a)].sum(0)
            del nodes  # before the next batch grows
        return total / max(self.trees, 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.shares(x).argmax(1)]


def column_ranks(x: np.ndarray) -> np.ndarray:
    """Of each value the number of smaller distinct values in its column."""
    ranks = np.zeros(x.shape, np.int32)
    for j, column in enumerate(x.T):
        ranks[:, j] = np.unique(column, return_inverse=True)[1]
    return ranks


def by_rank(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """np.lexsort((rank, at)), by one sort of whole numbers where node, rank and place fit into 63 bits."""
    bits = [int(v).bit_length() for v in (at.max(), rank.max(), len(at))]
    if sum(bits) > 63:
        return np.lexsort((rank, at))
    return np.sort((((at.astype(np.int64) << bits[1]) | rank) << bits[2]) | np.arange(len(at))) & ((1 << bits[2]) - 1)


#: Scores of splits, which are shares of the unsplit node's, count to this precision, so that equal ones tie.
TIE = 1 << 30


def node_splits(x: np.ndarray, ranks: np.ndarray | None, row: np.ndarray, at: np.ndarray, cls: np.ndarray, w: np.ndarray, sums: np.ndarray, names: np.ndarray, seed: int, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, feature, cut) of each node's best split, score -inf without one.

    Rows come by node (at) and class; names: what the nodes' draws go by. Without ranks a feature has one hash-drawn cut, else
    the best of all. A score is the sum of squared class weights over the weight of both sides against the unsplit node's.
    """
    p, (k, c) = x.shape[1], sums.shape
    starts, total, group = np.searchsorted(at, np.arange(k)), sums.sum(1), at * c + cls
    square = (sums**2).sum(1)
    group_starts = np.flatnonzero(np.append(True, group[1:] > group[:-1]))
    group = np.cumsum(np.append(False, group[1:] > group[:-1]))
    across = w * sums[at, cls]
    features = np.argsort(unit(seed, 3, names[:, None], np.arange(p)[None, :]), axis=1)[:, :take]
    best, feature, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k)
    for j in range(take):
        f = features[at, j]
        score, at_cut = np.full(k, -np.inf), np.zeros(k)
        if ranks is None:
            v = x[row, f]
            low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
            at_cut = low + unit(seed, 4, names, j) * (high - low)
            side = np.bincount(at * c + cls, w * (v <= at_cut[at]), k * c).reshape(k, c)
            nl, nr = side.sum(1), total - side.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((nl > 0) & (nr > 1e-12 * total) & (high > low), (side**2).sum(1) / nl + ((sums - side) ** 2).sum(1) / nr, -np.inf) * (total / square)
        else:
            r = ranks[row, f]
            by = by_rank(group, r)
            mine = w[by]
            own = np.cumsum(mine) - mine
            step = np.empty(len(w))
            step[by] = mine * (2 * (own - own[group_starts][group]) + mine)  # what a row adds to its side's sum of squares
            by = by_rank(at, r)
            rs = r[by]
            apart = np.flatnonzero((at[1:] == at[:-1]) & (rs[1:] > rs[:-1]))  # a cut may follow these; at[by] is at
            if len(apart):
                ns = at[apart]
                nl, left, both = ((run := np.cumsum(v))[apart] - (run[starts] - v[starts])[ns] for v in (w[by], step[by], across[by]))
                each = left / nl + (square[ns] - 2 * both + left) / (total[ns] - nl)
                each = np.rint(each * (total / square)[ns] * TIE) / TIE
                first = np.flatnonzero(np.append(True, ns[1:] > ns[:-1]))
                nodes = ns[first]
                score[nodes] = np.maximum.reduceat(each, first)
                place = apart[np.minimum.reduceat(np.where(each >= score[ns], np.arange(len(each)), len(each) - 1), first)]
                lower, upper = (x[row[by[place + i]], f[place]] for i in (0, 1))
                middle = (lower + upper) / 2
                at_cut[nodes] = np.where(middle < upper, middle, lower)
        better = score > best
        best, feature, cut = np.where(better, score, best), np.where(better, features[:, j], feature), np.where(better, at_cut, cut)
    return best, feature, cut


def grow_forest(x: np.ndarray, hot: np.ndarray, weight: np.ndarray, extra: bool, seed: int, offset: int, ranks: np.ndarray | None = None) -> Nodes:
    """weight: (trees, samples), 0 for those a tree doesn't have. A node tries the root of the features, hash-drawn.

    extra: one hash-drawn cut between the node's ends a feature, else the best of all. Nodes of one class, or that none of
    their features parts, are leaves. ranks: column_ranks of x, if known.
    """
    trees, _ = weight.shape
    p, c = x.shape[1], hot.shape[1]
    take = max(1, int(np.sqrt(p)))
    ranks = None if extra else column_ranks(x) if ranks is None else ranks
    at, row = np.nonzero(weight > 0)
    w, class_of = weight[at, row], hot.argmax(1)
    k, ids, grown, size = trees, np.arange(trees), [], trees
    while k:
        cls = class_of[row]
        by = np.argsort(at * c + cls, kind="stable")
        at, row, w, cls = at[by], row[by], w[by], cls[by]
        sums = np.bincount(at * c + cls, w, k * c).reshape(k, c)
        mixed = (sums > 0).sum(1) > 1  # the others' rows are done
        best, feature, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k)
        inside = mixed[at]
        at, row, w, cls = at[inside], row[inside], w[inside], cls[inside]
        if len(at):
            number = (np.cumsum(mixed) - 1)[at]
            best[mixed], feature[mixed], cut[mixed] = node_splits(x, ranks, row, number, cls, w, sums[mixed], offset + ids[mixed], seed, take)
        split = best > 1 - 1e-8
        feature = np.where(split, feature, -1)
        child = np.where(split, size + 2 * (np.cumsum(split) - 1), 0)
        grown.append((feature, cut, child, sums / sums.sum(1, keepdims=True), sums.sum(1)))
        keep = split[at]
        at, row, w = at[keep], row[keep], w[keep]
        at = 2 * (np.cumsum(split) - 1)[at] + (x[row, feature[at]] > cut[at])
        k = 2 * int(split.sum())
        ids = size + np.arange(k)
        size += k
    levels, out = [list(y) for y in zip(*grown, strict=True)], []
    del grown
    for y in levels:
        out.append(np.concatenate(y))
        y.clear()  # one copy of a column
    *out, weight = out
    return Nodes(*out, weight=weight)


def forest_part(x: np.ndarray, y: np.ndarray, classes: np.ndarray, extra: bool, first: int, until: int, seed: int, ranks: np.ndarray | None = None) -> Nodes:
    """Trees first to until of forest, if first is a multiple of BATCH and until at most BATCH more; other batches' nodes draw other features."""
    hot, t = (y[:, None] == classes).astype(float), np.arange(first, until)
    if extra:
        weight = np.repeat(class_weight(y, classes)[None, :], len(t), 0)
    else:
        picks = (unit(seed, 5, t[:, None], np.arange(len(y))[None, :]) * len(y)).astype(int)
        times = np.stack([np.bincount(row, minlength=len(y)) for row in picks]).astype(float)
        per_class = times @ hot
        weight = times * (times.sum(1, keepdims=True) / ((per_class > 0).sum(1, keepdims=True) * np.maximum(per_class, 1)))[:, np.searchsorted(classes, y)]
    return grow_forest(x, hot, weight, extra, seed, first << 20, ranks)


def forest(x: np.ndarray, y: np.ndarray, classes: np.ndarray, extra: bool = False, trees: int = 500, seed: int = 0) -> Forest:
    """extra: all samples in every tree and class weights over them; else a bootstrap each, with its own class weights."""
    ranks = None if extra else column_ranks(x)
    return Forest(classes, trees, lambda a, b: forest_part(x, y, classes, extra, a, b, seed, ranks))
