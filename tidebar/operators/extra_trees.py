"""Extra-trees regression: importances of all folds and trees at once.

A node looks at a random share of the features, draws one threshold for each between the least and greatest value that its rows have, and
takes the one which lowers the squared error most. Trees grow level by level. A level is two jobs over the rows: ranges of the
candidates in each open node, then weighted sums left of the drawn thresholds. Tasks reduce their rows to such numbers, Spark merges them, and
only they reach the driver: at most folds * trees * 2^level * candidates rows, whatever the number of rows.

Draws depend on seed, fold, tree and node alone, so partitions do not change a tree. Candidates that are constant in a node are passed over; a node
in which all are is a leaf. Features that are constant in a whole fold are no candidates of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in columns])


def _merged(rows: DataFrame, update: Callable[[np.ndarray, np.ndarray, np.ndarray, dict], None], empty: dict[str, np.ndarray],
            features: Sequence[str], weights: Sequence[str], how: dict[str, str]) -> dict[str, np.ndarray]:
    """Arrays like `empty`, flat, updated with the batches of each task and merged over the tasks by `how` (min, max, sum)."""
    names = list(empty)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = {k: v.copy() for k, v in empty.items()}, False
        for batch in batches:
            if batch.num_rows:
                update(_matrix(batch, features), batch["_y"].to_numpy(), _matrix(batch, weights), own)
                seen = True
        if seen:
            at = np.flatnonzero(np.any([own[k] != empty[k] for k in names], axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(own[k][at]) for k in names]], ["_at", *names])

    parts = rows.mapInArrow(task, ", ".join(["_at long", *[f"{k} double" for k in names]]))
    merged = parts.groupBy("_at").agg(*[getattr(F, how[k])(k).alias(k) for k in names]).toPandas()
    out = {k: v.copy() for k, v in empty.items()}
    for k in names:
        out[k][merged["_at"].to_numpy(np.int64)] = merged[k].to_numpy(np.float64)
    return out


def _route(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after `levels` splits, -1 once it has met a leaf. Node k has children 2k + 1 and 2k + 2."""
    at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(levels):
        split = np.where(node < 0, -1, feature[node])
        node = np.where(split < 0, -1, 2 * node + 1 + (x[at, split] > threshold[node]))
    return node


def node_draws(seed: int, fold: int, tree: int, node: int, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the features, a uniform number for each place in it) of a node."""
    rng = np.random.default_rng([seed, fold, tree, node])
    return rng.permutation(n_features), rng.random(n_features)


def importances(rows: DataFrame, features: Sequence[str], weights: Sequence[str], trees: int = 50, depth: int = 4, feature_share: float = 0.3,
                seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(importance, sign) per fold and feature, from stored `rows` of finite doubles: `_y`, `features` and a weight column for each fold.

    Importances are shares of the error taken away, averaged over the trees that split at all; zeros where none does. A sign is that of the weighted
    covariance with `_y`, 0 for a constant feature.
    """
    features, weights = list(features), list(weights)
    n, folds = len(features), len(weights)
    candidates = max(1, int(feature_share * n))
    means = rows.agg(*[F.coalesce(F.avg(f"`{c}`"), F.lit(0.0)) for c in ["_y", *features]]).first()
    y_mean, x_mean = means[0], np.array(means[1:], np.float64)

    def whole_folds(x, y, w, own):
        y, shifted = y - y_mean, x - x_mean
        for f in range(folds):
            use, at = w[:, f] > 0, slice(f * n, f * n + n)
            if use.any():
                wf = w[use, f]
                own["lo"][at] = np.minimum(own["lo"][at], x[use].min(axis=0))
                own["hi"][at] = np.maximum(own["hi"][at], x[use].max(axis=0))
                own["w"][at] += wf.sum()
                own["wx"][at] += wf @ shifted[use]
                own["wy"][at] += wf @ y[use]
                own["wxy"][at] += (wf * y[use]) @ shifted[use]

    empty = {"lo": np.full(folds * n, np.inf), "hi": np.full(folds * n, -np.inf), **{k: np.zeros(folds * n) for k in ("w", "wx", "wy", "wxy")}}
    first = _merged(rows, whole_folds, empty, features, weights, {"lo": "min", "hi": "max", **dict.fromkeys(("w", "wx", "wy", "wxy"), "sum")})
    varies = (first["lo"] < first["hi"]).reshape(folds, n)
    sign = np.sign(first["wxy"] - first["wx"] * first["wy"] / np.maximum(first["w"], 1e-300)).reshape(folds, n) * varies

    split = np.full((folds, trees, (1 << depth) - 1), -1, np.int64)
    threshold = np.zeros(split.shape)
    gained = np.zeros((folds, trees, n))
    open_ = np.zeros(split.shape, bool)
    if depth:
        open_[:, :, 0] = varies.any(axis=1)[:, None]
    for level in range(depth):
        base, width = (1 << level) - 1, 1 << level
        shape = (folds, trees, width, candidates)
        cand, draw = np.full(shape, -1, np.int64), np.zeros(shape)
        for f, t, s in np.argwhere(open_[:, :, base:base + width]):
            order, u = node_draws(seed, f, t, base + s, n)
            keep = varies[f][order]
            own = order[keep][:candidates]
            cand[f, t, s, :len(own)], draw[f, t, s, :len(own)] = own, u[keep][:candidates]
        if (cand < 0).all():
            break

        def in_nodes(x, w, visit, level=level, base=base, width=width, cand=cand):
            """Call visit(fold, tree, slot, rows of the node, its candidates) for every open node that has rows."""
            for f in range(folds):
                use = np.flatnonzero(w[:, f] > 0)
                for t in range(trees):
                    node = _route(x[use], split[f, t], threshold[f, t], level)
                    order = np.argsort(node, kind="stable")
                    ends = np.searchsorted(node[order], np.arange(base, base + width + 1))
                    for s in range(width):
                        own, c = use[order[ends[s]:ends[s + 1]]], cand[f, t, s]
                        c = c[c >= 0]
                        if len(own) and len(c):
                            visit(f, t, s, own, c)

        flat = lambda f, t, s, c, shape=shape: slice((k := int(np.ravel_multi_index((f, t, s, 0), shape))), k + len(c))

        def ranges(x, y, w, own):
            def visit(f, t, s, rows_, c):
                part, at = x[np.ix_(rows_, c)], flat(f, t, s, c)
                own["lo"][at] = np.minimum(own["lo"][at], part.min(axis=0))
                own["hi"][at] = np.maximum(own["hi"][at], part.max(axis=0))

            in_nodes(x, w, visit)

        size = cand.size
        got = _merged(rows, ranges, {"lo": np.full(size, np.inf), "hi": np.full(size, -np.inf)}, features, weights, {"lo": "min", "hi": "max"})
        lo, hi = got["lo"].reshape(shape), got["hi"].reshape(shape)
        fine = (cand >= 0) & (lo < hi)
        lo, hi = np.where(fine, lo, 0.0), np.where(fine, hi, 0.0)
        cut = lo + draw * (hi - lo)
        cut = np.where(cut >= hi, lo, cut)

        def sums(x, y, w, own, cut=cut):
            y = y - y_mean

            def visit(f, t, s, rows_, c):
                left, at = x[np.ix_(rows_, c)] <= cut[f, t, s, :len(c)], flat(f, t, s, c)
                wf = w[rows_, f]
                wy = wf * y[rows_]
                own["n_left"][at] += wf @ left
                own["s_left"][at] += wy @ left
                own["n"][at] += wf.sum()
                own["s"][at] += wy.sum()

            in_nodes(x, w, visit)

        names = ("n_left", "s_left", "n", "s")
        got = _merged(rows, sums, {k: np.zeros(size) for k in names}, features, weights, dict.fromkeys(names, "sum"))
        nl, sl, total, s_all = (got[k].reshape(shape) for k in names)
        nr, sr = total - nl, s_all - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fine & (nl > 0) & (nr > 0), sl * sl / nl + sr * sr / nr - s_all * s_all / total, -np.inf)
        best = gain.argmax(axis=3)
        for f, t, s in np.argwhere(np.isfinite(gain.max(axis=3))):
            k = best[f, t, s]
            node = base + s
            split[f, t, node], threshold[f, t, node] = cand[f, t, s, k], cut[f, t, s, k]
            gained[f, t, cand[f, t, s, k]] += max(gain[f, t, s, k], 0.0)
            if level + 1 < depth:
                open_[f, t, 2 * node + 1:2 * node + 3] = True

    grown = split[:, :, :1].max(axis=2, initial=-1) >= 0
    share = gained / np.maximum(gained.sum(axis=2, keepdims=True), 1e-300)
    mean = share.sum(axis=1) / np.maximum(grown.sum(axis=1), 1)[:, None]
    return mean / np.maximum(mean.sum(axis=1, keepdims=True), 1e-300), sign
