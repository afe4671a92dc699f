"""Gradient-boosted trees on binned features, in numpy. Small and exact enough to be fitted when a job starts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth in heap order: at an inner node, feature <= cut goes left."""

    depth: int
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    features: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: every inner node compares one contiguous column, then each row takes its path."""
        columns = {j: np.ascontiguousarray(x[:, j]) for j in sorted({int(f) for tree in self.features for f in tree})}
        out = np.full(len(x), self.base)
        for cut, feature, value in zip(self.cuts, self.features, self.values, strict=True):
            at = (columns[int(feature[0])] > cut[0]).astype(np.int8)
            for level in range(1, self.depth):
                first, turn = (1 << level) - 1, np.zeros(len(x), bool)
                for k in range(1 << level):
                    if np.isfinite(cut[first + k]):
                        turn |= (at == k) & (columns[int(feature[first + k])] > cut[first + k])
                at = 2 * at + turn
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, numeric: int, trees: int = 60, depth: int = 4, rate: float = 0.25, l2: float = 1.0, bins: int = 16, share_of_rows: float = 0.35, seed: int = 3) -> Boosted:
    """Logistic loss and second-order gains; each tree sees a seeded share of the rows.

    The first `numeric` columns are cut at quantiles, at most `bins` bins each;
    the others are 0 or 1.
    """
    n = len(x)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(numeric)]
    flat_all = np.stack([np.searchsorted(e, x[:, j], side="left") + j * bins for j, e in enumerate(edges)], axis=1)
    names = numeric + np.flatnonzero(x[:, numeric:].any(axis=0))
    flags_all = np.ascontiguousarray(x[:, names], dtype=np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    score = np.full(n, model.base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    rng = np.random.default_rng(seed)
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(n) < share_of_rows)
        flat, flags, own_x = flat_all[rows], flags_all[rows], x[rows]
        p = 1 / (1 + np.exp(-score[rows]))
        gh = np.stack([p - y[rows], p * (1 - p)])
        at = np.zeros(len(rows), np.int64)
        cut, feature = np.full(inner, np.inf), np.zeros(inner, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            own = at - first
            cell = (own[:, None] * (numeric * bins) + flat).ravel()
            member = np.zeros((len(rows), 2 * width), np.float32)
            left, total = [], []
            for q in range(2):
                member[np.arange(len(rows)), own + q * width] = gh[q]
                left.append(np.bincount(cell, np.repeat(gh[q], numeric), width * numeric * bins).reshape(width, numeric, bins).cumsum(axis=2))
                total.append(np.bincount(own, gh[q], width))
            ones = (flags.T @ member).astype(np.float64)
            for k in range(width):
                gt, ht = total[0][k], total[1][k]
                gl = np.concatenate([left[0][k].ravel(), gt - ones[:, k]])
                hl = np.concatenate([left[1][k].ravel(), ht - ones[:, width + k]])
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1.0) | (ht - hl < 1.0)] = 0
                best = int(np.argmax(gain))
                if gain[best] <= 1e-6:
                    continue
                if best >= numeric * bins:
                    cut[first + k], feature[first + k] = 0.5, names[best - numeric * bins]
                elif best % bins < len(edges[best // bins]):
                    cut[first + k], feature[first + k] = edges[best // bins][best % bins], best // bins
            at = 2 * at + 1 + (own_x[np.arange(len(rows)), feature[at]] > cut[at])
        leaf = at - inner
        model.cuts.append(cut)
        model.features.append(feature)
        model.values.append(-rate * np.bincount(leaf, gh[0], leaves) / (np.bincount(leaf, gh[1], leaves) + l2))
        score += Boosted(depth, 0.0, [cut], [feature], [model.values[-1]]).raw(x)
    return model
