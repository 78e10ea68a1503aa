"""Histogram gradient-boosted trees for a yes/no label, in numpy.

Training bins every feature once (at most ``BINS`` cuts), then grows depth-limited
trees from histograms of gradients. A fitted model is a handful of flat arrays: all
nodes of all trees, addressed by index, so scoring walks every row down every tree
with array gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """Flattened trees. A leaf points to itself, so walks need no test for the end."""

    feature: np.ndarray  # int32 per node
    cut: np.ndarray  # go right if the value is above it
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 per row of ``x``."""
        rows = np.arange(len(x))[:, None]
        at = np.repeat(self.roots[None, :], len(x), 0)
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] > self.cut[at], self.right[at], self.left[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: int = 10, l2: float = 1.0) -> Trees:
    """Boost ``trees`` trees on the log loss.

    With no rows or one class only, the model has no tree and answers that class's
    smoothed share.
    """
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(value)
        feature.append(0)
        cut.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(0.0)
        return k

    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)] if n else []
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1) if n else np.zeros((0, width), int)
    slot = np.arange(width) * BINS
    margin = np.full(n, base)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        level = [(root, np.arange(n))]
        for d in range(depth + 1):
            below = []
            for k, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if d < depth and len(rows) >= 2 * least:
                    places = (binned[rows] + slot).ravel()
                    many = np.bincount(places, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                    gl = np.bincount(places, np.repeat(grad[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                    hl = np.bincount(places, np.repeat(hess[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                    gain[(many < least) | (len(rows) - many < least)] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    best = (f, b) if gain[f, b] > 1e-6 else None
                if best is None:
                    value[k] = rate * g / (h + l2)
                    margin[rows] += value[k]
                    continue
                f, b = best
                feature[k], cut[k] = int(f), float(edges[f][b])
                left[k], right[k] = node(), node()
                goes = binned[rows, f] > b
                below += [(left[k], rows[~goes]), (right[k], rows[goes])]
            level = below
    whole = (np.array(a, np.int32) for a in (feature, left, right, roots))
    feature_, left_, right_, roots_ = whole
    return Trees(feature_, np.array(cut), left_, right_, np.array(value), roots_, depth, base)
