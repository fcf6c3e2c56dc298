"""Gradient-boosted trees in numpy: histograms of binned features, logistic loss, complete trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH, TREES, RATE, BINS, L2, LEAST = 5, 45, 0.3, 32, 2.0, 8


@dataclass
class Forest:
    bias: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right above it
    leaf: np.ndarray  # trees x leaves

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (len(f))]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    mean = (y * weight).sum() / weight.sum()
    bias = float(np.log(mean / (1 - mean)))
    score, inner = np.full(len(y), bias), 2**DEPTH - 1
    features, cuts, leaves = [], [], []
    # Features of two values need no histogram: sums over the rows of a node do.
    two = np.array([len(e) == 1 and set(np.unique(c)) <= {0.0, 1.0} for e, c in zip(edges, x.T, strict=True)])
    many, flags = [k for k in range(x.shape[1]) if not two[k] and len(edges[k])], np.flatnonzero(two)
    yes = np.ascontiguousarray(binned[:, flags].astype(np.float32))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, p * (1 - p) * weight
        f, c, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            low, n = 2**level - 1, 2**level
            local = at - low
            best = np.full(n, 1e-6)
            tg, th, tc = np.bincount(local, g, n), np.bincount(local, h, n), np.bincount(local, minlength=n)

            def gains(gl, hl, cl):
                gt, ht, ct = tg[:, None], th[:, None], tc[:, None]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
                return gain

            for k in many:
                key = local * BINS + binned[:, k]
                left = (np.bincount(key, w, n * BINS).reshape(n, BINS).cumsum(1)[:, :-1] for w in (g, h, None))
                gain = gains(*left)
                gain[:, len(edges[k]) :] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(n), top] > best):
                    best[i], f[low + i], c[low + i] = gain[i, top[i]], k, edges[k][top[i]]
            if len(flags):
                by = np.argsort(local, kind="stable")
                there = np.flatnonzero(tc)
                start = np.searchsorted(local[by], there)
                sums = [np.zeros((n, len(flags))) for _ in range(3)]
                for out, w in zip(sums, (g, h, np.ones(len(y))), strict=True):
                    out[there] = np.add.reduceat(yes[by] * w[by, None].astype(np.float32), start, axis=0)
                gain = gains(tg[:, None] - sums[0], th[:, None] - sums[1], tc[:, None] - sums[2])
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(n), top] > best):
                    best[i], f[low + i], c[low + i] = gain[i, top[i]], flags[top[i]], edges[flags[top[i]]][0]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        at -= inner
        leaf = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        score += leaf[at]
        features.append(f)
        cuts.append(c)
        leaves.append(leaf)
    return Forest(bias, np.array(features), np.array(cuts), np.array(leaves))
