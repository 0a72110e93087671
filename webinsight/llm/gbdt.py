"""Histogram gradient-boosted trees (binary logistic loss), flattened into arrays for numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees in one array each; a leaf points to itself. Missing values (NaN) go right."""

    feature: np.ndarray
    line: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                go = part[rows, self.feature[node]] <= self.line[node]
                node = np.where(go, self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, min_hess: float = 1.0) -> Forest:
    """Without rows, or with one label only, the forest is empty and predicts the smoothed share of label 1."""
    n, width = x.shape if x.ndim == 2 else (len(y), 0)
    share = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, line, left, right, value
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)] if n else []
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if edges else None
    score = np.full(n, base)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        open_nodes, where = [roots[-1]], np.zeros(n, np.int64)  # where: place in open_nodes, -1 in a finished leaf
        done = np.zeros(n)
        for level in range(depth + 1):
            inside = where >= 0
            k = len(open_nodes)
            gs, hs = (np.bincount(where[inside], v[inside], k) for v in (g, h))
            best = [(1e-6, -1, 0)] * k
            if level < depth:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = len(e) + 1
                    key = where[inside] * b + code[inside, f]
                    gl, hl = (np.bincount(key, v[inside], k * b).reshape(k, b).cumsum(axis=1)[:, :-1] for v in (g, h))
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                    gain[(hl < min_hess) | (hr < min_hess)] = 0
                    top = gain.argmax(axis=1)
                    for i in range(k):
                        if gain[i, top[i]] > best[i][0]:
                            best[i] = (float(gain[i, top[i]]), f, int(top[i]))
            next_open, new = [], np.full(n, -1)
            for i, node in enumerate(open_nodes):
                mine = where == i
                _, f, at = best[i]
                if f < 0:
                    nodes[node][4] = rate * gs[i] / (hs[i] + ridge)
                    done[mine] = nodes[node][4]
                    continue
                left, right = len(nodes), len(nodes) + 1
                nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                nodes[node][:4] = [f, edges[f][at], left, right]
                go = mine & (code[:, f] <= at)
                new[go], new[mine & ~go] = len(next_open), len(next_open) + 1
                next_open += [left, right]
            open_nodes, where = next_open, new
            if not open_nodes:
                break
        score = score + done
    flat = np.array(nodes, float).reshape(-1, 5)
    return Forest(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots, np.int64), base, depth)
