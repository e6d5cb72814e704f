"""Small gradient-boosted trees on numpy: logistic loss, depth-limited trees, Platt scaling.

Models are plain dictionaries, so they are stored as JSON and read without any library.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _best_split(x, grad, hess, rows, min_leaf: int, l2: float):
    best = (0.0, -1, 0.0)
    g, h = grad[rows].sum(), hess[rows].sum()
    base = g * g / (h + l2)
    for f in range(x.shape[1]):
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        s = v[order]
        gl, hl = np.cumsum(grad[rows][order])[:-1], np.cumsum(hess[rows][order])[:-1]
        n = np.arange(1, len(s))
        ok = (s[1:] > s[:-1]) & (n >= min_leaf) & (len(s) - n >= min_leaf)
        if not ok.any():
            continue
        gain = np.where(ok, gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - base, -1.0)
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), f, float((s[i] + s[i + 1]) / 2))
    return best


def _grow(x, grad, hess, depth: int, min_leaf: int, l2: float):
    """A tree as flat arrays; children of node i are left[i] and left[i] + 1."""
    feature, cut, left, value = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        i, rows, d = todo.pop()
        gain, f, c = _best_split(x, grad, hess, rows, min_leaf, l2) if d < depth else (0.0, -1, 0.0)
        if f < 0:
            value[i] = float(-grad[rows].sum() / (hess[rows].sum() + l2))
            continue
        feature[i], cut[i], left[i] = f, c, len(feature)
        for go in (x[rows, f] <= c, x[rows, f] > c):
            feature.append(-1)
            cut.append(0.0)
            left.append(0)
            value.append(0.0)
            todo.append((len(feature) - 1, rows[go], d + 1))
    return {"feature": feature, "cut": cut, "left": left, "value": value}


def _leaf_values(tree: dict, x):
    f, c, left, v = (np.asarray(tree[k]) for k in ("feature", "cut", "left", "value"))
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(f[at] >= 0)
        if not len(inner):
            return v[at]
        n = at[inner]
        at[inner] = left[n] + (x[inner, f[n]] > c[n])


def raw_score(model: dict, x):
    out = np.full(len(x), model["base"])
    for t in model["trees"]:
        out += model["rate"] * _leaf_values(t, x)
    return out


def probability(model: dict, x):
    """Calibrated probability of the positive class."""
    a, b = model["platt"]
    return _sigmoid(a * raw_score(model, x) + b)


def fit(x, y, trees: int = 60, depth: int = 4, rate: float = 0.2, min_leaf: int = 4, l2: float = 1.0, held_out: float = 0.25, seed: int = 7) -> dict:
    """Boosted trees on one part of the rows; scale and threshold on the other."""
    rng = np.random.default_rng(seed)
    test = rng.random(len(y)) < held_out
    xt, yt = x[~test], y[~test]
    base = float(np.log((yt.mean() + 1e-3) / (1 - yt.mean() + 1e-3)))
    model = {"base": base, "rate": rate, "trees": [], "platt": [1.0, 0.0], "threshold": 0.5}
    score = np.full(len(yt), base)
    for _ in range(trees):
        p = _sigmoid(score)
        t = _grow(xt, p - yt, np.maximum(p * (1 - p), 1e-6), depth, min_leaf, l2)
        model["trees"].append(t)
        score += rate * _leaf_values(t, xt)
    s, yh = raw_score(model, x[test]), y[test]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient descent, lightly held to the identity
        p = _sigmoid(a * s + b)
        a -= 0.05 * (float(((p - yh) * s).mean()) + 0.01 * (a - 1))
        b -= 0.05 * (float((p - yh).mean()) + 0.01 * b)
    model["platt"] = [round(a, 4), round(b, 4)]
    p = _sigmoid(a * s + b)
    f1 = {}
    for t in np.arange(0.1, 0.95, 0.05):
        hit = ((p >= t) & (yh > 0)).sum()
        f1[round(float(t), 2)] = float(2 * hit / max(1, (p >= t).sum() + (yh > 0).sum()))
    best = max(f1.values())
    # of the thresholds that do about as well as the best, the most even-handed
    model["threshold"] = min((t for t, v in f1.items() if v >= best - 0.005), key=lambda t: abs(t - 0.5))
    model["held_out_f1"] = round(f1[model["threshold"]], 4)
    return model
