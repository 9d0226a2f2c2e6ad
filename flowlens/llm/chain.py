"""Linear-chain conditional random field with two labels and binary features.

Training takes chains of feature rows with a label per item and maximises the likelihood
with Adam in a fixed number of steps; numpy works on all chains of a step at once, so the
number of chains is what must be bounded. Marginals and the best labelling work item by
item in constant memory per item, for chains of any length.
"""

from __future__ import annotations

from math import exp

import numpy as np


def train(
    chains: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray | None = None, turns: int = 120, rate: float = 0.08, ridge: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Score of label 1 minus label 0 by feature, and 2 x 2 scores of neighbouring labels.

    ``chains``: items x features, no chain empty; ``weights``: of each chain's mean item.
    """
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    size = np.array([len(chains[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    x = np.concatenate([chains[i] for i in order]).astype(np.float32)
    y = np.concatenate([labels[i] for i in order]).astype(int)
    alive = [int((size > t).sum()) for t in range(size[0])]  # sorted by length: the first chains live on
    weight = (np.ones(len(order)) if weights is None else np.asarray(weights, float)[order]) / size
    items = np.repeat(weight, size)
    follows = np.ones(len(y), bool)
    follows[starts] = False
    at = np.flatnonzero(follows)
    target = np.zeros((2, 2))
    np.add.at(target, (y[at - 1], y[at]), items[at])
    w, s = np.zeros(x.shape[1]), np.zeros((2, 2))
    first, second = [np.zeros_like(w), np.zeros_like(s)], [np.zeros_like(w), np.zeros_like(s)]
    total = items.sum()
    for turn in range(1, turns + 1):
        e = np.exp(np.clip(x @ w.astype(np.float32), -20, 20)).astype(float)
        own = np.column_stack([np.ones(len(e)), e])
        t = np.exp(s)
        ahead, back, model = np.empty((len(e), 2)), np.ones((len(e), 2)), np.zeros((2, 2))
        for k, n in enumerate(alive):
            now = starts[:n] + k
            a = own[now] if k == 0 else (ahead[now - 1] @ t) * own[now]
            ahead[now] = a / a.sum(1, keepdims=True)
        for k in range(size[0] - 1, 0, -1):
            n = alive[k]
            now = starts[:n] + k
            after = back[now] * own[now]
            pair = ahead[now - 1][:, :, None] * t[None] * after[:, None, :]
            model += (pair * (weight[:n] / pair.sum((1, 2)))[:, None, None]).sum(0)
            b = after @ t.T
            back[now - 1] = b / b.sum(1, keepdims=True)
        both = ahead * back
        gap = items * (y - both[:, 1] / both.sum(1))
        grads = [x.T @ gap.astype(np.float32) / total - ridge * w, (target - model) / total - ridge * s]
        for p, g, m, v in zip((w, s), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return w, s


def marginals(scores: list[float], steps: list[list[float]]) -> list[float]:
    """Probability of label 1 for each item, by forward-backward."""
    e = [exp(max(-20.0, min(20.0, x))) for x in scores]
    (t00, t01), (t10, t11) = [[exp(x) for x in row] for row in steps]
    p, ahead = 0.0, []
    for i, x in enumerate(e):
        bad, good = (1.0, x) if i == 0 else ((1 - p) * t00 + p * t10, ((1 - p) * t01 + p * t11) * x)
        p = good / (bad + good)
        ahead.append(p)
    b0 = b1 = 0.5
    out = [0.0] * len(e)
    for i in range(len(e) - 1, -1, -1):
        good, bad = ahead[i] * b1, (1 - ahead[i]) * b0
        out[i] = good / (good + bad)
        u0, u1 = b0, b1 * e[i]
        b0, b1 = t00 * u0 + t01 * u1, t10 * u0 + t11 * u1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    return out


def viterbi(scores: list[float], steps: list[list[float]]) -> list[int]:
    """The best labelling; of equal ones the one with more labels 1 at the end."""
    (s00, s01), (s10, s11) = steps
    v0 = v1 = 0.0
    came: list[tuple[int, int]] = []
    for i, x in enumerate(scores):
        if i == 0:
            v0, v1 = 0.0, x
            continue
        from0, from1 = int(v1 + s10 >= v0 + s00), int(v1 + s11 >= v0 + s01)
        v0, v1 = (v1 + s10 if from0 else v0 + s00), (v1 + s11 if from1 else v0 + s01) + x
        came.append((from0, from1))
    label = int(v1 >= v0)
    out = [label] if scores else []
    for pair in reversed(came):
        label = pair[label]
        out.append(label)
    return out[::-1]
