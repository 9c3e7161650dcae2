"""Multinomial logistic regression with an L2 penalty, over sparse rows in blocks.

The loss is mean(weight x log-loss) + penalty / 2 x (sum of squared weights); intercepts are not
penalised. Its one minimum is sought by L-BFGS on the driver, over features x labels numbers;
every pass over the rows runs on the executors. Features are not divided by their deviations:
that is how Spark's own estimator takes its steps, whatever it is told of standardisation, and
rare terms, whose deviations are tiny, then cost it a thousand steps and more.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterable

import numpy as np
from pyspark import RDD, StorageLevel

#: Pairs of steps and gradients that L-BFGS keeps; values of the loss that convergence looks back on; most tasks whose sums the driver adds up itself.
MEMORY, LOOK_BACK, DIRECT = 20, 10, 64


def packed(y: np.ndarray, weight: np.ndarray, lengths: np.ndarray, index: np.ndarray, value: np.ndarray) -> bytes:
    """A block of rows: label and weight of each, how many features it has, and all their numbers and values; no row is empty."""
    return pickle.dumps((y.astype(np.uint16), weight, lengths.astype(np.int32), index.astype(np.int32), value), protocol=5)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths[:-1], dtype=np.int64)))


def _chances(w: np.ndarray, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifted scores of the labels of each row, and their probabilities."""
    z = np.stack([np.add.reduceat(x.take(index) * value, starts) for x in w])
    z -= z.max(axis=0)
    p = np.exp(z)
    return z, p / p.sum(axis=0)


def _back(z: np.ndarray, lengths: np.ndarray, index: np.ndarray, value: np.ndarray, features: int) -> np.ndarray:
    """What numbers of labels x rows give to labels x features."""
    return np.stack([np.bincount(index, np.repeat(x, lengths) * value, features) for x in z])


def _sums(blocks: Iterable[bytes], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted loss and its gradient over the blocks of one task; ``w`` has a row for each label."""
    loss, gradient = 0.0, np.zeros(w.shape)
    for block in blocks:
        y, weight, lengths, index, value = pickle.loads(block)
        rows = np.arange(len(y))
        z, p = _chances(w, index, value, _starts(lengths))
        loss += float(weight @ (np.log(np.exp(z).sum(axis=0)) - z[y, rows]))
        p[y, rows] -= 1.0
        gradient += _back(p * weight, lengths, index, value, w.shape[1])
    return loss, gradient


def _squares(blocks: Iterable[bytes], features: int) -> np.ndarray:
    """Weighted squares of each feature's values over the blocks of one task."""
    found = np.zeros(features)
    for block in blocks:
        _, weight, lengths, index, value = pickle.loads(block)
        found += np.bincount(index, np.repeat(weight, lengths) * value * value, features)
    return found


def _added(parts: RDD, plus: Callable):
    """The sum over the tasks of an RDD that has one element for each."""
    if parts.getNumPartitions() > DIRECT:
        return parts.treeReduce(plus)
    found = parts.collect()  # at most DIRECT
    total = found[0]
    for x in found[1:]:
        total = plus(total, x)
    return total


def _plus(a, b):
    return (a[0] + b[0], a[1] + b[1])


def minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, curvature: np.ndarray, iterations: int, tol: float) -> np.ndarray:
    """Where ``loss`` (value and gradient, convex) is least, by L-BFGS from ``w``; ``curvature`` estimates the second derivatives.

    It ends when the last LOOK_BACK steps together improved the loss by at most ``tol`` of it, or
    the gradient's length is at most ``tol`` of it, or after ``iterations`` steps.
    """
    value, gradient = loss(w)
    steps, last = deque(maxlen=MEMORY), deque([value], maxlen=LOOK_BACK + 1)
    for _ in range(iterations):
        if np.linalg.norm(gradient) <= tol * abs(value) or len(last) > LOOK_BACK and max(last) - value <= tol * abs(value):
            break
        d, kept = -gradient, []
        for s, g, sg in reversed(steps):
            kept.append((s @ d) / sg)
            d = d - kept[-1] * g
        scale = 1.0
        if steps:
            s, g, sg = steps[-1]
            scale = sg / (g @ (g / curvature))
        d = scale * d / curvature
        for (s, g, sg), a in zip(steps, reversed(kept), strict=True):
            d = d + s * (a - (g @ d) / sg)
        slope, size = gradient @ d, 1.0 if steps else min(1.0, 1.0 / max(np.abs(d).max(), 1e-300))
        while True:
            new_value, new_gradient = loss(w + size * d)
            if new_value <= value + 1e-4 * size * slope:
                break
            size *= min(0.5, max(0.1, -slope * size / (2 * (new_value - value - slope * size))))  # the least value of the parabola
            if size < 1e-10:
                return w  # no lower value can be told from this one
        s, g = size * d, new_gradient - gradient
        if s @ g > 1e-16 * (g @ g):
            steps.append((s, g, s @ g))
        w, value, gradient = w + s, new_value, new_gradient
        last.append(value)
    return w


def fit(blocks: RDD, start: np.ndarray, rows: int, penalty: float, iterations: int, tol: float) -> np.ndarray:
    """Weights of the least loss over ``blocks`` (of :func:`packed`), as labels x features; the last feature is the intercept, in every row with value 1."""
    context, shape = blocks.context, start.shape
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        squares = _added(blocks.mapPartitions(lambda it: [_squares(it, shape[1])]), np.add) / rows
        penalties = np.full(shape, penalty)
        penalties[:, -1] = 0.0

        def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
            w = flat.reshape(shape)
            sent = context.broadcast(w)  # labels x features
            total, gradient = _added(blocks.mapPartitions(lambda it: [_sums(it, sent.value)]), _plus)
            sent.destroy()
            return total / rows + 0.5 * float((penalties * w * w).sum()), (gradient / rows + penalties * w).ravel()

        share = 1.0 / shape[0]
        curvature = np.maximum(penalties + 0.5 * share * (1.0 - share) * squares, 1e-12).ravel()
        return minimum(loss, start.ravel(), curvature, iterations, tol).reshape(shape)
    finally:
        blocks.unpersist()
