"""Perceptron training (M6) over cells.

Rows with equal features are one cell with its rows of both classes, so a pass
costs as much as there are distinct vectors, not rows.  The loss (mean cross
entropy over all rows), the sigmoid layers with softmax on top, the starting
weights and the order of the weights are those of Spark's
``MultilayerPerceptronClassifier``.  Each value and gradient is one pass over
cached numpy blocks; the driver keeps the weights and the last ``MEMORY`` steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from vigil.operators.forest import exact_cells
from vigil.schema import FEATURES
from vigil.session import write_once

MEMORY = 10            # steps that L-BFGS remembers
BLOCK_CELLS = 1 << 20  # cells of a task at most
TASK_CELLS = 1 << 12   # and at least, where there are more cores
ROWS = 1 << 13         # cells that go through the layers at a time

Block = tuple[np.ndarray, np.ndarray]  # standardised features, rows of both classes


def unpacked(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(in x out matrix, bias) of every layer, as views."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def loss_and_gradient(block: Block, weights: np.ndarray, layers: list[int]) -> np.ndarray:
    """The summed cross entropy of a block's rows, followed by its gradient."""
    x, counts = block
    out = np.zeros(len(weights) + 1)
    net, grad = unpacked(weights, layers), unpacked(out[1:], layers)
    for lo in range(0, len(x), ROWS):
        held, n = [x[lo:lo + ROWS]], counts[lo:lo + ROWS]
        for w, b in net[:-1]:
            held.append(1 / (1 + np.exp(-np.clip(held[-1] @ w + b, -700, 700))))
        z = held[-1] @ net[-1][0] + net[-1][1]
        z -= z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        out[0] -= (n * logp).sum()
        delta = np.exp(logp) * n.sum(axis=1, keepdims=True) - n
        for i in reversed(range(len(net))):
            grad[i][0][:] += held[i].T @ delta
            grad[i][1][:] += delta.sum(axis=0)
            if i:
                delta = (delta @ net[i][0].T) * held[i] * (1 - held[i])
    return out


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS with a Wolfe line search; ends when ten steps gain less than
    ``tol`` of the first value."""
    f, g = value(x)
    values, steps = [f], []
    for i in range(max_iter):
        d, back = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (y @ s)
            d = d - a * y
            back.append(a)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(back)):
            d = d + (a - (y @ d) / (y @ s)) * s
        slope = g @ d
        if not slope < 0:
            break
        low, high, t = 0.0, np.inf, 1.0 if steps else 1 / np.linalg.norm(d)
        for _ in range(30):
            f1, g1 = value(x + t * d)
            if f1 > f + 1e-4 * t * slope:
                high = t
            elif g1 @ d < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * low
        if not f1 < f:
            break
        if (g1 - g) @ d > 0:
            steps = [*steps, (t * d, g1 - g)][-MEMORY:]
        x, f, g = x + t * d, f1, g1
        values = [*values, f]
        if max(values[-10:-1]) - f <= tol * abs(values[0]):
            break
    return x


def _blocks(table: DataFrame, mean: np.ndarray, factor: np.ndarray, features: list[str]):
    cores = table.sparkSession.sparkContext.defaultParallelism
    cells = table.count()
    parts = max(1, min(2 * cores, cells // TASK_CELLS), -(-cells // BLOCK_CELLS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [rb for rb in batches if rb.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            x = np.stack([t.column(c).to_numpy() for c in features], axis=1)
            n = np.stack([t.column(c).to_numpy() for c in ("n0", "n1")], axis=1).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in ((x - mean) * factor, n)], ["x", "n"])

    def unpack(r) -> Block:
        return np.frombuffer(r.x).reshape(-1, len(features)), np.frombuffer(r.n).reshape(-1, 2)

    return table.repartition(parts, "key").sortWithinPartitions("key", *features) \
        .mapInArrow(pack, "x binary, n binary").rdd.map(unpack)


def fit(train: DataFrame, label: str, layers: list[int], start: np.ndarray, mean: np.ndarray, factor: np.ndarray,
        max_iter: int = 100, tol: float = 1e-6, features: list[str] = FEATURES) -> np.ndarray:
    """Weights after at most ``max_iter`` steps from ``start``; inputs are
    ``(feature - mean) * factor``."""
    table = write_once(exact_cells(train, label, features), "network-cells")
    blocks = _blocks(table, mean, factor, features).persist(StorageLevel.MEMORY_AND_DISK)
    rows = blocks.map(lambda b: float(b[1].sum())).sum()

    def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
        # one vector of the weights' size a task, added in the tasks' order
        sums = sum(blocks.map(lambda b: loss_and_gradient(b, weights, layers)).collect(), np.zeros(len(weights) + 1))
        return sums[0] / rows, sums[1:] / rows

    try:
        return minimise(value, start, max_iter, tol) if rows else start
    finally:
        blocks.unpersist()
