"""Non-linear reconstruction scorer: a small autoencoder trained by distributed gradient sums.

Every evaluation is one Spark job: each task runs its rows through the network and adds up loss and
gradient, Spark sums these, and the driver, which holds nothing but the parameters (a few times features
x width), takes the next quasi-Newton step. The same job measures the loss on the rows set aside, which
stops the training.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_BATCH = 1 << 14


@dataclass(frozen=True)
class Network:
    """Dense layers of the given sizes, rectified but for the last; parameters in one vector."""

    features: tuple[str, ...]
    sizes: tuple[int, ...]
    parameters: np.ndarray

    def layers(self, parameters: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, bias) of each layer, as views of the vector."""
        theta, at, out = self.parameters if parameters is None else parameters, 0, []
        for n, m in zip(self.sizes, self.sizes[1:]):
            out.append((theta[at : at + n * m].reshape(n, m), theta[at + n * m : at + (n + 1) * m]))
            at += (n + 1) * m
        return out

    def errors(self, rows: np.ndarray) -> np.ndarray:
        """Mean squared reconstruction error of each row."""
        value = rows
        layers = self.layers()
        for i, (w, b) in enumerate(layers):
            value = value @ w + b
            if i < len(layers) - 1:
                value = np.maximum(value, 0.0)
        return np.square(value - rows).mean(axis=1)

    def gradient(self, rows: np.ndarray) -> tuple[float, np.ndarray]:
        """The rows' summed error and its gradient by the parameters."""
        layers, inputs, value = self.layers(), [], rows
        for i, (w, b) in enumerate(layers):
            inputs.append(value)
            value = value @ w + b
            if i < len(layers) - 1:
                value = np.maximum(value, 0.0)
        away = value - rows
        back, parts = 2.0 * away / rows.shape[1], []
        for i in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate([(inputs[i].T @ back).ravel(), back.sum(axis=0)]))
            if i:
                back = (back @ layers[i][0].T) * (inputs[i] > 0)
        return float(np.square(away).mean(axis=1).sum()), np.concatenate(parts[::-1])


def initial(features: Sequence[str], widths: Sequence[int], seed: int) -> Network:
    """Weights drawn evenly between bounds that keep a layer's spread (Glorot and Bengio), no bias."""
    sizes = (len(features), *widths, len(features))
    rng, parts = np.random.default_rng(seed), []
    for n, m in zip(sizes, sizes[1:]):
        reach = np.sqrt(6.0 / (n + m))
        parts += [rng.uniform(-reach, reach, n * m), np.zeros(m)]
    return Network(tuple(features), sizes, np.concatenate(parts))


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features])


def evaluate(rows: DataFrame, network: Network) -> tuple[float, float, np.ndarray]:
    """Mean loss of the rows that train, of those set aside (``held``), and the first one's gradient."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(4 + len(network.parameters))  # rows and loss of both kinds, gradient
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                x, held = _matrix(part, network.features), part.column("held").to_numpy(zero_copy_only=False)
                loss, gradient = network.gradient(x[~held])
                totals[:4] += len(x) - held.sum(), loss, held.sum(), network.errors(x[held]).sum()
                totals[4:] += gradient
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals), dtype=np.int32)), pa.array(totals)], names=["i", "v"])

    # As many rows as parameters.
    found = rows.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    totals = np.zeros(4 + len(network.parameters))
    for r in found:
        totals[r["i"]] = r["v"]
    n, held = max(totals[0], 1.0), totals[2]
    return totals[1] / n, totals[3] / held if held else totals[1] / n, totals[4:] / n


def fit_network(
    legit: DataFrame,
    features: Sequence[str],
    key: str,
    widths: Sequence[int] = (16, 8, 16),
    held_share: float = 0.1,
    epochs: int = 60,
    patience: int = 10,
    memory: int = 10,
    seed: int = 42,
) -> Network:
    """The network with the least loss on the rows set aside, among those of all ``epochs``.

    ``legit`` holds the rows taken as normal. A hash of ``key`` sets ``held_share`` of them aside; training
    stops when their loss has not fallen for ``patience`` steps. Rows with a null feature are left out.
    Without rows the first, random network comes back.
    """
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1000)) < int(1000 * held_share)
    rows = legit.dropna(subset=list(features)).select(*features, F.coalesce(share, F.lit(False)).alias("held")).persist()
    try:
        return _descend(rows, initial(features, widths, seed), epochs, patience, memory)
    finally:
        rows.unpersist()


def _descend(rows: DataFrame, network: Network, epochs: int, patience: int, memory: int) -> Network:
    """Limited-memory quasi-Newton steps with halved step lengths where a step does not help enough."""
    theta = network.parameters
    at = lambda point: Network(network.features, network.sizes, point)
    loss, held, slope = evaluate(rows, network)
    best, best_held, since = theta, held, 0
    steps: deque = deque(maxlen=memory)
    for _ in range(epochs):
        down, kept = slope.copy(), []
        for s, y, r in reversed(steps):
            kept.append(r * s.dot(down))
            down -= kept[-1] * y
        if steps:
            s, y, r = steps[-1]
            down *= 1.0 / (r * y.dot(y))
        else:
            down *= 1.0 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y, r), a in zip(steps, reversed(kept)):
            down += (a - r * y.dot(down)) * s
        gain, length = slope.dot(down), 1.0
        if gain <= 0:
            steps.clear()
            down, gain = slope, slope.dot(slope)
        for _ in range(12):
            point = theta - length * down
            new_loss, new_held, new_slope = evaluate(rows, at(point))
            if new_loss <= loss - 1e-4 * length * gain:
                break
            length /= 2
        else:
            break
        s, y = point - theta, new_slope - slope
        if s.dot(y) > 1e-12:
            steps.append((s, y, 1.0 / s.dot(y)))
        theta, loss, slope = point, new_loss, new_slope
        if new_held < best_held:
            best, best_held, since = theta, new_held, 0
        else:
            since += 1
        if since >= patience or np.linalg.norm(slope) < 1e-9:
            break
    return at(best)


def score_network(df: DataFrame, network: Network, out: str = "score") -> DataFrame:
    """``df`` with the mean squared reconstruction error; null where a feature is null.

    A column named ``out`` is replaced, all others stay.
    """
    features = network.features

    @F.arrow_udf("double")
    def error(rows: pa.Array) -> pa.Array:
        x = np.column_stack([rows.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))])
        e = network.errors(x) if len(x) else np.zeros(0)
        return pa.array(e, pa.float64(), mask=~np.isfinite(e))

    return df.withColumn(out, error(F.struct(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)))))
