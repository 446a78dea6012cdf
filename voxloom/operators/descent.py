"""Gradient descent with momentum: shared weights by one aggregation a step, codes of samples side by side.

Both fit occupancy: a code z of a sample gives the chances sigmoid(W z + b) of its voxels, and the
loss is the cross-entropy with what was observed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """Rate and momentum of each step: after every `every` steps the rate is multiplied by `decay` down to
    `least_rate` and the momentum divided by it up to `most_momentum`."""

    rate: float = 0.1
    momentum: float = 0.5
    decay: float = 0.9
    every: int = 10
    least_rate: float = 1e-4
    most_momentum: float = 0.9

    def at(self, step: int) -> tuple[float, float]:
        times = step // self.every
        return max(self.least_rate, self.rate * self.decay**times), min(self.most_momentum, self.momentum / self.decay**times)


def chances(z: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z @ weights.T + bias, -40, 40)))


def cross_entropy(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of each row; absent observations (NaN) count for nothing."""
    return np.nansum(-(t * np.log(p + 1e-12) + (1 - t) * np.log(1 - p + 1e-12)), axis=1)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column]).reshape(-1, width)


def fit_weights(samples: DataFrame, voxels: int, dims: int, steps: int, schedule: Schedule, weight_decay: float = 0.0, batches: int = 1) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights, bias, losses) fitted to samples (sample_id, z, target), two arrays of fixed lengths.

    Step k takes the samples whose id's hash is k modulo `batches`. Each task sums its rows' gradients to
    one vector of fixed size, these are summed by position, and the driver takes the step: it holds the
    weights and nothing that grows with the samples. Without samples the weights stay. Samples with a
    null array are left out. losses: the mean loss before each step; an empty batch takes none.
    """
    width = voxels * (dims + 1)
    state, velocity, losses = np.zeros((voxels, dims + 1)), np.zeros((voxels, dims + 1)), []
    whole = samples.where("z IS NOT NULL AND target IS NOT NULL").select("sample_id", "z", "target")
    for step in range(steps):
        w = state.copy()

        def gradients(parts: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            total, loss, n = np.zeros((voxels, dims + 1)), 0.0, 0
            for part in parts:
                z, t = matrix(part["z"], dims), matrix(part["target"], voxels)
                p = chances(z, w[:, :dims], w[:, dims])
                error = np.nan_to_num(p - t)
                total += error.T @ np.hstack([z, np.ones((len(z), 1))])
                loss, n = loss + cross_entropy(p, t).sum(), n + len(z)
            if n:
                yield pd.DataFrame({"at": range(width + 2), "value": np.concatenate([total.ravel(), [loss, n]])})

        batch = whole if batches == 1 else whole.where(F.pmod(F.xxhash64("sample_id"), F.lit(batches)) == step % batches)
        sums = np.zeros(width + 2)
        for r in batch.mapInPandas(gradients, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            sums[r["at"]] = r["value"]
        if not sums[-1]:
            continue
        losses.append(float(sums[-2] / sums[-1]))
        gradient = sums[:width].reshape(voxels, dims + 1) / sums[-1]
        gradient[:, :dims] += weight_decay * state[:, :dims]
        rate, momentum = schedule.at(step)
        velocity = momentum * velocity - rate * gradient
        state = state + velocity
    return state[:, :dims], state[:, dims], losses


def fit_codes(samples: DataFrame, weights: np.ndarray, bias: np.ndarray, steps: int, schedule: Schedule, block: int = 10, least_change: float = 1e-3) -> DataFrame:
    """(sample_id, z, first_loss, loss, steps): each sample's most likely code, from zeros.

    The loss is the cross-entropy with the sample's `target` (null or NaN: not observed) and half the
    squared length of the code. A sample stops when the mean loss of a block of steps differs from that
    of the block before by less than `least_change`. Samples don't depend on each other; those of an
    Arrow batch take their steps together, and those that stopped leave the batch. A null target has the
    code of zeros.
    """
    voxels, dims = weights.shape

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            t = np.array([np.full(voxels, np.nan) if v is None else np.asarray(v, float) for v in part["target"]]).reshape(-1, voxels)
            n = len(t)
            z, v = np.zeros((n, dims)), np.zeros((n, dims))
            first, taken = np.zeros(n), np.zeros(n, np.int32)
            mean, before = np.zeros(n), np.full(n, np.inf)
            on = np.arange(n)

            def loss_of(some: np.ndarray, p: np.ndarray) -> np.ndarray:
                return cross_entropy(p, t[some]) + (z[some] ** 2).sum(1) / 2  # noqa: B023

            for step in range(steps):
                p = chances(z[on], weights, bias)
                loss = loss_of(on, p)
                if step == 0:
                    first[on] = loss
                mean[on] += loss / block
                rate, momentum = schedule.at(step)
                v[on] = momentum * v[on] - rate * (np.nan_to_num(p - t[on]) @ weights + z[on])
                z[on] += v[on]
                taken[on] += 1
                if (step + 1) % block == 0:
                    stop = np.abs(mean[on] - before[on]) < least_change
                    before[on], mean[on] = mean[on], 0.0
                    on = on[~stop]
                    if not len(on):
                        break
            every = np.arange(n)
            last = loss_of(every, chances(z, weights, bias))
            yield pd.DataFrame({"sample_id": part["sample_id"], "z": list(z), "first_loss": first, "loss": last, "steps": taken})

    return samples.select("sample_id", "target").mapInPandas(of, "sample_id long, z array<double>, first_loss double, loss double, steps int")
