"""Layers and descents against plain numpy."""

import numpy as np
import pytest

from voxloom.operators import descent, layers

SCHEMA = "sample_id long, channel int, h int, w int, d int, value double"


def rows_of(volumes: np.ndarray) -> list[tuple]:
    return [(*map(int, at), float(v)) for at, v in np.ndenumerate(volumes)]


def dense(df, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.sample_id, r.channel, r.h, r.w, r.d] = r.value
    return out


def test_convolution_of_uneven_volumes(spark):
    r = np.random.default_rng(1)
    volumes, kernel, bias = r.normal(size=(3, 2, 5, 3, 4)), r.normal(size=(4, 2, 3, 3, 3)), [0.5, -1.0, 0.0, 2.0]
    padded = np.pad(volumes, ((0, 0), (0, 0), (1, 1), (1, 1), (1, 1)))
    want = np.zeros((3, 4, 5, 3, 4))
    for o in range(4):
        want[:, o] = bias[o] + sum(kernel[o, i, a, b, c] * padded[:, i, a : a + 5, b : b + 3, c : c + 4] for i in range(2) for a in range(3) for b in range(3) for c in range(3))
    got = layers.convolved(spark.createDataFrame(rows_of(volumes), SCHEMA), kernel, bias, (5, 3, 4))
    assert np.allclose(dense(got, want.shape), want)


def test_convolution_of_sparse_and_empty_volumes(spark):
    kernel = np.arange(27.0).reshape(1, 1, 3, 3, 3)
    one = layers.convolved(spark.createDataFrame([(0, 0, 1, 1, 1, 2.0)], SCHEMA), kernel, [0.0], (3, 3, 3))
    assert np.allclose(dense(one, (1, 1, 3, 3, 3))[0, 0], 2 * kernel[0, 0, ::-1, ::-1, ::-1])  # a neighbour sees it at the opposite offset
    assert layers.convolved(spark.createDataFrame([], SCHEMA), kernel, [1.0], (3, 3, 3)).count() == 0
    null = layers.convolved(spark.createDataFrame([(0, 0, 0, 0, 0, None)], SCHEMA), kernel, [1.0], (1, 1, 1))
    assert [r.value for r in null.collect()] == [1.0]


def test_normalisation_and_running_moments(spark):
    r = np.random.default_rng(2)
    volumes = r.normal(3, 2, size=(4, 2, 2, 3, 2))
    df = spark.createDataFrame(rows_of(volumes), SCHEMA)
    mean, var = volumes.mean((0, 2, 3, 4), keepdims=True), volumes.var((0, 2, 3, 4), keepdims=True)
    assert np.allclose(dense(layers.normalised(df, layers.moments(df), 1.5, -1.0), volumes.shape), (volumes - mean) / np.sqrt(var + 1e-5) * 1.5 - 1)
    old = spark.createDataFrame([(0, 1.0, 4.0), (7, 2.0, 3.0)], "channel int, mean double, variance double")
    got = {x.channel: (x.mean, x.variance) for x in layers.running(old, layers.moments(df)).collect()}
    unbiased = volumes.var((0, 2, 3, 4), ddof=1)
    assert got[0] == pytest.approx((0.9 + 0.1 * mean[0, 0, 0, 0, 0], 3.6 + 0.1 * unbiased[0]))
    assert got[1] == pytest.approx((mean[0, 1, 0, 0, 0], unbiased[1])) and got[7] == (2.0, 3.0)


def samples_of(z, t):
    return [(k, [float(v) for v in a], [None if np.isnan(v) else float(v) for v in b]) for k, (a, b) in enumerate(zip(z, t, strict=True))]


CODED = "sample_id long, z array<double>, target array<double>"


def test_weight_descent_equals_a_loop(spark):
    """Losses of 30 steps as in one matrix; they fall."""
    r = np.random.default_rng(3)
    z, true = r.normal(size=(90, 4)), r.normal(size=(6, 4))
    t = (z @ true.T > 0).astype(float)
    schedule = descent.Schedule(rate=0.3, momentum=0.5, decay=0.8, every=7)
    got_w, got_b, got = descent.fit_weights(spark.createDataFrame(samples_of(z, t), CODED).repartition(5), 6, 4, 30, schedule, weight_decay=0.01)
    w, b, vw, vb, want = np.zeros((6, 4)), np.zeros(6), np.zeros((6, 4)), np.zeros(6), []
    for step in range(30):
        p = 1 / (1 + np.exp(-(z @ w.T + b)))
        want.append(-(t * np.log(p + 1e-12) + (1 - t) * np.log(1 - p + 1e-12)).sum() / 90)
        rate, momentum = max(1e-4, 0.3 * 0.8 ** (step // 7)), min(0.9, 0.5 / 0.8 ** (step // 7))
        vw = momentum * vw - rate * ((p - t).T @ z / 90 + 0.01 * w)
        vb = momentum * vb - rate * (p - t).mean(0)
        w, b = w + vw, b + vb
    assert np.allclose(got, want) and np.allclose(got_w, w) and np.allclose(got_b, b)
    assert got[-1] < got[0] / 2


def test_weight_descent_of_nothing(spark):
    w, b, losses = descent.fit_weights(spark.createDataFrame([(1, None, [1.0])], CODED), 1, 2, 3, descent.Schedule())
    assert not w.any() and not b.any() and losses == []


def test_code_descent_equals_a_loop_for_each_sample(spark):
    r = np.random.default_rng(4)
    weights, bias = r.normal(size=(12, 3)), r.normal(size=12)
    t = (r.random((25, 12)) < 0.5).astype(float)
    t[r.random(t.shape) < 0.3] = np.nan
    t[3] = np.nan  # nothing seen
    schedule = descent.Schedule(rate=0.05, every=15)
    rows = [*samples_of(np.zeros((25, 3)), t), (99, None, None)]
    got = {x.sample_id: x for x in descent.fit_codes(spark.createDataFrame(rows, CODED), weights, bias, 100, schedule, 10, 1e-2).collect()}
    for k in range(25):
        seen = ~np.isnan(t[k])
        wk, bk, tk = weights[seen], bias[seen], t[k][seen]
        z, v, losses, taken = np.zeros(3), np.zeros(3), [], 0

        def loss_at(z, wk=wk, bk=bk, tk=tk):
            p = 1 / (1 + np.exp(-(wk @ z + bk)))
            return p, -(tk * np.log(p + 1e-12) + (1 - tk) * np.log(1 - p + 1e-12)).sum() + z @ z / 2

        for step in range(100):
            p, loss = loss_at(z)
            losses.append(loss)
            rate, momentum = schedule.at(step)
            v = momentum * v - rate * (wk.T @ (p - tk) + z)
            z, taken = z + v, taken + 1
            if taken % 10 == 0 and taken >= 20 and abs(np.mean(losses[-10:]) - np.mean(losses[-20:-10])) < 1e-2:
                break
        x = got[k]
        assert np.allclose(x.z, z) and x.steps == taken and x.first_loss == pytest.approx(losses[0]) and x.loss == pytest.approx(loss_at(z)[1])
        assert x.loss <= x.first_loss + 1e-9
    assert list(got[99].z) == [0.0] * 3 and list(got[3].z) == [0.0] * 3
