"""Element-wise formulas on volumes, codes and predictions, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(value: Column, limit: float = 5.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), value))


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def occupied(distance: Column) -> Column:
    """1 at and below distance 0."""
    return F.when(distance <= 0, 1).otherwise(0)


def thresholded(probability: Column) -> Column:
    """0 below a half, 1 above, and a half as it is."""
    return F.when(probability > 0.5, 1.0).when(probability < 0.5, 0.0).otherwise(probability)


def inside_sign(distance: Column) -> Column:
    """1 below 0, 0 above, and 0 as it is."""
    return F.when(distance < 0, 1.0).otherwise(0.0)


def flat_index(h: Column, w: Column, d: Column, width: int, depth: int) -> Column:
    return (h * width + w) * depth + d


def unflatten(index: Column, width: int, depth: int) -> tuple[Column, Column, Column]:
    return F.floor(index / (width * depth)), F.pmod(F.floor(index / depth), F.lit(width)), F.pmod(index, F.lit(depth))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-value))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    # Fixed values of the formula.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = F.lit(1.0) / (1.0 + p * F.abs(x))
    series = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return F.signum(x) * (1.0 - series * F.exp(-x * x))


def gaussian_to_bernoulli(mean: Column, log_variance: float = -2.0, eps: float = 0.5) -> Column:
    """Chance that a normal value with this mean lies below eps."""
    return 0.5 * (1.0 + erf(math.exp(-0.5 * log_variance) * 0.707106781 * (eps - mean)))


def reparameterised(mean: Column, log_variance: Column, noise: Column) -> Column:
    return F.exp(log_variance / 2) * noise + mean


def kl_term(mean: Column, log_variance: Column, second: float = 1.0) -> Column:
    """Of the divergence from the standard normal distribution, for one dimension."""
    return 0.5 * (mean * mean + second * (F.exp(log_variance) - 1 - log_variance))


def kl_gradients(mean: Column, log_variance: Column, weight: float = 1.0, second: float = 1.0) -> tuple[Column, Column]:
    return weight * mean, weight * second * 0.5 * (F.exp(log_variance) - 1)


def nll_term(value: Column, target: Column, log_variance: float) -> Column:
    return 0.5 * math.exp(-log_variance) * (target - value) * (target - value)


def nll_gradient(value: Column, target: Column, log_variance: float) -> Column:
    return -math.exp(-log_variance) * (target - value)


#: Keeps logarithms finite.
TINY = 1e-12


def bce_term(value: Column, target, weight=1.0) -> Column:
    return -weight * (target * F.log(value + TINY) + (1 - target) * F.log(1 - value + TINY))


def bce_gradient(value: Column, target, weight=1.0) -> Column:
    return -weight * (target - value) / ((1 - value + TINY) * (value + TINY))


def step_decay(start: float, factor: float, least: float, iteration: Column, every: int) -> Column:
    """A rate that shrinks by a factor every so many iterations, down to a least one."""
    return F.greatest(F.lit(least), start * F.pow(F.lit(factor), F.floor(iteration / every)))


def step_growth(start: float, factor: float, most: float, iteration: Column, every: int) -> Column:
    return F.least(F.lit(most), start * F.pow(F.lit(factor), F.floor(iteration / every)))


def layer_sizes(size: int, kernels: list[int], pools: list[int], padded: bool = False, strides: list[int] | None = None) -> list[int]:
    """An axis after each layer: kernel borders come off where `padded`, then pooling and strides divide, rounding down."""
    out = []
    for k, (kernel, pool) in enumerate(zip(kernels, pools, strict=True)):
        size = (size - 2 * (kernel // 2) * padded) // pool // (strides[k] if strides and strides[k] > 1 else 1)
        out.append(size)
    return out


def layer_size_columns(size, kernels: list[int], pools: list[int], padded: bool = False) -> list:
    """layer_sizes() of an axis whose size is a column."""
    out = []
    for kernel, pool in zip(kernels, pools, strict=True):
        size = F.floor((size - 2 * (kernel // 2) * padded) / pool)
        out.append(size)
    return out


def init_bound(method: str, fan_in: int, fan_out: int, value: float = 0.0) -> float:
    """Half-width of the uniform distribution that a method draws first weights from."""
    variance = {"heuristic": 1 / (3 * fan_in), "xavier": 2 / (fan_in + fan_out), "xavier_caffe": 1 / fan_in, "kaiming": 4 / (fan_in + fan_out)}
    return value if method in ("fixed", "uniform", "normal") else math.sqrt(3 * variance[method])


def initial_weight(method: str, fan_in: int, fan_out: int, uniform: Column, normal: Column, value: float = 0.0) -> Column:
    """A first weight from a uniform number in [0, 1) and a standard normal one."""
    bound = init_bound(method, fan_in, fan_out, value)
    return F.lit(float(value)) if method == "fixed" else normal * value if method == "normal" else (uniform * 2 - 1) * bound


def uniform_of(*parts) -> Column:
    """A pseudo-random number in [0, 1) that any engine with md5 can reproduce."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0
