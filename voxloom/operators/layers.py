"""Layers of a volumetric network over volumes in long form: (sample_id, channel, h, w, d, value).

A volume is never one group: convolution scatters each voxel to its 27 neighbours by key arithmetic
and sums by voxel, with a combine before the shuffle; normalisation needs one row for each channel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("h", "w", "d")


def convolved(volume: DataFrame, weights: np.ndarray, bias: list[float], shape: tuple[int, int, int]) -> DataFrame:
    """Each output channel's sum over all input channels and the 3 x 3 x 3 neighbourhood, zeros around the volume.

    weights: [output, input, 3, 3, 3], literals of the plan; the neighbour at offset (a, b, c) has the
    weight at (a + 1, b + 1, c + 1). Absent voxels count as zeros; a voxel without any neighbour has no
    row, one of which all neighbours are null has the bias.
    """
    outputs, inputs = weights.shape[:2]
    spread = volume.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(26))))
    # The voxel is the neighbour at offset k of the one it is sent to.
    for axis, place, size in zip(AXES, (9, 3, 1), shape, strict=True):
        offset = F.pmod(F.floor(F.col("k") / place), F.lit(3)) - 1
        spread = spread.withColumn(axis, (F.col(axis) - offset).cast("int")).where(F.col(axis).between(0, size - 1))
    place = (F.col("channel") * 27 + F.col("k")).cast("int")
    part = [F.sum(F.col("value") * F.get(F.array(*[F.lit(float(v)) for v in weights[o].reshape(inputs * 27)]), place)) for o in range(outputs)]
    sums = spread.groupBy("sample_id", *AXES).agg(*[p.alias(f"out{o}") for o, p in enumerate(part)])
    both = F.array(*[F.coalesce(F.col(f"out{o}"), F.lit(0.0)) + F.lit(float(bias[o])) for o in range(outputs)])
    return sums.select("sample_id", *AXES, F.posexplode(both).alias("channel", "value")).select("sample_id", "channel", *AXES, "value")


def moments(volume: DataFrame) -> DataFrame:
    """(channel, mean, variance, n) over all samples and voxels."""
    return volume.groupBy("channel").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.count("value").alias("n"))


def normalised(volume: DataFrame, stats: DataFrame, gamma: float = 1.0, beta: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """Values less their channel's mean, by its deviation; stats (channel, mean, variance) of this batch or running ones.

    stats has a row for each channel of a network, and so is joined by a broadcast.
    """
    scaled = (F.col("value") - F.col("mean")) / F.sqrt(F.col("variance") + eps) * gamma + beta
    return volume.join(F.broadcast(stats.select("channel", "mean", "variance")), "channel").withColumn("value", scaled).select(*volume.columns)


def running(old: DataFrame, batch: DataFrame, momentum: float = 0.1) -> DataFrame:
    """Running moments after a batch: the batch's unbiased variance and mean by the momentum; new channels start with the batch."""
    unbiased = F.col("b.variance") * F.col("b.n") / F.greatest(F.col("b.n") - 1, F.lit(1))

    def mixed(name: str, new: Column) -> Column:
        return (F.coalesce(F.col(f"o.{name}") * (1 - momentum) + new * momentum, new, F.col(f"o.{name}"))).alias(name)

    both = old.alias("o").join(batch.alias("b"), F.col("o.channel") == F.col("b.channel"), "full")
    return both.select(F.coalesce("o.channel", "b.channel").alias("channel"), mixed("mean", F.col("b.mean")), mixed("variance", unbiased))


def rectified(volume: DataFrame) -> DataFrame:
    return volume.withColumn("value", F.greatest(F.col("value"), F.lit(0.0)))


def pooled(volume: DataFrame, p: int) -> DataFrame:
    """Greatest value of each channel's blocks of p x p x p voxels."""
    low = [F.floor(F.col(c) / p).cast("int").alias(c) for c in AXES]
    return volume.groupBy("sample_id", "channel", *low).agg(F.max("value").alias("value"))
