"""Evaluation metrics, losses, and windows over training logs; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import tensors as t


def completion(pairs: DataFrame) -> DataFrame:
    """Means over all voxels of pairs (pred, target, pred_sdf, target_sdf), in one pass."""
    return pairs.agg(
        F.avg(F.abs(F.col("pred") - F.col("target"))).alias("occ_l1"),
        F.avg(F.abs(t.thresholded(F.col("pred")) - F.col("target"))).alias("occ_hamming"),
        F.avg(F.abs(F.col("pred_sdf") - F.col("target_sdf"))).alias("sdf_l1"),
        F.avg(F.abs(t.inside_sign(F.col("pred_sdf")) - F.col("target"))).alias("sdf_hamming"),
        F.count("*").alias("voxels"),
    )


def kl(codes: DataFrame, weight: float = 1.0, second: float = 1.0) -> DataFrame:
    """(sample_id, kl)."""
    return codes.groupBy("sample_id").agg((weight * F.sum(t.kl_term(F.col("mu"), F.col("lv"), second))).alias("kl"))


def losses(pairs: DataFrame, log_variance: float = -2.0) -> DataFrame:
    """All reconstruction losses of pairs (pred, target) in one pass."""
    x, y = F.col("pred"), F.col("target")
    chance = t.gaussian_to_bernoulli(x, log_variance, 0.0)
    chance = 1 - chance  # of being occupied
    return pairs.agg(
        F.sum(t.nll_term(x, y, log_variance)).alias("gaussian_nll"),
        F.sum(t.bce_term(x, y)).alias("bce"),
        F.sum(t.bce_term(x, y, 2.0)).alias("weighted_bce"),
        F.sum(t.bce_term(x, y, y)).alias("point_bce"),
        F.sum(t.bce_term(x, 1 - y, y)).alias("free_space_bce"),
        F.sum(t.bce_term(chance, y)).alias("gaussian_bce"),
        F.sum(t.bce_term(chance, y, y)).alias("gaussian_point_bce"),
        F.sum(t.bce_term(chance, 1 - y, y)).alias("gaussian_free_space_bce"),
    )


def weighted_free_space(pairs: DataFrame, statistics: DataFrame) -> DataFrame:
    """Free-space loss with a weight for each voxel of the grid."""
    both = pairs.join(statistics, ["h", "w", "d"])
    return both.agg(F.sum(t.bce_term(F.col("pred"), 1 - F.col("target"), F.col("target") * F.col("share"))).alias("loss"))


def gaussian_prior(codes: DataFrame, weight: float = 1.0) -> DataFrame:
    """Negative log prior of a batch of codes; the constant counts the samples of the batch."""
    return codes.agg((weight * (F.log(F.pow(F.lit(2 * 3.141592653589793), F.lit(1.0))) * F.count_distinct("sample_id") / 2 + 0.5 * F.sum(F.col("mu") * F.col("mu")))).alias("prior"))


def weight_decay(codes: DataFrame, weight: float) -> DataFrame:
    return codes.agg((weight * F.sum(F.col("mu") * F.col("mu")) / 2).alias("decay"))


def smoothed(log: DataFrame, n: int) -> DataFrame:
    """(iter, loss): the mean of the last n rows at every n-th iteration.

    Iterations are whole numbers from 1, so a block is a group and no window over all rows is needed.
    """
    block = F.floor((F.col("iter") - 1) / n)
    return log.groupBy(block.alias("block")).agg(F.avg("loss").alias("smoothed"), F.count("*").alias("rows")).where(F.col("rows") == n).select(((F.col("block") + 1) * n).alias("iter"), "smoothed")


def converged(log: DataFrame, n: int, eps: float) -> DataFrame:
    """(block, change, first): changes of the block means, and the first block whose change is under eps."""
    means = smoothed(log, n).select((F.col("iter") / n).cast("long").alias("block"), "smoothed")
    before = means.select((F.col("block") + 1).alias("block"), F.col("smoothed").alias("previous"))
    changes = means.join(before, "block").select("block", F.abs(F.col("smoothed") - F.col("previous")).alias("change"))
    first = changes.where(F.col("change") < eps).agg(F.min("block").alias("first"))
    return changes.crossJoin(F.broadcast(first))  # one row


def schedule(log: DataFrame, every: int) -> DataFrame:
    """(iter, rate, momentum) of a step schedule, in closed form."""
    return log.select("iter", t.step_decay(0.01, 0.9, 1e-4, F.col("iter"), every).alias("rate"), t.step_growth(0.5, 1.05, 0.9, F.col("iter"), every).alias("momentum"))


def running(value: Column, key: str, order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
