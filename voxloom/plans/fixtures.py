"""Geometric tables derived from the driver's tables, in Spark and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = (24, 54, 24)  # height, width, depth


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e(k: int) -> Column:
    """The k-th number of a vector, from 1, as a double."""
    return F.get("embedding", k - 1).cast("double")


def E(k: int) -> str:
    return f"CAST(embedding[{k}] AS DOUBLE)"


def xyz(k: int, *names: str) -> list[Column]:
    return [((e(k + i) + 0.5) * size).alias(n) for i, (n, size) in enumerate(zip(names, (54, 24, 24), strict=True))]


def XYZ(k: int, *names: str) -> str:
    return ", ".join(f"({E(k + i)}+0.5)*{size} AS {n}" for i, (n, size) in enumerate(zip(names, (54, 24, 24), strict=True)))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("long").alias("cloud_id"), *xyz(1, "x", "y", "z"))


POINTS = f"(SELECT vec_id AS point_id, CAST(label AS BIGINT) AS cloud_id, {XYZ(1, 'x', 'y', 'z')} FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("box_id"), (12 + 40 * F.abs(e(4))).alias("sx"), (8 + 20 * F.abs(e(5))).alias("sy"), (8 + 20 * F.abs(e(6))).alias("sz"), *xyz(7, "tx", "ty", "tz"), (e(10) * math.pi).alias("yaw"))


BOXES = f"(SELECT vec_id AS box_id, 12+40*abs({E(4)}) AS sx, 8+20*abs({E(5)}) AS sy, 8+20*abs({E(6)}) AS sz, {XYZ(7, 'tx', 'ty', 'tz')}, {E(10)}*pi() AS yaw FROM embeddings)"


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumnRenamed("point_id", "ray_id")


RAYS = f"(SELECT point_id AS ray_id, cloud_id, x, y, z FROM {POINTS})"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("mesh_id"), F.col("vec_id").alias("fid"), *xyz(11, "ax", "ay", "az"), *xyz(14, "kx", "ky", "kz"), *xyz(17, "cx", "cy", "cz"))


TRIANGLES = f"(SELECT CAST(label AS BIGINT) AS mesh_id, vec_id AS fid, {XYZ(11, 'ax', 'ay', 'az')}, {XYZ(14, 'kx', 'ky', 'kz')}, {XYZ(17, 'cx', 'cy', 'cz')} FROM embeddings)"


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 volumes in long form."""
    k = F.col("k")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("k", "v")).select(
        "sample_id", F.floor(k / 16).cast("int").alias("h"), F.pmod(F.floor(k / 4), F.lit(4)).cast("int").alias("w"), F.pmod(k, F.lit(4)).cast("int").alias("d"), (F.col("v").cast("double") * 20).alias("value"))


VOLUME = "(SELECT vec_id AS sample_id, CAST(k//16 AS INT) AS h, CAST((k//4)%4 AS INT) AS w, CAST(k%4 AS INT) AS d, CAST(embedding[k+1] AS DOUBLE)*20 AS value FROM embeddings, (SELECT unnest(range(64)) AS k))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted probabilities and true occupancy; the truth comes from the next vector."""
    own = volume(spark, sf_dir).select("sample_id", "h", "w", "d", (F.lit(1.0) / (1.0 + F.exp(-0.4 * F.col("value")))).alias("pred"), (-F.col("value")).alias("pred_sdf"))
    true = volume(spark, sf_dir).select((F.col("sample_id") - 1).alias("sample_id"), "h", "w", "d", F.when(F.col("value") > 0, 1.0).otherwise(0.0).alias("target"), (-F.col("value")).alias("target_sdf"))
    return own.join(true, ["sample_id", "h", "w", "d"])


PREDICTIONS = f"(SELECT a.sample_id, a.h, a.w, a.d, 1/(1+exp(-0.4*a.value)) AS pred, -a.value AS pred_sdf, CASE WHEN b.value > 0 THEN 1.0 ELSE 0.0 END AS target, -b.value AS target_sdf FROM {VOLUME} a JOIN {VOLUME} b ON b.sample_id = a.sample_id+1 AND a.h=b.h AND a.w=b.w AND a.d=b.d)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-dimensional codes: mean and log variance of each dimension."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.arrays_zip(F.slice("embedding", 1, 32).alias("mu"), F.slice("embedding", 33, 32).alias("lv")).alias("z"))
    return vectors.select("sample_id", F.posexplode("z").alias("dim", "z")).select("sample_id", "dim", F.col("z.mu").cast("double").alias("mu"), F.col("z.lv").cast("double").alias("lv"))


CODES = "(SELECT vec_id AS sample_id, CAST(k AS INT) AS dim, CAST(embedding[k+1] AS DOUBLE) AS mu, CAST(embedding[k+33] AS DOUBLE) AS lv FROM embeddings, (SELECT unnest(range(32)) AS k))"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sizes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("box_id"), (12 + 40 * F.abs(e(11))).alias("sx"), (8 + 20 * F.abs(e(12))).alias("sy"), (8 + 20 * F.abs(e(13))).alias("sz"))


SIZES = f"(SELECT vec_id AS box_id, 12+40*abs({E(11)}) AS sx, 8+20*abs({E(12)}) AS sy, 8+20*abs({E(13)}) AS sz FROM embeddings)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top = 50 + 100 * e(20), 50 + 100 * e(21)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("det_id"), (F.col("vec_id") % 50).alias("frame"), F.col("label").cast("long").alias("track"), left.alias("l"), top.alias("t"), (left + 20 + 50 * F.abs(e(22))).alias("r"), (top + 20 + 50 * F.abs(e(23))).alias("b"))


DETECTIONS = f"(SELECT vec_id AS det_id, vec_id % 50 AS frame, CAST(label AS BIGINT) AS track, 50+100*{E(20)} AS l, 50+100*{E(21)} AS t, 50+100*{E(20)}+20+50*abs({E(22)}) AS r, 50+100*{E(21)}+20+50*abs({E(23)}) AS b FROM embeddings)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, frame) pairs: users and the days since 2024-01-01 on which they have an event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("frame")).distinct()


FRAMES = "(SELECT DISTINCT user_id AS track, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame FROM events)"


def protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training log: iteration and loss."""
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("iter"), F.col("value").alias("loss"))


PROTOCOL = "(SELECT event_id+1 AS iter, value AS loss FROM events)"


def r6(column: Column) -> Column:
    """Rounded for comparison; adding 0 turns -0 into 0."""
    return F.round(column, 6) + F.lit(0.0)


def quick6(column: Column) -> Column:
    """As r6, by arithmetic where the numbers allow it: F.round goes through a decimal, which for results of all pairs is most of the work."""
    millionths = F.floor(F.abs(column) * 1e6 + 0.5) / 1e6
    return F.when(F.abs(column) < 1e6, F.when(column < 0, -millionths).otherwise(millionths) + F.lit(0.0)).otherwise(r6(column))


def rounded(**columns: Column) -> list[Column]:
    return [r6(c).alias(n) for n, c in columns.items()]


def R(**expressions: str) -> str:
    return ", ".join(f"round({x}, 6)+0.0 AS {n}" for n, x in expressions.items())


class Catalog:
    """Queries by name, each with its oracle if SQL can express it."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def op(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return register

    def add(self, name: str, f, sql: str | None = None) -> None:
        self.op(name, sql)(f)
