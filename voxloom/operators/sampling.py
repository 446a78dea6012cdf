"""Splits, samples and noise. Random numbers follow from hashes of keys, so that reruns and lost tasks give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as g
from voxloom.functions.tensors import uniform_of


def every_nth(rows: DataFrame, order: str, n: int, partition: str) -> DataFrame:
    """Every n-th row of each partition."""
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1
    return rows.withColumn("voxloom_rank", rank).where(F.col("voxloom_rank") % n == 0).drop("voxloom_rank")


def split(rows: DataFrame, key: str, fractions: dict[str, float], seed: str = "split") -> DataFrame:
    """(key, part): disjoint parts of the given shares, by a hash of the key; no sort and no shuffle."""
    u = uniform_of(F.lit(seed), F.col(key).cast("string"))
    upto, part = 0.0, F.lit(None).cast("string")
    for name, share in reversed(list(fractions.items())):
        upto = sum(list(fractions.values())[: list(fractions).index(name) + 1])
        part = F.when(u < upto, F.lit(name)).otherwise(part)
    return rows.select(key, part.alias("part")).where("part IS NOT NULL")


def exact_split(rows: DataFrame, key: str, fractions: dict[str, float], group: str, seed: str = "split") -> DataFrame:
    """(group, key, part) with floor(share * n) rows of each group in each part, in the order of the hash."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)
    ranked = rows.select(group, key, (F.row_number().over(order) - 1).alias("rank"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    part, start = F.lit(None).cast("string"), F.lit(0)
    bounds = []
    for name, share in fractions.items():
        size = F.floor(F.lit(share) * F.col("n"))
        bounds.append((name, start, start + size))
        start = start + size
    for name, low, high in bounds:
        part = F.when((F.col("rank") >= low) & (F.col("rank") < high), F.lit(name)).otherwise(part)
    return ranked.select(group, key, part.alias("part")).where("part IS NOT NULL")


def minibatch(rows: DataFrame, key: str, size: int, step: int) -> DataFrame:
    """A batch without replacement: the least hashes of a step."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(step)), F.col(key).cast("string"))), key).limit(size)


def surface_points(triangles: DataFrame, samples: int) -> DataFrame:
    """(mesh_id, k, fid, x, y, z): points spread evenly over each mesh's surface.

    A hash-drawn number picks the face whose range of cumulative area holds it: both sides get cells of
    1/64 and meet by equality of mesh and cell.
    """
    from voxloom.operators.mesh import area_shares

    cells = 64
    shares = area_shares(triangles).withColumn("low", F.coalesce(F.lag("share").over(Window.partitionBy("mesh_id").orderBy("fid")), F.lit(0.0)))
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("share") * cells))))
    drawn = triangles.select("mesh_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    number = lambda name: uniform_of(F.lit(name), F.col("mesh_id").cast("string"), F.col("k").cast("string"))
    drawn = drawn.withColumn("u", number("face")).withColumn("cell", F.floor(F.col("u") * cells))
    hit = drawn.join(shares, ["mesh_id", "cell"]).where("low <= u AND u < share").select("mesh_id", "k", "fid").join(triangles, ["mesh_id", "fid"])
    r, s = F.sqrt(number("r")), number("s")
    weights = (1 - r, r * (1 - s), r * s)
    at = [sum(w * F.col(f"{p}{c}") for w, p in zip(weights, "akc", strict=True)) for c in "xyz"]
    return hit.select("mesh_id", "k", "fid", *[v.alias(c) for c, v in zip("xyz", at, strict=True)])


def perturbed(rows: DataFrame, key: str, times: int) -> DataFrame:
    """Each row `times` times with a random yaw, flip, scale and shift."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    u = lambda name: uniform_of(F.lit(name), F.col(key).cast("string"), F.col("copy").cast("string"))
    p = g.vec("x", "y", "z")
    flipped = (F.when(u("flip") < 0.5, -p[0]).otherwise(p[0]), p[1], p[2])
    turned = g.scale(g.rotate_y(flipped, (u("yaw") - 0.5) * 0.2), 0.9 + 0.2 * u("scale"))
    moved = g.add(turned, tuple(u(f"shift{c}") - 0.5 for c in "xyz"))
    return out.select(*[c for c in out.columns if c not in ("x", "y", "z")], *[v.alias(n) for n, v in zip("xyz", moved, strict=True)])


def padded_copies(boxes: DataFrame, times: int, padding: float) -> DataFrame:
    """Each box `times` times, its size grown by twice the padding's share; all other columns stay."""
    grown = boxes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return grown.withColumns({c: F.col(c) * (1 + 2 * padding) for c in ("sx", "sy", "sz")})


def noisy_depth(depth: Column, ignored: float, rate: float, farthest: float, u: Column, v: Column) -> Column:
    """A share of the depths is lost (farthest); the others grow by an exponential error. u and v lie in [0, 1)."""
    return F.when(u < ignored, F.lit(farthest)).otherwise(depth - F.log(1 - v) / rate)
