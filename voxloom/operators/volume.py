"""Volumes in long form: (sample_id, h, w, d, value), and the packed form (sample_id, data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import tensors

CELL = ("h", "w", "d")


def pack(volume: DataFrame, shape: tuple[int, int, int], key: str = "sample_id") -> DataFrame:
    """(key, data): a dense array for each sample; absent voxels are 0, voxels outside the shape are dropped."""
    h, w, d = shape
    inside = volume.where(F.col("h").between(0, h - 1) & F.col("w").between(0, w - 1) & F.col("d").between(0, d - 1))
    cells = inside.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(tensors.flat_index(F.col("h"), F.col("w"), F.col("d"), w, d).cast("int").alias("k"), F.col("value").alias("v")))).alias("m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(h * w * d - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("data"))


def unpack(packed: DataFrame, width: int, depth: int, key: str = "sample_id") -> DataFrame:
    """The long form of dense arrays."""
    out = packed.select(key, F.posexplode("data").alias("k", "value"))
    h, w, d = tensors.unflatten(F.col("k"), width, depth)
    return out.select(key, h.cast("int").alias("h"), w.cast("int").alias("w"), d.cast("int").alias("d"), "value")


def sparse(volume: DataFrame, above: float = 0.5) -> DataFrame:
    """Coordinates of the voxels above a value."""
    return volume.where(F.col("value") > above).select("sample_id", *CELL)


def transposed(volume: DataFrame) -> DataFrame:
    """Axes (1, 0, 2)."""
    return volume.select("sample_id", F.col("w").alias("h"), F.col("h").alias("w"), "d", "value")


def run_lengths(volume: DataFrame, width: int, depth: int, most: int = 255) -> DataFrame:
    """(sample_id, run, value, n): runs of equal values in flat order, cut at `most`.

    Runs are islands: the difference of two row numbers stays the same within one.
    """
    k = tensors.flat_index(F.col("h"), F.col("w"), F.col("d"), width, depth)
    rows = volume.select("sample_id", k.alias("k"), "value")
    all_rows, alike = Window.partitionBy("sample_id").orderBy("k"), Window.partitionBy("sample_id", "value").orderBy("k")
    islands = rows.withColumn("island", F.row_number().over(all_rows) - F.row_number().over(alike))
    runs = islands.groupBy("sample_id", "value", "island").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    cut = runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))))
    cut = cut.withColumn("first", F.col("first") + F.col("part") * most).withColumn("n", F.least(F.lit(most), F.col("n") - F.col("part") * most))
    return cut.select("sample_id", (F.row_number().over(Window.partitionBy("sample_id").orderBy("first")) - 1).cast("long").alias("run"), "value", "n")


def expand_runs(values: Column, counts: Column) -> Column:
    """The array that runs of values and their counts stand for."""
    return F.flatten(F.zip_with(values, counts, lambda v, n: F.array_repeat(v, n)))


def pooled(volume: DataFrame, p: int) -> DataFrame:
    """Greatest value of each block of p x p x p voxels."""
    low = [F.floor(F.col(c) / p).cast("int").alias(c) for c in CELL]
    return volume.select("sample_id", *low, "value").groupBy("sample_id", *CELL).agg(F.max("value").alias("value"))


def upsampled(volume: DataFrame, p: int) -> DataFrame:
    """Each voxel p x p x p times."""
    out = volume
    for c in CELL:
        out = out.withColumn("voxloom_k", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn(c, (F.col(c) * p + F.col("voxloom_k")).cast("int")).drop("voxloom_k")
    return out


def non_empty(volume: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """All tensors, cut down to the samples in which the first has a positive sum."""
    kept = volume.groupBy("sample_id").agg(F.sum("value").alias("total")).where("total > 0").select("sample_id")
    return [t.join(kept, "sample_id", "left_semi") for t in (volume, *others)]


def exclusive(space: DataFrame, occupied: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Free voxels that are not occupied."""
    return space.join(occupied, [key, *CELL], "left_anti")


def stacked(*channels: DataFrame) -> DataFrame:
    """One tensor of several channels."""
    out = None
    for k, c in enumerate(channels):
        part = c.select("sample_id", F.lit(k).alias("channel"), *CELL, "value")
        out = part if out is None else out.unionByName(part)
    return out


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """Samples of the second after those of the first; their ids go on from the largest."""
    last = first.agg((F.coalesce(F.max("sample_id"), F.lit(-1)) + 1).alias("voxloom_base"))
    moved = second.crossJoin(F.broadcast(last))  # one row
    return first.unionByName(moved.withColumn("sample_id", F.col("sample_id") + F.col("voxloom_base")).drop("voxloom_base"))


def cubes(occupied: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a unit cube for each voxel, without merging: 8 and 12 a voxel."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    bit = lambda b: F.pmod(F.floor(F.col("corner") / b), F.lit(2))
    vertices = occupied.withColumn("corner", corner).select(key, *CELL, "corner", (F.col("w") + bit(1)).alias("x"), (F.col("h") + bit(2)).alias("y"), (F.col("d") + bit(4)).alias("z"))
    # A side is the corners of which one bit is set or not; its two triangles share a diagonal.
    sides = [(a, b, s) for a, b, s in ((1, 2, 4), (2, 4, 1), (4, 1, 2))]
    triangles = []
    for a, b, s in sides:
        for base in (0, s):
            quad = (base, base + a, base + a + b, base + b) if base else (base, base + b, base + a + b, base + a)
            triangles += [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
    faces = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"v{k}") for k, v in enumerate(t)]) for t in triangles]))
    return vertices, occupied.select(key, *CELL, faces.alias("f")).select(key, *CELL, "f.*")


def occupied_cells(volume: DataFrame, threshold: float = 0.0) -> DataFrame:
    return volume.where(F.col("value") > threshold).groupBy("sample_id").agg(F.count("*").alias("occupied"))
