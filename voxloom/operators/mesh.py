"""Triangle meshes as rows: triangles (mesh_id, fid, a*, k*, c*), faces (mesh_id, fid, v0, v1, v2), vertices (mesh_id, vid, x, y, z)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as g

A, B, C = (g.vec(*(f"{p}{n}" for n in "xyz")) for p in "akc")


def areas(triangles: DataFrame) -> DataFrame:
    return triangles.select("mesh_id", "fid", g.triangle_area(A, B, C).alias("area"))


def area_shares(triangles: DataFrame) -> DataFrame:
    """(mesh_id, fid, area, share): share is the part of the mesh's area up to and with a face.

    A window over one mesh; meshes are independent, so it is partitioned.
    """
    order = Window.partitionBy("mesh_id").orderBy("fid").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("mesh_id")
    return areas(triangles).withColumn("share", F.try_divide(F.sum("area").over(order), F.sum("area").over(whole)))


def edge_lengths(triangles: DataFrame) -> DataFrame:
    """(mesh_id, mean) of all three edges of all faces."""
    lengths = F.explode(F.array(g.norm(g.sub(B, A)), g.norm(g.sub(C, B)), g.norm(g.sub(A, C))))
    return triangles.select("mesh_id", lengths.alias("length")).groupBy("mesh_id").agg(F.avg("length").alias("mean"))


def indexed(triangles: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a triangle soup; corners that agree to `digits` places are one vertex, numbered by position."""
    corners = triangles.select("mesh_id", "fid", F.posexplode(F.array(*[F.struct(*[F.round(c, digits).alias(n) for n, c in zip("xyz", v, strict=True)]) for v in (A, B, C)])).alias("k", "p"))
    vertices = corners.select("mesh_id", "p").distinct().withColumn("vid", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("p")) - 1).cast("long"))
    faces = corners.join(vertices, ["mesh_id", "p"]).groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)])
    return vertices.select("mesh_id", "vid", "p.*"), faces


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles of indexed faces: three equi-joins."""
    out = faces
    for k, p in enumerate("akc"):
        side = vertices.select("mesh_id", F.col("vid").alias(f"v{k}"), *[F.col(n).alias(f"{p}{n}") for n in "xyz"])
        out = out.join(side, ["mesh_id", f"v{k}"])
    return out


def edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, u, v, opposite) with u < v for each side of each face."""
    sides = F.explode(F.array(*[F.struct(F.least(f"v{i}", f"v{j}").alias("u"), F.greatest(f"v{i}", f"v{j}").alias("v"), F.col(f"v{k}").alias("opposite")) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]))
    return faces.select("mesh_id", "fid", sides.alias("e")).select("mesh_id", "fid", "e.*")


def vertex_faces(faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, faces, neighbours): numbers of adjacent faces and vertices."""
    by_face = faces.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).groupBy("mesh_id", "vid").agg(F.count_distinct("fid").alias("faces"))
    sides = edges(faces).select("mesh_id", "u", "v").distinct()
    both = sides.select("mesh_id", F.col("u").alias("vid"), F.col("v").alias("other")).unionByName(sides.select("mesh_id", F.col("v").alias("vid"), F.col("u").alias("other")))
    return by_face.join(both.groupBy("mesh_id", "vid").agg(F.count("*").alias("neighbours")), ["mesh_id", "vid"])


def cleaned(faces: DataFrame) -> DataFrame:
    """Without degenerate faces, and of faces with the same corners the first."""
    proper = faces.where("v0 <> v1 AND v1 <> v2 AND v0 <> v2")
    key = F.array_sort(F.array("v0", "v1", "v2")).alias("key")
    first = proper.groupBy("mesh_id", key).agg(F.min(F.struct("fid", "v0", "v1", "v2")).alias("f"))
    return first.select("mesh_id", "f.*")


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct(), ["mesh_id", "vid"], "left_semi")


def merged_vertices(vertices: DataFrame, eps: float) -> DataFrame:
    """(mesh_id, vid, target): the first vertex that no earlier one absorbed absorbs later ones within eps.

    The outcome depends on the order, so a mesh is one group.
    """
    def absorb(mesh: pd.DataFrame) -> pd.DataFrame:
        mesh = mesh.sort_values("vid")
        p = mesh[["x", "y", "z"]].to_numpy()
        ids, target = mesh["vid"].to_numpy(), np.full(len(mesh), -1, np.int64)
        cells: dict[tuple, list[int]] = {}
        for k, cell in enumerate(map(tuple, np.floor(p / eps).astype(np.int64))):
            near = (j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in cells.get((cell[0] + dx, cell[1] + dy, cell[2] + dz), ()))
            hit = min((j for j in near if ((p[j] - p[k]) ** 2).sum() <= eps * eps), default=None)
            if hit is None:
                cells.setdefault(cell, []).append(k)
            target[k] = ids[k if hit is None else hit]
        return pd.DataFrame({"mesh_id": mesh["mesh_id"], "vid": ids, "target": target})

    return vertices.select("mesh_id", "vid", "x", "y", "z").groupBy("mesh_id").applyInPandas(absorb, "mesh_id long, vid long, target long")


def feature_edges(triangles: DataFrame, faces: DataFrame, cosine: float) -> DataFrame:
    """(mesh_id, u, v, kind): sides of one face only (contour), and sides whose faces' normals differ by more than an angle."""
    n = g.cross(g.sub(B, A), g.sub(C, A))
    length = g.norm(n)
    normals = triangles.select("mesh_id", "fid", *[F.try_divide(c, length).alias(f"n{a}") for a, c in zip("xyz", n, strict=True)])
    sides = edges(faces).join(normals, ["mesh_id", "fid"]).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("faces"), F.sort_array(F.collect_list(F.struct("fid", "nx", "ny", "nz"))).alias("n"))
    pick = lambda k: tuple(F.get("n", k)[f"n{a}"] for a in "xyz")
    bend = g.dot(pick(0), pick(1))
    return sides.select("mesh_id", "u", "v", F.when(F.col("faces") == 1, "contour").when((F.col("faces") == 2) & (bend < cosine), "crease").alias("kind")).where("kind IS NOT NULL")


def feature_degrees(features: DataFrame) -> DataFrame:
    """(mesh_id, vid, n): feature edges at each vertex; other than 2 marks a corner of the skeleton."""
    return features.select("mesh_id", F.explode(F.array("u", "v")).alias("vid")).groupBy("mesh_id", "vid").agg(F.count("*").alias("n"))


def smoothed_values(values: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, value): the mean of each vertex' neighbours, one step of smoothing."""
    sides = edges(faces).select("mesh_id", "u", "v").distinct()
    both = sides.select("mesh_id", F.col("u").alias("vid"), F.col("v").alias("other")).unionByName(sides.select("mesh_id", F.col("v").alias("vid"), F.col("u").alias("other")))
    return both.join(values.select("mesh_id", F.col("vid").alias("other"), "value"), ["mesh_id", "other"]).groupBy("mesh_id", "vid").agg(F.avg("value").alias("value"))


def subdivided(vertices: DataFrame, faces: DataFrame, loop: bool = False) -> DataFrame:
    """(mesh_id, u, v, x, y, z): the new vertex of each side.

    Linear: its middle. Loop's rule for sides of two faces: 3/8 of the ends and 1/8 of the opposite
    corners; sides of one face keep the middle.
    """
    at = lambda name: vertices.select("mesh_id", F.col("vid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in "xyz"])
    sides = edges(faces).join(at("opposite"), ["mesh_id", "opposite"]).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n"), *[F.sum(f"opposite_{c}").alias(f"o_{c}") for c in "xyz"])
    both = sides.join(at("u"), ["mesh_id", "u"]).join(at("v"), ["mesh_id", "v"])
    middle = {c: (F.col(f"u_{c}") + F.col(f"v_{c}")) / 2 for c in "xyz"}
    return both.select("mesh_id", "u", "v", *[(F.when(F.col("n") == 2, middle[c] * 0.75 + F.col(f"o_{c}") / 8).otherwise(middle[c]) if loop else middle[c]).alias(c) for c in "xyz"])


def even_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, x, y, z): old vertices under Loop's rule for inner vertices."""
    sides = edges(faces).select("mesh_id", "u", "v").distinct()
    both = sides.select("mesh_id", F.col("u").alias("vid"), F.col("v").alias("other")).unionByName(sides.select("mesh_id", F.col("v").alias("vid"), F.col("u").alias("other")))
    around = both.join(vertices.select("mesh_id", F.col("vid").alias("other"), *[F.col(c).alias(f"o_{c}") for c in "xyz"]), ["mesh_id", "other"])
    sums = around.groupBy("mesh_id", "vid").agg(F.count("*").alias("n"), *[F.sum(f"o_{c}").alias(f"o_{c}") for c in "xyz"])
    n = F.col("n")
    beta = (0.625 - F.pow(0.375 + F.cos(6.283185307179586 / n) / 4, F.lit(2.0))) / n
    return vertices.join(sums, ["mesh_id", "vid"]).select("mesh_id", "vid", *[(F.col(c) * (1 - n * beta) + F.col(f"o_{c}") * beta).alias(c) for c in "xyz"])


def sliced(triangles: DataFrame, plane: tuple[float, float, float, float]) -> DataFrame:
    """(mesh_id, fid, side, x, y, z): where the sides of faces cross a plane ax + by + cz + d = 0."""
    a, b, c, d = plane
    height = lambda v: a * v[0] + b * v[1] + c * v[2] + d
    crossing = []
    for k, (p, q) in enumerate(((A, B), (B, C), (C, A))):
        hp, hq = height(p), height(q)
        t = F.try_divide(hp, hp - hq)
        at = g.add(p, g.scale(g.sub(q, p), t))
        crossing.append(F.when(hp * hq < 0, F.struct(F.lit(k).alias("side"), *[v.alias(n) for n, v in zip("xyz", at, strict=True)])))
    return triangles.select("mesh_id", "fid", F.explode(F.array_compact(F.array(*crossing))).alias("p")).select("mesh_id", "fid", "p.*")


def hull_energy(faces: DataFrame, vertices: DataFrame, targets: DataFrame, weight: float, length: float) -> DataFrame:
    """(mesh_id, energy): distances to targets (mesh_id, vid, tx, ty, tz), weighted, and squared edges against a length."""
    near = vertices.join(targets, ["mesh_id", "vid"]).groupBy("mesh_id").agg((weight * F.sum(g.squared(g.vec("x", "y", "z"), g.vec("tx", "ty", "tz")))).alias("near"))
    ends = edges(faces).select("mesh_id", "u", "v").distinct()
    for name in ("u", "v"):
        ends = ends.join(vertices.select("mesh_id", F.col("vid").alias(name), *[F.col(c).alias(f"{name}{c}") for c in "xyz"]), ["mesh_id", name])
    stretch = F.pow(g.squared(g.vec("ux", "uy", "uz"), g.vec("vx", "vy", "vz")) - length * length, F.lit(2.0))
    return near.join(ends.groupBy("mesh_id").agg(F.sum(stretch).alias("stretch")), "mesh_id").select("mesh_id", (F.col("near") + F.col("stretch")).alias("energy"))


def hull_descent(faces: DataFrame, vertices: DataFrame, targets: DataFrame, weight: float, length: float, rate: float, steps: int, scratch) -> DataFrame:
    """Vertices after so many gradient steps on hull_energy(); scratch(df, name) writes a table and reads it back.

    A step is two equi-joins on the sides and one aggregation, for all meshes at once.
    """
    sides = edges(faces).select("mesh_id", "u", "v").distinct()
    both = scratch(sides.select("mesh_id", F.col("u").alias("vid"), F.col("v").alias("other")).unionByName(sides.select("mesh_id", F.col("v").alias("vid"), F.col("u").alias("other"))), "sides")
    goals = scratch(targets.select("mesh_id", "vid", "tx", "ty", "tz"), "targets")
    now = vertices.select("mesh_id", "vid", "x", "y", "z")
    for step in range(steps):
        ends = both.join(now, ["mesh_id", "vid"]).join(now.select("mesh_id", F.col("vid").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"]), ["mesh_id", "other"])
        stretch = 4 * (g.squared(g.vec("x", "y", "z"), g.vec("ox", "oy", "oz")) - length * length)
        pull = ends.groupBy("mesh_id", "vid").agg(*[F.sum(stretch * (F.col(c) - F.col(f"o{c}"))).alias(f"g{c}") for c in "xyz"])
        moved = now.join(goals, ["mesh_id", "vid"]).join(pull, ["mesh_id", "vid"], "left")
        now = scratch(moved.select("mesh_id", "vid", *[(F.col(c) - rate * (2 * weight * (F.col(c) - F.col(f"t{c}")) + F.coalesce(f"g{c}", F.lit(0.0)))).alias(c) for c in "xyz"]), f"step{step}")
    return now


def teleported(densities: DataFrame, samples: int) -> DataFrame:
    """(mesh_id, fid, n): samples for each face, the rounding error being carried on to the next face.

    Carrying on telescopes: a face gets the rounded running sum up to it less that before it.
    """
    order = Window.partitionBy("mesh_id").orderBy("fid").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum("area").over(order) / F.sum("area").over(Window.partitionBy("mesh_id")) * samples + 0.5)
    return densities.withColumn("upto", upto).withColumn("n", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("mesh_id").orderBy("fid")), F.lit(0))).select("mesh_id", "fid", F.col("n").cast("long").alias("n"))
