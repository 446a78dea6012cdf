"""Spatial joins and searches as equi-joins on cells.

A range condition alone makes Spark compare everything with everything. Here each side gets the
cells that it can touch, the join is an equality of cells, and the exact condition filters what
meets; the number of candidates follows the geometry and not the product of the sides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as g

#: Rows up to which a side is sent to all tasks; beyond, it is dealt into blocks.
FEW = 1_000
#: Rows of a block of either side; a block meets a block in one task.
BLOCK = 8_192


def dealt(left: DataFrame, right: DataFrame, keys: list[str], rows: int = BLOCK) -> DataFrame:
    """The equi-join of both sides on the keys, with each key's product cut into blocks of about rows x rows."""
    one, other = blocks_of(left, right, keys, rows)
    return one.join(other.drop(*keys).hint("merge"), "voxloom_product").drop("voxloom_product")


def blocks_of(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column voxloom_product that names the blocks' products, and partitioned by it; keys are numbers, or one is a text and the last.

    Both sides of a key are dealt into blocks by a hash of the row, and each block of one meets each of
    the other, so that a key that holds most rows is the work of many tasks. The number of partitions
    follows from that of the products, as the bytes of the sides say nothing of their product.
    """
    size = lambda side, name: side.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    blocks = size(left, "voxloom_m").join(size(right, "voxloom_n"), keys)
    found = blocks.agg(F.count("*").alias("keys"), F.sum(F.col("voxloom_m").cast("long") * F.col("voxloom_n")).alias("products")).first()
    partitions = min(max(2 * (found["products"] or 0), 1), 512)
    if found["keys"] <= 100_000:
        blocks = F.broadcast(blocks)

    # One column of one type on both sides: of several, those that the optimizer knows to be constant would leave the join, and so its partitioning.
    product = F.concat_ws(":", "voxloom_i", "voxloom_j", *[F.col(k).cast("string") for k in keys]).alias("voxloom_product")

    def spread(side: DataFrame, own: str, n: str, other: str, m: str) -> DataFrame:
        out = side.withColumn(own, F.pmod(F.xxhash64(*side.columns), F.lit(1 << 30)).cast("int")).join(blocks, keys)
        out = out.withColumn(own, F.pmod(own, n)).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        return out.select(*side.columns, product).repartition(partitions, "voxloom_product")

    return spread(left, "voxloom_i", "voxloom_m", "voxloom_j", "voxloom_n"), spread(right, "voxloom_j", "voxloom_n", "voxloom_i", "voxloom_m")


def paired(left: DataFrame, right: DataFrame, keys: list[str], kernel, schema: str, rows: int = 2_048) -> DataFrame:
    """What kernel(left columns, right columns), dicts of arrays, makes of each product of two blocks: a dict of arrays.

    For tests of many operations: on whole blocks they cost a fraction of what they cost pair by pair.
    """
    numbers = lambda t: {n.removeprefix("other_"): t[n].to_numpy() for n in t.column_names if not n.endswith("voxloom_product")}
    one, other = blocks_of(left, right, keys, rows)
    other = other.select(*[F.col(c).alias(f"other_{c}") for c in other.columns])  # both sides can be one table
    names = [f.split()[0] for f in schema.split(", ")]

    def of(a: pa.Table, b: pa.Table) -> pa.Table:
        made = kernel(numbers(a), numbers(b))
        return pa.table({n: made[n] for n in names})

    return one.groupBy("voxloom_product").cogroup(other.groupBy("other_voxloom_product")).applyInArrow(of, schema)


def all_rows(side: DataFrame) -> DataFrame:
    """A key that all rows share, for products of whole tables."""
    return side.withColumn("voxloom_all", F.lit(0))


def rays_in_boxes(rays: DataFrame, boxes: DataFrame) -> DataFrame:
    """(ray_id, box_id) where a ray from the origin meets an unturned box before its end; as g.ray_hits_box."""
    low = [(F.col(f"t{a}") - F.col(f"s{a}") / 2).alias(f"low_{a}") for a in "xyz"]
    high = [(F.col(f"t{a}") + F.col(f"s{a}") / 2).alias(f"high_{a}") for a in "xyz"]

    def meet(r: dict, b: dict) -> dict:
        ray, box = [], []
        for at in range(0, len(r["x"]), 64):
            near = far = None
            with np.errstate(divide="ignore", invalid="ignore"):
                for axis in "xyz":
                    d, lo, hi = r[axis][at : at + 64, None], b[f"low_{axis}"], b[f"high_{axis}"]
                    p, q = lo / d, hi / d
                    enter, leave = np.fmin(p, q), np.fmax(p, q)
                    if (strange := r[f"nan_{axis}"][at : at + 64]).any() or b[f"nan_{axis}"].any():  # a NaN meets nothing, an unknown number (NaN here, too) doesn't count
                        known = ~(np.isnan(lo) & ~b[f"nan_{axis}"]) & ~(np.isnan(d) & ~strange[:, None])
                        enter[known & (strange[:, None] | b[f"nan_{axis}"])] = np.inf
                    if (still := d[:, 0] == 0).any():
                        inside = (lo <= 0) & (hi >= 0)
                        enter[still], leave[still] = np.where(inside, -np.inf, np.inf), np.where(inside, np.inf, -np.inf)
                    near, far = (enter, leave) if near is None else (np.fmax(near, enter), np.fmin(far, leave))
                i, j = np.nonzero((near <= far) & (near < 1) & (far > 0))
            ray.append(r["ray_id"][at + i])
            box.append(b["box_id"][j])
        return {"ray_id": np.concatenate(ray), "box_id": np.concatenate(box)}

    strange = lambda *names: [F.coalesce(F.isnan(n), F.lit(False)).alias(f"nan_{n[-1]}") for n in names]
    rays = rays.select("ray_id", "x", "y", "z", *strange("x", "y", "z"))
    boxes = boxes.select("box_id", *low, *high).select("*", *strange("low_x", "low_y", "low_z"))
    return paired(all_rows(rays), all_rows(boxes), ["voxloom_all"], meet, "ray_id long, box_id long")


def corner_arrays(t: dict) -> tuple:
    """The corners of triangles as three tuples of arrays."""
    return tuple(tuple(t[f"{p}{axis}"] for axis in "xyz") for p in "akc")


def minus(u: tuple, v: tuple) -> tuple:
    return tuple(p - q for p, q in zip(u, v, strict=True))


def dot(u: tuple, v: tuple) -> np.ndarray:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: tuple, v: tuple) -> tuple:
    return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def ray_hits(origin: tuple, direction: tuple, corners: tuple) -> np.ndarray:
    """g.ray_triangle on arrays; NaN where there is no hit."""
    a, b, c = corners
    e1, e2, s = minus(b, a), minus(c, a), minus(origin, a)
    p, q = cross(direction, e2), cross(s, e1)
    det = dot(e1, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = dot(s, p) / det, dot(direction, q) / det
        return np.where((np.abs(det) > 1e-6) & (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1), dot(e2, q) / det, np.nan)


def triangle_distances(p: tuple, corners: tuple) -> np.ndarray:
    """g.point_triangle_distance on arrays; unknown numbers are NaN, and a side with one is left out."""
    a, b, c = corners

    def to_edge(s: tuple, t: tuple) -> np.ndarray:
        d = minus(t, s)
        length = dot(d, d)
        k = np.where(length == 0, 0.0, dot(minus(p, s), d) / length)
        k = np.fmax(0.0, np.fmin(1.0, k))
        off = minus(p, tuple(x + k * y for x, y in zip(s, d, strict=True)))
        return dot(off, off)

    with np.errstate(divide="ignore", invalid="ignore"):
        ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
        d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
        det = d00 * d11 - d01 * d01
        v, w = (d11 * d20 - d01 * d21) / det, (d00 * d21 - d01 * d20) / det
        n = cross(ab, ac)
        over = dot(ap, n)
        edges = np.fmin(np.fmin(to_edge(a, b), to_edge(b, c)), to_edge(c, a))
        return np.sqrt(np.where((v >= 0) & (w >= 0) & (v + w <= 1), over * over / dot(n, n), edges))


def hits_through_origin(p: dict, corners: tuple, tile: tuple[int, int] = (64, 1024)) -> np.ndarray:
    """Of each point the triangles with ray_hits() >= 0 on the ray through the origin.

    Such a ray meets a triangle where four numbers have one sign: by the normals of the planes of the
    origin and each side, and by that of the triangle. Tiles of them come from products in single
    precision; what is too near to zero there, and what isn't regular, is tested by ray_hits().
    """
    corners = tuple(np.stack(c, 1) for c in corners)
    points, (a, b, c) = np.stack([p[axis] for axis in "xyz"], 1), corners
    count = np.zeros(len(points), np.int64)

    def test(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 1 << 16):
            some, q = i[at : at + (1 << 16)], points[i[at : at + (1 << 16)]].T
            with np.errstate(all="ignore"):
                hit = ray_hits(tuple(q), tuple(-q), tuple(tuple(x[j[at : at + (1 << 16)]].T) for x in corners))
            np.add.at(count, some[hit >= 0], 1)

    with np.errstate(all="ignore"):
        sides = [np.cross(c, a), np.cross(a, b), np.cross(b, c), np.cross(b - a, c - a)]
        lengths = np.stack([np.linalg.norm(s, axis=1) for s in sides])
        size = sum(np.linalg.norm(x, axis=1) for x in corners) ** 2
        even = (lengths.min(0) >= 1e-5 * size) & (lengths.max(0) >= 1) & (size < 1e15)
        far = np.linalg.norm(points, axis=1)
    near, odd = np.flatnonzero(far < 1e15), np.flatnonzero(~even)
    apart = np.flatnonzero(~(far < 1e15) & ~np.isnan(points).any(1))  # a NaN meets nothing
    for i in apart:
        test(np.full(len(a), i), np.arange(len(a)))
    for j in odd:
        test(near, np.full(len(near), j))
    even = np.flatnonzero(even)
    rows, wide = tile
    planes = np.zeros((4, 4, -(-len(even) // wide) * wide), np.float32)
    planes[:2, 3, len(even) :] = [[1e30], [-1e30]]  # nothing meets what fills the last tile
    offsets = (a[even] * sides[3][even]).sum(1) / lengths[3][even]
    for k in range(4):
        planes[k, :3, : len(even)] = (sides[k][even] / lengths[k][even, None]).T
    planes[3, 3, : len(even)] = -offsets
    places = np.column_stack([points[near], np.ones(len(near))]).astype(np.float32)
    for at in range(0, len(near), rows):
        some = places[at : at + rows]
        unsure = np.float32(1e-5 * max(1.0, far[near[at : at + rows]].max() + np.abs(offsets).max(initial=0)))
        unclear = []
        for left in range(0, planes.shape[2], wide):
            f = [some @ planes[k, :, left : left + wide] for k in range(4)]
            low, high = np.minimum(f[0], f[1]), np.maximum(f[0], f[1])
            for more in f[2:]:
                np.minimum(low, more, out=low)
                np.maximum(high, more, out=high)
            hit = (low > unsure) | (high < -unsure)
            count[near[at : at + rows]] += np.bitwise_count(hit.view(np.uint64)).sum(1, dtype=np.int64)
            i, j = np.divmod(np.flatnonzero(~(hit | (low < -unsure) & (high > unsure))), wide)
            unclear.append((near[at + i], even[left + j]))
        if unclear:
            test(*map(np.concatenate, zip(*unclear, strict=True)))
    return count


def rays_on_triangles(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """(ray_id, fid, hit): every hit of rays from the origin and triangles."""

    def meet(r: dict, t: dict) -> dict:
        corners, out = corner_arrays(t), []
        for at in range(0, len(r["x"]), 64):
            hit = ray_hits((0.0, 0.0, 0.0), tuple(r[axis][at : at + 64, None] for axis in "xyz"), corners)
            i, j = np.nonzero(~np.isnan(hit))
            out.append((r["ray_id"][at + i], t["fid"][j], hit[i, j]))
        return dict(zip(("ray_id", "fid", "hit"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    return paired(all_rows(rays.select("ray_id", "x", "y", "z").dropna()), all_rows(triangles.drop("mesh_id").dropna()), ["voxloom_all"], meet, "ray_id long, fid long, hit double")


def beside_few(many: DataFrame, few: DataFrame, key: str, most: int = FEW) -> DataFrame:
    """Every row of many with every row of few, for results that are that product by definition.

    A few counted rows are broadcast; more are dealt into blocks, as are the rows of many.
    """
    if few.count() <= most:
        return many.crossJoin(F.broadcast(few))
    return dealt(all_rows(many), all_rows(few), ["voxloom_all"]).drop("voxloom_all")


def cells_of(low: Column, high: Column) -> Column:
    """The whole numbers from floor(low) to floor(high)."""
    return F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long"))


def occupancy(points: DataFrame, shape: tuple[int, int, int], key: str = "cloud_id") -> DataFrame:
    """(key, h, w, d) of the voxels that hold a point; faces belong to both sides of them.

    A coordinate that is a whole number lies on a face, and so also in the voxel before.
    """
    def sides(c: Column) -> Column:
        low = F.floor(c).cast("int")
        return F.when(c == low, F.array(low - 1, low)).otherwise(F.array(low))

    out = points
    for name, axis, size in (("h", "y", shape[0]), ("w", "x", shape[1]), ("d", "z", shape[2])):
        out = out.withColumn(name, F.explode(sides(F.col(axis)))).where(F.col(name).between(0, size - 1))
    return out.select(key, "h", "w", "d").distinct()


def carved(rays: DataFrame, shape: tuple[int, int, int], t1: float = 1.0, keys: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    """(keys, h, w, d) of the voxels that rays from the origin cross before they end.

    Candidates come axis by axis: the slabs of x that a ray passes, within each the cells of y, and
    within these the cells of z, from the ray's parameters; the slab test then decides.
    """
    h, w, d = shape

    def part(p: Column, c: Column) -> Column:  # parameters at which the ray passes the plane c = value
        return F.try_divide(c, p)

    def clipped(v: Column, size: int) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(float(size)), v))

    def range_of(p: Column, t_low: Column, t_high: Column, size: int) -> Column:
        a, b = clipped(p * t_low, size), clipped(p * t_high, size)
        return cells_of(F.least(a, b) - 1e-9, F.greatest(a, b) + 1e-9)

    zero, one = F.lit(0.0), F.lit(float(t1))
    out = rays.withColumn("w", F.explode(range_of(F.col("x"), zero, one, w)))
    def interval(name: str, axis: str, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = part(F.col(axis), F.col(name).cast("double")), part(F.col(axis), F.col(name) + 1.0)
        return F.greatest(low, F.coalesce(F.least(a, b), low)), F.least(high, F.coalesce(F.greatest(a, b), high))

    low, high = interval("w", "x", zero, one)
    out = out.withColumn("ta", low).withColumn("tb", high).where("ta <= tb + 1e-9").withColumn("h", F.explode(range_of(F.col("y"), F.col("ta"), F.col("tb"), h)))
    low, high = interval("h", "y", F.col("ta"), F.col("tb"))
    out = out.withColumn("tc", low).withColumn("td", high).where("tc <= td + 1e-9").withColumn("d", F.explode(range_of(F.col("z"), F.col("tc"), F.col("td"), d)))
    out = out.where(F.col("h").between(0, h - 1) & F.col("w").between(0, w - 1) & F.col("d").between(0, d - 1))
    corner = (F.col("w").cast("double"), F.col("h").cast("double"), F.col("d").cast("double"))
    ones = (F.lit(1.0),) * 3
    hit = g.ray_hits_box((zero, zero, zero), g.vec("x", "y", "z"), corner, g.add(corner, ones), 0.0, t1)
    return out.where(hit).select(*keys, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("d").cast("int").alias("d")).distinct()


def voxels(spark, shape: tuple[int, int, int]) -> DataFrame:
    """All (h, w, d)."""
    h, w, d = shape
    k = F.col("id")
    return spark.range(h * w * d).select(F.floor(k / (w * d)).cast("int").alias("h"), F.pmod(F.floor(k / d), F.lit(w)).cast("int").alias("w"), F.pmod(k, F.lit(d)).cast("int").alias("d"))


def distance_field(points: DataFrame, shape: tuple[int, int, int], key: str = "cloud_id", block: int = 6) -> DataFrame:
    """(key, h, w, d, distance): from each voxel's centre to the nearest point of the cloud.

    The grid is cut into blocks. A point can be nearest to a voxel of a block only if its least distance
    from the block's centres is at most the least of all points' greatest distances; only such points
    meet the block's voxels. All minima are taken before the shuffles.
    """
    axes = list(zip("hwd", "yxz", shape, strict=True))
    near, own = points.select(key, "x", "y", "z"), [f"b{n}" for n, _, _ in axes]
    for name, _, size in axes:
        near = near.withColumn(f"b{name}", F.explode(F.sequence(F.lit(0), F.lit((size - 1) // block))))
    least = far = F.lit(0.0)
    for name, axis, size in axes:
        low = F.col(f"b{name}") * block + 0.5
        high = F.least(low + (block - 1), F.lit(size - 0.5))
        out = F.greatest(low - F.col(axis), F.col(axis) - high, F.lit(0.0))
        span = F.greatest(F.abs(F.col(axis) - low), F.abs(F.col(axis) - high))
        least, far = least + out * out, far + span * span
    bound = near.groupBy(key, *own).agg(F.min(far).alias("bound"))
    pairs = near.withColumn("least", least).join(bound, [key, *own]).where(F.col("least") <= F.col("bound") * (1 + 1e-9))
    for name, _, size in axes:
        first = F.col(f"b{name}") * block
        pairs = pairs.withColumn(name, F.explode(F.sequence(first, F.least(first + (block - 1), F.lit(size - 1)))))
    centre = (F.col("w") + 0.5, F.col("h") + 0.5, F.col("d") + 0.5)
    return pairs.groupBy(key, "h", "w", "d").agg(F.sqrt(F.min(g.squared(centre, g.vec("x", "y", "z")))).alias("distance"))


def with_turn(boxes: DataFrame, yaw: Column) -> DataFrame:
    """Boxes with what the test of a point needs, so that no pair computes it again."""
    halves = {f"voxloom_h{a}": F.col(f"s{a}") / 2 for a in "xyz"}
    return boxes.withColumns({"voxloom_cos": F.cos(yaw), "voxloom_sin": F.sin(yaw), **halves})


def turned_inside() -> Column:
    """g.in_oriented_box of a point and a box with_turn(); the cheapest test first."""
    dx, dz, c, s = F.col("x") - F.col("tx"), F.col("z") - F.col("tz"), F.col("voxloom_cos"), F.col("voxloom_sin")
    return (F.abs(F.col("y") - F.col("ty")) <= F.col("voxloom_hy")) & (F.abs(c * dx + s * dz) <= F.col("voxloom_hx")) & (F.abs(c * dz - s * dx) <= F.col("voxloom_hz"))


TURN = ("voxloom_cos", "voxloom_sin", "voxloom_hx", "voxloom_hy", "voxloom_hz")


def points_in_boxes(points: DataFrame, boxes: DataFrame, oriented: bool = True, cell: float = 8.0) -> DataFrame:
    """Each box (sx, sy, sz, tx, ty, tz, yaw) with the points in it; equal cells of the ground plane, then the exact test.

    A cell of many points and boxes is dealt into blocks. The rows hold all columns of both sides.
    """
    reach = F.sqrt(F.col("sx") * F.col("sx") + F.col("sz") * F.col("sz")) / 2
    spread = with_turn(boxes, F.col("yaw") if oriented else F.lit(0.0))
    spread = spread.withColumn("cx", F.explode(cells_of((F.col("tx") - reach) / cell, (F.col("tx") + reach) / cell)))
    spread = spread.withColumn("cz", F.explode(cells_of((F.col("tz") - reach) / cell, (F.col("tz") + reach) / cell)))
    binned = points.withColumn("cx", F.floor(F.col("x") / cell).cast("long")).withColumn("cz", F.floor(F.col("z") / cell).cast("long"))
    return dealt(binned, spread, ["cx", "cz"]).where(turned_inside()).drop("cx", "cz", *TURN)


def even_cells(points: DataFrame, rows: int) -> DataFrame:
    """points with a long `cell` of the ground plane: slabs of about equal numbers of points along x, and in each of them along z."""
    n = max(points.count(), 1)
    k = math.ceil(math.sqrt(n / min(max(rows, n // 32), 16 * rows)))
    placed = points.withColumn("cell", F.lit(0).cast("long"))
    for c in ("x", "z") if k > 1 else ():
        cuts = placed.groupBy("cell").agg(F.percentile_approx(c, [i / k for i in range(1, k)]).alias("voxloom_cuts"))
        placed = placed.join(F.broadcast(cuts), "cell")  # at most k rows
        placed = placed.withColumn("cell", F.col("cell") * k + F.size(F.filter("voxloom_cuts", lambda cut: cut < F.col(c)))).drop("voxloom_cuts")  # noqa: B023
    return placed


def turned_spans(b, c, absolute) -> dict[str, tuple]:
    """Along x and z of a box with_turn(): the least and greatest distance of a cell's points from its middle, with more than rounding can do to them.

    b and c give the box' and the cell's columns or arrays by name; a cell is the extent of its points.
    """
    (mx, hx), (mz, hz) = (((c(f"{a}0") + c(f"{a}1")) / 2, (c(f"{a}1") - c(f"{a}0")) / 2) for a in "xz")
    dx, dz, cos, sin = mx - b("tx"), mz - b("tz"), b("voxloom_cos"), b("voxloom_sin")
    wide, deep = absolute(cos), absolute(sin)
    slack = 1e-12 * (absolute(mx) + absolute(mz) + absolute(b("tx")) + absolute(b("tz")) + hx + hz)
    span = lambda at, reach: (absolute(at) - reach - slack, absolute(at) + reach + slack)
    return {"x": span(cos * dx + sin * dz, wide * hx + deep * hz), "z": span(cos * dz - sin * dx, wide * hz + deep * hx)}


def held_heights(y: np.ndarray, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted distinct heights each box holds: from, and up to; y - ty doesn't fall as y grows, so they are neighbours."""
    ends = []
    for k, outside in ((-1, lambda d: d < -b["voxloom_hy"]), (1, lambda d: d <= b["voxloom_hy"])):
        at = np.searchsorted(y, b["ty"] + k * b["voxloom_hy"], "left" if k < 0 else "right")
        while True:  # the sum is rounded otherwise than the difference
            less = (at > 0) & ~outside(y[np.maximum(at - 1, 0)] - b["ty"])
            more = (at < len(y)) & outside(y[np.minimum(at, len(y) - 1)] - b["ty"])
            if not (less | more).any():
                break
            at = at + more - less
        ends.append(at)
    return ends[0], ends[1]


def counts_in_boxes(p: dict, b: dict, leaf: int = 64, most: int = 1 << 16) -> np.ndarray:
    """How many of the points lie in each box with_turn(); all numbers are finite.

    A tree of the points' extents in the ground plane: of a node that lies in the turned rectangle the
    points of the box' heights are counted by two searches, and only leaves on its rim are tested point by point.
    """
    size, count = len(p["x"]), np.zeros(len(b["tx"]), np.int64)
    heights, rank = np.unique(p["y"], return_inverse=True)
    low, high = held_heights(heights, b)
    depth = max(0, math.ceil(math.log(size / leaf, 4)))  # a node has four children
    order, place = np.arange(size), np.arange(size)
    for level in range(2 * depth):
        order = order[np.lexsort((p["xz"[level % 2]][order], (place << level) // size))]
    p, rank = {a: p[a][order] for a in "xyz"}, rank[order]
    levels = []
    for level in range(depth + 1):
        starts = -(-np.arange(4**level) * size // 4**level)
        starts = starts[starts < size]
        extent = {f"{a}{i}": f.reduceat(p[a], starts) for a in "xz" for i, f in ((0, np.minimum), (1, np.maximum))}
        levels.append(extent | {"ranks": np.sort((place * 4**level // size) * len(heights) + rank)})
    sizes = np.diff(np.append(starts, size))
    slots = np.arange(sizes.max())
    held = {a: np.where(slots < sizes[:, None], p[a][np.minimum(starts[:, None] + slots, size - 1)], np.nan) for a in "xyz"}

    def visit(box: np.ndarray, node: np.ndarray, level: int) -> None:
        for at in range(0, len(box), most):
            some, where = box[at : at + most], node[at : at + most]
            spans = turned_spans(lambda n: b[n][some], lambda n: levels[level][n][where], np.abs)  # noqa: B023
            hx, hz = b["voxloom_hx"][some], b["voxloom_hz"][some]
            within = (spans["x"][1] <= hx) & (spans["z"][1] <= hz)
            rim = ~within & (spans["x"][0] <= hx) & (spans["z"][0] <= hz)
            found, of = some[within], where[within] * len(heights)
            ranks = levels[level]["ranks"]
            add(found, np.searchsorted(ranks, of + high[found]) - np.searchsorted(ranks, of + low[found]))
            some, where = some[rim], where[rim]
            if level < depth:
                visit(np.repeat(some, 4), (where[:, None] * 4 + np.arange(4)).ravel(), level + 1)
            else:
                test(some, where)

    def test(box: np.ndarray, node: np.ndarray) -> None:
        step = max(1, most // len(slots))
        for at in range(0, len(box), step):
            some, where = box[at : at + step], node[at : at + step]
            of = lambda n: b[n][some][:, None]  # noqa: B023, E731
            dx, dz, cos, sin = held["x"][where] - of("tx"), held["z"][where] - of("tz"), of("voxloom_cos"), of("voxloom_sin")
            found = (np.abs(held["y"][where] - of("ty")) <= of("voxloom_hy")) & (np.abs(cos * dx + sin * dz) <= of("voxloom_hx")) & (np.abs(cos * dz - sin * dx) <= of("voxloom_hz"))
            add(some, found.sum(1))

    def add(box: np.ndarray, n: np.ndarray) -> None:
        count[:] += np.bincount(box, n, len(count)).astype(np.int64)

    boxes = np.flatnonzero(low < high)
    visit(boxes, np.zeros(len(boxes), np.int64), 0)
    return count


def boxes_with_points(points: DataFrame, boxes: DataFrame, least: int, rows: int = 2 * BLOCK) -> DataFrame:
    """(box_id, n) of the boxes with at least so many points.

    No pair of a box and a point in it is made: a box takes the counts of cells that lie in it, and meets
    the points of the others that it touches in blocks (`counts_in_boxes`), at a cost of about the square
    root of a cell's points. Boxes and points with a number that isn't finite are compared one by one.
    """
    points, boxes = points.select("x", "y", "z"), with_turn(boxes, F.col("yaw")).select("box_id", "tx", "ty", "tz", *TURN)
    finite = lambda side, names: side.withColumn("voxloom_finite", F.forall(F.array(*names), lambda v: F.abs(v) < float("inf")))
    points, boxes = finite(points, ["x", "y", "z"]), finite(boxes, ["tx", "ty", "tz", *TURN])
    placed, turned = even_cells(points.where("voxloom_finite").drop("voxloom_finite"), rows), boxes.where("voxloom_finite").drop("voxloom_finite")
    ends = [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))]
    cells = placed.groupBy(F.col("cell").alias("of_cell")).agg(*ends, F.count("*").alias("n"))
    both = turned.crossJoin(F.broadcast(cells))  # tens of cells, and more only beyond millions of points
    spans = turned_spans(F.col, F.col, F.abs)
    near, far = F.col("y0") - F.col("ty"), F.col("y1") - F.col("ty")
    halves = {a: F.col(f"voxloom_h{a}") for a in "xyz"}
    meets = (spans["x"][0] <= halves["x"]) & (spans["z"][0] <= halves["z"]) & (near <= halves["y"]) & (far >= -halves["y"])
    within = (spans["x"][1] <= halves["x"]) & (spans["z"][1] <= halves["z"]) & (near >= -halves["y"]) & (far <= halves["y"])
    whole = both.where(within).select("box_id", "n")
    one, other = blocks_of(placed, both.where(meets & ~within).select(F.col("of_cell").alias("cell"), *turned.columns), ["cell"], rows)
    other = other.select(*[F.col(c).alias(f"other_{c}") for c in other.columns])
    numbers = lambda t, names, before="": {n: t[before + n].to_numpy() for n in names}

    def of(p: pa.Table, b: pa.Table) -> pa.Table:
        n = counts_in_boxes(numbers(p, "xyz"), numbers(b, ("tx", "ty", "tz", *TURN), "other_")) if len(p) and len(b) else np.zeros(len(b), np.int64)
        return pa.table({"box_id": b["other_box_id"], "n": n})

    part = one.groupBy("voxloom_product").cogroup(other.groupBy("other_voxloom_product")).applyInArrow(of, f"box_id {boxes.schema['box_id'].dataType.simpleString()}, n long")
    counts = whole.unionByName(part)
    odd_points, odd_boxes = points.where("NOT voxloom_finite"), boxes.where("NOT voxloom_finite")
    if not odd_points.isEmpty() or not odd_boxes.isEmpty():
        for p, b in ((odd_points, boxes), (points.where("voxloom_finite"), odd_boxes)):
            counts = counts.unionByName(dealt(all_rows(p.drop("voxloom_finite")), all_rows(b.drop("voxloom_finite")), ["voxloom_all"]).where(turned_inside()).select("box_id", F.lit(1).cast("long").alias("n")))
    return counts.groupBy("box_id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def crop_to_boxes(points: DataFrame, boxes: DataFrame, frame: str = "frame") -> DataFrame:
    """Each box with the points of its own frame that lie in it; a frame of many is dealt into blocks."""
    return dealt(points, with_turn(boxes, F.col("yaw")), [frame]).where(turned_inside()).drop(*TURN)


def without(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def masked(points: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Points under the mask become zero points; they stay in place."""
    marked = points.join(mask.select(key).distinct().withColumn("voxloom_masked", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("voxloom_masked"), 0.0).otherwise(F.col(c)).alias(c) if c in "xyz" else F.col(c) for c in points.columns])


def crop_to_detection(points: DataFrame, detections: DataFrame, radius: float, centre: tuple = (27.0, 12.0, 12.0)) -> DataFrame:
    """Points of a detection's frame whose pixel lies in its rectangle, near its centre and not at the camera."""
    u, v = F.col("x") + 30, F.col("y") + 40
    in_rectangle = (u >= F.col("l")) & (u < F.col("r")) & (v >= F.col("t")) & (v < F.col("b"))
    at_camera = (F.abs("x") < 1) & (F.abs("y") < 1) & (F.abs("z") < 1)
    near = g.squared(g.vec("x", "y", "z"), tuple(F.lit(c) for c in centre)) <= radius * radius
    return points.join(detections, "frame").where(in_rectangle & ~at_camera & near)


def frame_neighbours(frames: DataFrame, reach: int, step: int, track: str = "track", frame: str = "frame") -> DataFrame:
    """(track, frame, offset, other) for the frames at offsets -reach..reach that exist; an equi-join on the wanted frame."""
    wanted = frames.select(track, frame, F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"), F.lit(step).cast("long"))).alias("offset"))
    wanted = wanted.where("offset <> 0").withColumn("other", F.col(frame) + F.col("offset"))
    return wanted.join(frames.select(track, F.col(frame).alias("other")), [track, "other"])


def nearest_size(queries: DataFrame, references: DataFrame, scratch, start: float = 2.0) -> DataFrame:
    """For each box the reference of the nearest size, of equals the first: (box_id, ref_id, distance); a nearest() in the space of sizes."""
    sizes = lambda df, name: df.selectExpr(f"box_id AS {name}", "sx AS x", "sy AS y", "sz AS z")
    found = nearest(sizes(queries, "query_id"), sizes(references, "point_id"), 1, start, scratch, key=None)
    return found.select(F.col("query_id").alias("box_id"), F.col("point_id").alias("ref_id"), F.sqrt("d2").alias("distance"))


def same_size(queries: DataFrame, references: DataFrame, eps: float = 1e-5) -> DataFrame:
    """For each box the last reference whose size is equal up to a relative eps."""
    cell = lambda c: F.floor(F.col(c) * 4).cast("long")
    left = queries.select("box_id", "sx", "sy", "sz", F.explode(F.array(cell("sx") - 1, cell("sx"), cell("sx") + 1)).alias("cell"))
    right = references.selectExpr("box_id AS ref_id", "sx AS rx", "sy AS ry", "sz AS rz").withColumn("cell", F.floor(F.col("rx") * 4).cast("long"))
    a, b = g.vec("sx", "sy", "sz"), g.vec("rx", "ry", "rz")
    near = g.squared(a, b) <= eps * eps * F.least(g.dot(a, a), g.dot(b, b))
    return left.join(right, "cell").where(near).groupBy("box_id").agg(F.max("ref_id").alias("ref_id"))


def used_match(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The j-th used entry for each wanted j: entries (group, position, used), wanted (group, j)."""
    order = Window.partitionBy("group").orderBy("position")
    ranked = entries.where("used").withColumn("j", (F.row_number().over(order) - 1).cast("long"))
    return wanted.join(ranked, ["group", "j"]).select("group", "j", "position")


def radius_search(queries: DataFrame, points: DataFrame, radius: float, key: str | None = "cloud_id") -> DataFrame:
    """(query_id, point_id, d2) of all points within a radius of each query; by equal cells of that size."""
    names = [key] if key else []
    spread = queries.select("query_id", *names, F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))
    for a in "xyz":
        spread = spread.withColumn(f"c{a}", F.explode(cells_of(F.col(f"q{a}") / radius - 1, F.col(f"q{a}") / radius + 1)))
    binned = points.select("point_id", *names, "x", "y", "z", *[F.floor(F.col(a) / radius).cast("long").alias(f"c{a}") for a in "xyz"])
    d2 = g.squared(g.vec("qx", "qy", "qz"), g.vec("x", "y", "z"))
    return binned.join(spread, [*names, "cx", "cy", "cz"]).select("query_id", "point_id", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def fitting_radius(points: DataFrame, start: float, names: list[str], most: int, halvings: int = 16) -> float:
    """`start`, halved until a point's own cell of that size holds at most so many points on average."""
    sizes = [start * 0.5**j for j in range(halvings)]
    at = points.withColumn("r", F.explode(F.array(*[F.lit(r) for r in sizes])))
    cells = at.groupBy("r", *names, *[F.floor(F.col(a) / F.col("r")).alias(f"c{a}") for a in "xyz"]).agg(F.count("*").alias("n"))
    crowds = {row.r: row.crowd for row in cells.groupBy("r").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("crowd")).collect()}
    return next((r for r in sizes if crowds.get(r, 0) <= most), sizes[-1])


def nearest(queries: DataFrame, points: DataFrame, k: int, start: float, scratch, key: str | None = "cloud_id", apart: int = -1, within: float | None = None) -> DataFrame:
    """(query_id, point_id, d2, rank): the k nearest points of each query, squared distances, ties by point_id.

    A search within a radius settles every query that finds k points there; the others go on with
    twice the radius. The first radius is `start` or less: so that cells hold few points, however many
    there are. The last round has a radius from end to end of all queries and points, and so finds all
    that there is, or is `within`, if no point farther off is wanted. apart >= 0 leaves out points whose
    id is within `apart` of the query's. scratch(df, name) writes a table and reads it back.
    """
    names = [key] if key else []
    # Of points at one place only the first ids can be among the nearest.
    place = Window.partitionBy(*names, "x", "y", "z").orderBy("point_id")
    points = points.select("point_id", *names, "x", "y", "z").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    points = points.withColumn("voxloom_place", F.row_number().over(place) if apart < 0 else F.dense_rank().over(place))
    points = scratch(points.where(F.col("voxloom_place") <= k + (2 * apart + 1 if apart >= 0 else 0)).drop("voxloom_place"), "points")
    size = points.groupBy(*names).agg(F.count("*").alias("n")) if names else points.agg(F.count("*").alias("n"))
    rest = queries.join(size, names) if names else queries.crossJoin(F.broadcast(size))
    ends = points.select("x", "y", "z").unionByName(queries.select("x", "y", "z")).agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    across = sum((d or 0.0) ** 2 for d in ends) ** 0.5
    radius, out = fitting_radius(points, start, names, k + 3), None
    while True:
        last = radius > across or (within is not None and radius >= within)
        radius = min(radius, within) if within is not None else radius
        found = radius_search(rest, points, radius, key)
        if apart >= 0:
            found = found.where(F.abs(F.col("query_id") - F.col("point_id")) > apart)
        order = Window.partitionBy("query_id").orderBy("d2", "point_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "point_id", "d2", "rank")
        if last:
            return best if out is None else out.unionByName(best)
        best = scratch(best, f"best{radius:g}")
        done = best.groupBy("query_id").agg(F.count("*").alias("got"))
        enough = F.col("got") >= (F.lit(k) if apart >= 0 else F.least(F.col("n"), F.lit(k)))
        settled = scratch(rest.join(done, "query_id").where(enough).select("query_id"), f"settled{radius:g}")
        part = best.join(settled, "query_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        rest = scratch(rest.join(settled, "query_id", "left_anti"), f"rest{radius:g}")
        if rest.isEmpty():
            return out
        radius *= 2


def signed_distance(queries: DataFrame, triangles: DataFrame, key: str = "mesh_id", parity: bool = True) -> DataFrame:
    """(query_id, distance, hits): to the nearest triangle of the mesh, negative inside.

    Inside is an odd number of triangles between the query and the origin side: the ray goes from the
    query through the origin. Each product of a block of queries and one of triangles gives its minimum
    and its number of hits for each query. Without parity nothing is negative, and there are no hits.
    """
    names = [f"{p}{axis}" for p in "akc" for axis in "xyz"]
    strange = F.isnan("x") | F.isnan("y") | F.isnan("z")

    def meet(q: dict, t: dict) -> dict:
        corners, near, hits = corner_arrays(t), [], []
        for at in range(0, len(q["x"]), 64):
            p = tuple(q[axis][at : at + 64, None] for axis in "xyz")
            near.append(np.fmin.reduce(triangle_distances(p, corners), axis=1))
            hits.append((ray_hits(p, tuple(-v for v in p), corners) >= 0).sum(1) if parity else np.zeros(len(p[0]), np.int64))
        return {"query_id": q["query_id"], "near": np.concatenate(near), "hits": np.concatenate(hits)} | {"strange": q["strange"]}

    sides = queries.select("query_id", key, "x", "y", "z", F.coalesce(strange, F.lit(False)).alias("strange")), triangles.select(key, *names)
    made = paired(*sides, [key], meet, "query_id long, near double, hits long, strange boolean")
    near = F.min(F.when(~F.isnan("near"), F.col("near")))
    found = made.groupBy("query_id").agg(F.when(F.max("strange"), F.lit(float("nan"))).otherwise(near).alias("near"), F.sum("hits").alias("hits"))
    return found.select("query_id", F.when(F.col("hits") % 2 == 1, -F.col("near")).otherwise(F.col("near")).alias("distance"), "hits")


def hits_to_origin(queries: DataFrame, triangles: DataFrame, key: str = "mesh_id", rows: int = 4 * BLOCK) -> DataFrame:
    """(query_id, hits): how many triangles of its mesh lie between each query and the origin, or behind it. By blocks, as signed_distance, but without distances."""
    names = [f"{p}{axis}" for p in "akc" for axis in "xyz"]
    sides = queries.select("query_id", key, "x", "y", "z"), triangles.select(key, *names)
    made = paired(*sides, [key], lambda q, t: {"query_id": q["query_id"], "hits": hits_through_origin(q, corner_arrays(t))}, "query_id long, hits long", rows)
    return made.groupBy("query_id").agg(F.sum("hits").alias("hits"))


def depth_image(rays: DataFrame, triangles: DataFrame, key: str = "mesh_id") -> DataFrame:
    """(ray_id, depth): parameter of each ray's first hit; rays that hit nothing are left out. By blocks, as signed_distance."""

    def meet(r: dict, t: dict) -> dict:
        corners, first = corner_arrays(t), []
        for at in range(0, len(r["x"]), 64):
            hit = ray_hits((0.0, 0.0, 0.0), tuple(r[axis][at : at + 64, None] for axis in "xyz"), corners)
            first.append(np.fmin.reduce(np.where(hit > 0, hit, np.inf), axis=1))
        first = np.concatenate(first)
        return {"ray_id": r["ray_id"][first < np.inf], "depth": first[first < np.inf]}

    names = [f"{p}{axis}" for p in "akc" for axis in "xyz"]
    sides = rays.select("ray_id", key, "x", "y", "z").dropna(), triangles.select(key, *names).dropna()
    return paired(*sides, [key], meet, "ray_id long, depth double").groupBy("ray_id").agg(F.min("depth").alias("depth"))


def unit_cube(points: DataFrame, padding: float, key: str = "cloud_id") -> DataFrame:
    """Clouds centred at the middle of their extents and divided by the largest extent, padded."""
    extents = points.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    size = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]) * (1 + padding)
    moved = points.join(extents, key)
    return moved.select(*[F.try_divide(F.col(c) - (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2, size).alias(c) if c in "xyz" else F.col(c) for c in points.columns])


def pixel_normals(grid: DataFrame, image: str) -> DataFrame:
    """Unit normals from each pixel's right and lower neighbours; the last row and column have none."""
    right = F.lead(F.struct("x", "y", "z")).over(Window.partitionBy(image, "v").orderBy("u"))
    below = F.lead(F.struct("x", "y", "z")).over(Window.partitionBy(image, "u").orderBy("v"))
    both = grid.withColumn("right", right).withColumn("below", below).where("right IS NOT NULL AND below IS NOT NULL")
    p = g.vec("x", "y", "z")
    n = g.cross(g.sub(g.vec("right.x", "right.y", "right.z"), p), g.sub(g.vec("below.x", "below.y", "below.z"), p))
    length = g.norm(n)
    return both.select(image, "v", "u", *[F.try_divide(c, length).alias(f"n{a}") for a, c in zip("xyz", n, strict=True)])


def trilinear(queries: DataFrame, volume: DataFrame) -> DataFrame:
    """(sample_id, query_id, value) at grid positions (ph, pw, pd): eight corners, an equi-join and a weighted sum."""
    ends = F.explode(F.array(*[F.array(*[F.lit((k >> b) & 1) for b in (2, 1, 0)]) for k in range(8)]))
    out = queries.withColumn("end", ends)
    weight = None
    for k, axis in enumerate("hwd"):
        low = F.floor(f"p{axis}")
        share = F.col(f"p{axis}") - low
        part = F.when(F.col("end")[k] == 1, share).otherwise(1 - share)
        weight = part if weight is None else weight * part
        out = out.withColumn(axis, (low + F.col("end")[k]).cast("int"))
    out = out.withColumn("weight", weight).join(volume, ["sample_id", "h", "w", "d"])
    return out.groupBy("sample_id", "query_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def car_size() -> list[Column]:
    """The size of a typical car."""
    return [F.lit(1.7).alias("height"), F.lit(2.0).alias("width"), F.lit(4.5).alias("length")]


def box_corners(boxes: DataFrame) -> DataFrame:
    """The eight corners of each box, turned by its yaw."""
    k = F.col("corner")
    sign = lambda bit: (F.pmod(F.floor(k / bit), F.lit(2)) * 2 - 1) / 2
    spread = boxes.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    p = (sign(4) * F.col("sx"), sign(2) * F.col("sy"), sign(1) * F.col("sz"))
    q = g.add(g.rotate_y(p, -F.col("yaw")), g.vec("tx", "ty", "tz"))
    return spread.select(*spread.columns, *[c.alias(n) for n, c in zip("xyz", q, strict=True)])


def grid_extent(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    return points.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def neighbour_normals(points: DataFrame, radius: float, key: str = "cloud_id", least: int = 3) -> DataFrame:
    """(query_id, nx, ny, nz): the direction of least spread of each point's neighbours, towards the origin.

    Neighbours come from the radius search; only the six numbers of their covariance reach Python.
    """
    queries = points.select(F.col("point_id").alias("query_id"), key, "x", "y", "z")
    pairs = radius_search(queries, points, radius, key).join(points.select("point_id", "x", "y", "z"), "point_id")
    spread = covariances(pairs, "query_id", least).join(queries, "query_id")
    return spread.select("query_id", least_spread().alias("m")).select("query_id", "m.*")


def average_planes(points: DataFrame, key: str = "cloud_id", least: int = 3) -> DataFrame:
    """(key, nx, ny, nz, d): the plane n x + d = 0 through each cloud's centroid along its direction of least spread.

    One aggregation; clouds of fewer than `least` points have no row. The normal points towards the origin.
    """
    spread = covariances(points, key, least, *[F.avg(c).alias(c) for c in "xyz"])
    planes = spread.select(key, "x", "y", "z", least_spread().alias("m")).select(key, "x", "y", "z", "m.*")
    return planes.select(key, "nx", "ny", "nz", (-g.dot(g.vec("nx", "ny", "nz"), g.vec("x", "y", "z"))).alias("d"))


COVARIANCE = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]


def covariances(points: DataFrame, key: str, least: int, *more: Column) -> DataFrame:
    """The six covariances of each group that has `least` points, beside further aggregates."""
    return points.groupBy(key).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in COVARIANCE], *more).where(F.col("n") >= least)


def least_spread() -> Column:
    """Struct nx, ny, nz: the direction of least spread by c_xx to c_zz, towards the origin from x, y, z."""

    def normal(rows: pd.DataFrame) -> pd.DataFrame:
        xx, xy, xz, yy, yz, zz, x, y, z = rows.to_numpy(float).T
        m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
        n = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
        n = n * np.where((n * np.stack([x, y, z], 1)).sum(1) > 0, -1.0, 1.0)[:, None]
        return pd.DataFrame(n, columns=["nx", "ny", "nz"])

    return F.pandas_udf(normal, "nx double, ny double, nz double")(F.struct(*[f"c_{a}{b}" for a, b in COVARIANCE], "x", "y", "z"))
