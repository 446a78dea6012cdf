"""Products of many rows with many: blocks, and kernels on them against the plain expressions."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from voxloom.functions import geometry as g
from voxloom.operators import fitting, spatial, tracking
from voxloom.plans import catalog
from voxloom.plans import fixtures as x
from voxloom.plans.scratch import writer


def lits(*v):
    return tuple(F.lit(float(a)) for a in v)


def test_one_key_is_many_tasks(spark):
    a = spark.range(200).select(F.col("id").alias("a"), F.lit(1).alias("k"))
    b = spark.range(150).select(F.col("id").alias("b"), F.lit(1).alias("k"))
    got = spatial.dealt(a, b, ["k"], rows=16).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in got.groupBy("task").count().collect()]
    assert sum(tasks) == 30_000 and max(tasks) < 3_000
    assert got.select("a", "b").distinct().count() == 30_000


def test_points_of_one_cell_are_many_tasks(spark, monkeypatch):
    """A cell that holds all points and boxes was one task."""
    monkeypatch.setattr(spatial.dealt, "__defaults__", (32,))
    points = spark.range(400).select(F.col("id").alias("point_id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), (F.col("id") / 100).alias("z"))
    size = {f"s{a}": F.lit(2.0) for a in "xyz"} | {f"t{a}": F.lit(1.0) for a in "xyz"} | {"yaw": F.lit(0.0)}
    boxes = spark.range(100).select(F.col("id").alias("box_id"), *[c.alias(n) for n, c in size.items()])
    got = spatial.points_in_boxes(points, boxes).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in got.groupBy("task").count().collect()]
    assert sum(tasks) == 100 * 201 and max(tasks) < sum(tasks) / 3


def test_box_canonical_shuffles_no_pairs(spark):
    """The pairs were joined to the boxes a second time, and so shuffled."""
    plan = catalog.queries()["P11_box_canonical"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "box_id" in line]


def test_rays_in_boxes_against_the_expression(spark):
    """With axes that stand still, unknown axes and NaN."""
    r = np.random.default_rng(5)
    rays = [(k, *map(float, p)) for k, p in enumerate(r.normal(0, 10, (60, 3)))] + [(60, 0.0, 5.0, 5.0), (61, 0.0, 0.0, 9.0), (62, 0.0, 0.0, 0.0), (63, None, 4.0, 4.0), (64, float("nan"), 4.0, 4.0), (65, None, None, None), (66, -0.0, -3.0, 2.0)]
    boxes = [(k, *map(float, p)) for k, p in enumerate(np.concatenate([r.uniform(1, 9, (40, 3)), r.normal(0, 6, (40, 3))], 1))] + [(40, 2.0, 2.0, 2.0, None, 3.0, 3.0), (41, 2.0, 2.0, 2.0, float("nan"), 3.0, 3.0), (42, 2.0, 2.0, 2.0, 1.0, 1.0, 1.0)]
    rays = spark.createDataFrame(rays, "ray_id long, x double, y double, z double")
    boxes = spark.createDataFrame(boxes, "box_id long, sx double, sy double, sz double, tx double, ty double, tz double")
    low, high = ([F.col(f"t{a}") + sign * F.col(f"s{a}") / 2 for a in "xyz"] for sign in (-1, 1))
    want = rays.crossJoin(boxes).where(g.ray_hits_box(lits(0, 0, 0), g.vec("x", "y", "z"), low, high)).select("ray_id", "box_id")
    got = spatial.rays_in_boxes(rays, boxes).collect()
    assert len(got) > 100 and sorted(got) == sorted(want.collect())


def test_rays_on_triangles_against_the_expression(spark):
    rays, triangles = x.rays(spark, SF).where("ray_id < 100"), x.triangles(spark, SF).where("fid < 100")
    t = g.ray_triangle(lits(0, 0, 0), g.vec("x", "y", "z"), g.vec("ax", "ay", "az"), g.vec("kx", "ky", "kz"), g.vec("cx", "cy", "cz"))
    want = {(r.ray_id, r.fid): r.t for r in rays.crossJoin(triangles).withColumn("t", t).where("t IS NOT NULL").collect()}
    got = {(r.ray_id, r.fid): r.hit for r in spatial.rays_on_triangles(rays, triangles).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_quick_rounding(spark):
    values = [0.0, -0.0, 1e-7, -1e-7, 0.0000005, -2.5e-7, 123.4567894, -54.0000015, 1e7 + 0.1234567, -3e12, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", x.r6(F.col("v")).alias("a"), x.quick6(F.col("v")).alias("b")).collect()
    assert all((r.a is None and r.b is None) or r.a == r.b for r in got) and str(got[1].b) == "0.0"


def test_nearest_among_crowds(spark):
    """The first radius follows from the density, points at one place are cut to the first ids; as brute force."""
    r = np.random.default_rng(9)
    pts = np.concatenate([r.normal(0, 0.01, (300, 3)), r.uniform(-20, 20, (60, 3)), np.zeros((50, 3))])
    df = spark.createDataFrame([(k, 0, *map(float, p)) for k, p in enumerate(pts)], "point_id long, cloud_id long, x double, y double, z double")
    assert spatial.fitting_radius(df.where("point_id < 360"), 8.0, ["cloud_id"], 5) < 0.1
    scratch = writer(spark)
    tables = []
    got = spatial.nearest(df.withColumnRenamed("point_id", "query_id"), df, 2, 8.0, lambda t, name: tables.append(name) or scratch(t, name), apart=3, within=12.0).collect()
    want = set()
    for q, p in enumerate(pts):
        d = ((pts - p) ** 2).sum(1)
        d[max(0, q - 3) : q + 4] = np.inf
        want |= {(q, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(len(d)), d))[:2]) if d[j] <= 144}
    assert {(row.query_id, row.point_id, row["rank"]) for row in got} == want and "best8" in tables


def test_triangle_kernels_against_the_expressions(spark, monkeypatch):
    """Distances, parities and first hits by blocks; with a degenerate triangle and unknown numbers."""
    triangles = x.triangles(spark, SF).where("fid < 120 AND mesh_id < 2")
    odd = spark.createDataFrame([(0, 900, *[5.0] * 9), (1, 901, *[3.0] * 6, None, 1.0, 1.0)], triangles.schema)
    triangles = triangles.unionByName(odd)
    queries = x.points(spark, SF).where("point_id < 150 AND cloud_id < 2").selectExpr("point_id AS query_id", "cloud_id AS mesh_id", "x", "y", "z")
    queries = queries.unionByName(spark.createDataFrame([(997, 0, None, 1.0, 2.0), (998, 1, 3.0, 3.0, 3.0)], queries.schema))
    p, corners = g.vec("x", "y", "z"), (g.vec("ax", "ay", "az"), g.vec("kx", "ky", "kz"), g.vec("cx", "cy", "cz"))
    hit, seen = g.ray_triangle(p, tuple(-v for v in p), *corners), g.ray_triangle(lits(0, 0, 0), p, *corners)
    pairs = queries.join(triangles, "mesh_id")
    want = {r.query_id: r for r in pairs.groupBy("query_id").agg(F.min(g.point_triangle_distance(p, *corners)).alias("near"), F.count_if(F.coalesce(hit >= 0, F.lit(False))).alias("hits"), F.min(F.when(seen > 0, seen)).alias("depth")).collect()}
    monkeypatch.setattr(spatial.paired, "__defaults__", (16,))
    plan = spatial.signed_distance(queries, triangles)
    assert "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {r.query_id: r for r in plan.collect()}
    assert got.keys() == want.keys() and got[997].distance is None and got[998].distance == pytest.approx(0)
    for k, r in got.items():
        assert r.hits == want[k].hits and (want[k].near is None or abs(r.distance) == pytest.approx(want[k].near, rel=1e-9, abs=1e-9))
    depths = {r.ray_id: r.depth for r in spatial.depth_image(queries.withColumnRenamed("query_id", "ray_id"), triangles).collect()}
    assert depths == pytest.approx({k: r.depth for k, r in want.items() if r.depth is not None})


def test_hits_through_the_origin_against_each_pair(monkeypatch):
    """Signs in single precision decide nearly all pairs, the plain test the rest: sides, corners, flat triangles, NaN and huge numbers."""
    r = np.random.default_rng(3)
    plain, tested = spatial.ray_hits, []
    for whole in (False, True):
        points, corners = r.normal(0, 5, (300, 3)), [r.normal(0, 5, (700, 3)) for _ in range(3)]
        if whole:  # many on sides
            points, corners = np.round(points), [np.round(c) for c in corners]
        points[0], points[1, 0], points[2], points[3], points[4] = np.nan, np.inf, 0, corners[0][5], 1e16
        points[5:40] = (corners[0][5:40] + corners[1][5:40]) / 2
        corners[1][3], corners[2][4], corners[1][6] = corners[0][3], np.nan, np.inf
        columns = tuple(tuple(c.T) for c in corners)
        with np.errstate(all="ignore"):
            p = tuple(points[:, k][:, None] for k in range(3))
            want = (plain(p, tuple(-v for v in p), columns) >= 0).sum(1)
        monkeypatch.setattr(spatial, "ray_hits", lambda p, *more: tested.append(p[0].size) or plain(p, *more))
        got = spatial.hits_through_origin(dict(zip("xyz", points.T, strict=True)), columns, (64, 64))
        assert got.tolist() == want.tolist() and want.sum() > 10_000
        assert whole or sum(tested) < want.size * 700 / 50
        monkeypatch.setattr(spatial, "ray_hits", plain)


def test_inside_parity_makes_no_distances(spark, monkeypatch):
    """A8 computed the distance of each pair, and threw it away."""
    monkeypatch.setattr(spatial, "triangle_distances", None)
    queries, triangles = x.points(spark, SF).selectExpr("point_id AS query_id", "cloud_id AS mesh_id", "x", "y", "z"), x.triangles(spark, SF)
    got = {r.query_id: r.hits for r in spatial.hits_to_origin(queries, triangles, rows=16).collect()}
    p = g.vec("x", "y", "z")
    hit = g.ray_triangle(p, tuple(-v for v in p), g.vec("ax", "ay", "az"), g.vec("kx", "ky", "kz"), g.vec("cx", "cy", "cz"))
    want = queries.join(triangles, "mesh_id").groupBy("query_id").agg(F.count_if(F.coalesce(hit >= 0, F.lit(False))).alias("hits")).collect()
    assert got == {r.query_id: r.hits for r in want}
    plan = catalog.queries()["A8_inside_parity"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "near" not in plan


def test_greedy_overlaps_against_the_assignment_of_all_pairs(spark, monkeypatch):
    """Without a group of all pairs of a frame; with equal rectangles, so that costs are tied."""
    detections = x.detections(spark, SF).where("frame < 3")
    twins = detections.where("det_id % 2 = 0").withColumn("det_id", F.col("det_id") + 100_000)
    detections = detections.unionByName(twins)
    costs = tracking.overlaps(detections).select("frame", F.col("det_a").alias("row_id"), F.col("det_b").alias("col_id"), (1 - F.col("iou")).alias("cost"))
    want = tracking.greedy_assignment(costs).collect()
    monkeypatch.setattr(spatial.paired, "__defaults__", (8,))
    got = tracking.greedy_overlaps(detections, writer(spark)).select("frame", "row_id", "col_id", "cost").collect()
    assert len(got) > 20 and sorted(got) == sorted(want)


def test_surface_of_a_sample_with_gaps_and_all_kinds_of_tetrahedra(spark):
    """Whole samples at once: the triangles of a tetrahedron at a time, which took most of the query."""
    r = np.random.default_rng(4)
    values = r.normal(0, 1, (3, 3, 3))
    values[0, 0, 0] = 0.0
    rows = [(7, h, w, d, float(values[h, w, d])) for h, w, d in np.ndindex(3, 3, 3) if (h, w, d) != (2, 2, 2)]
    table = spark.createDataFrame(rows, "sample_id long, h int, w int, d int, value double")
    plan = fitting.surface(table, (3, 3, 3))
    assert "FlatMapGroupsInArrow" in plan._jdf.queryExecution().optimizedPlan().toString()
    values[2, 2, 2] = np.nan
    want = []
    for h, w, d in np.ndindex(2, 2, 2):
        for a, b in [(1, 3), (1, 5), (2, 3), (2, 6), (4, 5), (4, 6)]:
            tet = [np.array([h + (k >> 2 & 1), w + (k >> 1 & 1), d + (k & 1)]) for k in (0, a, b, 7)]
            v = [values[tuple(t)] for t in tet]
            ins, outs = [k for k in range(4) if v[k] < 0], [k for k in range(4) if not v[k] < 0]
            if np.isnan(v).any() or not ins or not outs:
                continue
            cut = lambda i, j: tet[i] + (tet[j] - tet[i]) * v[i] / (v[i] - v[j])  # noqa: B023, E731
            if len(ins) == 2:
                q = [cut(ins[0], outs[0]), cut(ins[0], outs[1]), cut(ins[1], outs[1]), cut(ins[1], outs[0])]
                want += [(q[0], q[1], q[2]), (q[0], q[2], q[3])]
            else:
                lone, rest = (ins[0], outs) if len(ins) == 1 else (outs[0], ins)
                want.append(tuple(cut(lone, k) for k in rest))
    want = sorted(tuple(np.round(np.array(t)[:, [1, 0, 2]].ravel(), 9) + 0.0) for t in want)
    got = sorted(tuple(np.round(np.array(row[1:]), 9) + 0.0) for row in plan.collect())
    assert len(want) > 30 and np.allclose(got, want)


def test_boxes_count_points_without_pairs(spark):
    """Counts of boxes over many cells and a deep tree, points on their sides and numbers that aren't finite among them, as SQL counts them."""
    r = np.random.default_rng(5)
    p = np.round(r.normal(0, 4, (6_000, 3)), 1)  # places on sides, and equal ones
    p[:3, 0], p[3, 1] = np.nan, np.inf
    b = np.column_stack([np.round(r.uniform(1, 12, (400, 3)), 1), np.round(r.normal(0, 4, (400, 3)), 1), r.choice([0, np.pi / 2, 0.3, -2.5], 400)])
    b[0, 0], b[1, 6], b[2, 4], b[3, :3] = np.nan, np.nan, np.inf, 1e6
    points = pd.DataFrame(p, columns=["x", "y", "z"])
    boxes = pd.DataFrame(b, columns=["sx", "sy", "sz", "tx", "ty", "tz", "yaw"]).assign(box_id=range(400))
    made = [spark.createDataFrame(t.values.tolist(), ", ".join(f"{c} double" for c in t)) for t in (points, boxes)]
    got = spatial.boxes_with_points(made[0], made[1].withColumn("box_id", F.col("box_id").cast("long")), 20, rows=500)
    made[0].createOrReplaceTempView("some_points"), made[1].createOrReplaceTempView("some_boxes")
    inside = "abs(cos(yaw)*(x-tx)+sin(yaw)*(z-tz)) <= sx/2 AND abs(y-ty) <= sy/2 AND abs(cos(yaw)*(z-tz)-sin(yaw)*(x-tx)) <= sz/2"
    want = spark.sql(f"SELECT CAST(box_id AS BIGINT) AS box_id, count(*) AS n FROM some_points, some_boxes WHERE {inside} GROUP BY 1 HAVING count(*) >= 20")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {0, 3} <= {row.box_id for row in got.collect()}
