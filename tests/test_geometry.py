"""Hand-checkable cases and properties of the geometric operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import geometry as g
from voxloom.functions import tensors
from voxloom.operators import fitting, mesh, sampling, spatial, tracking, volume
from voxloom.plans.scratch import writer
from voxloom.sources import binary, text, writers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


@pytest.mark.parametrize("value, low, high, want", [(-270, -180, 180, 90), (181, -180, 180, -179), (-180, 0, 360, 180), (36, 0, 24, 12), (368.5, -180, 180, 8.5)])
def test_wrap(spark, value, low, high, want):
    assert one(spark, a=g.wrap_angle(F.lit(float(value)), low, high)).a == pytest.approx(want)


@pytest.mark.parametrize("value, want", [(-100, -80), (100, 80), (181, -1), (270, -90)])
def test_bounce(spark, value, want):
    assert one(spark, a=g.bounce_angle(F.lit(float(value)), -90, 90)).a == pytest.approx(want)


def test_rotation_keeps_norm_and_inverts(spark):
    p, a = lits(1, 2, 3), lits(0.3, -1.1, 2.0)
    q = g.rotate(p, a)
    back = g.rotate_back(q, a)
    r = one(spark, n=g.norm(q), x=back[0], y=back[1], z=back[2])
    assert r.n == pytest.approx(math.sqrt(14)) and (r.x, r.y, r.z) == pytest.approx((1, 2, 3))


def test_slab_with_still_axes(spark):
    for axis in range(3):
        d = [0.0, 0.0, 0.0]
        d[axis] = 5.0
        low, high = [-0.5] * 3, [0.5] * 3
        low[axis], high[axis] = 2.0, 3.0
        r = one(spark, hit=g.ray_hits_box(lits(0, 0, 0), lits(*d), lits(*low), lits(*high)), miss=g.ray_hits_box(lits(0, 0, 9), lits(*d), lits(*low), lits(*high)) if axis < 2 else F.lit(False))
        assert r.hit and not r.miss


def test_triangle_box_against_sampling(spark):
    r = np.random.default_rng(0)
    tris = r.uniform(-2, 2, (200, 9))
    df = spark.createDataFrame([(k, *map(float, t)) for k, t in enumerate(tris)], "k long, " + ", ".join(f"{p}{c} double" for p in "akc" for c in "xyz"))
    got = {row.k for row in df.where(g.triangle_overlaps_box(lits(0, 0, 0), lits(0.7, 0.5, 0.6), *(g.vec(*(f"{p}{c}" for c in "xyz")) for p in "akc"))).collect()}
    u = r.random((4000, 2))
    u = np.where(u.sum(1, keepdims=True) > 1, 1 - u, u)
    for k, t in enumerate(tris.reshape(-1, 3, 3)):
        points = t[0] + u[:, :1] * (t[1] - t[0]) + u[:, 1:] * (t[2] - t[0])
        if (np.abs(points) <= np.array([0.7, 0.5, 0.6])).all(1).any():
            assert k in got
        elif (np.abs(points) > np.array([0.9, 0.7, 0.8])).any(1).all():
            assert k not in got


def test_face_points_belong_to_both_voxels(spark):
    p = spark.createDataFrame([(0, 1.0, 0.5, 0.5)], "cloud_id long, x double, y double, z double")
    assert sorted(tuple(r)[1:] for r in spatial.occupancy(p, (24, 54, 24)).collect()) == [(0, 0, 0), (0, 1, 0)]
    edge = spark.createDataFrame([(0, 54.0, 0.5, 0.5)], "cloud_id long, x double, y double, z double")
    assert [tuple(r)[1:] for r in spatial.occupancy(edge, (24, 54, 24)).collect()] == [(0, 53, 0)]


def test_carving_against_all_voxels(spark):
    r = np.random.default_rng(1)
    ends = [(k, *map(float, r.uniform(-3, 8, 3))) for k in range(30)] + [(30, 5.0, 0.0, 0.0), (31, 0.0, 5.5, 0.0)]
    rays = spark.createDataFrame(ends, "cloud_id long, x double, y double, z double")
    got = {tuple(v) for v in spatial.carved(rays, (6, 6, 6)).collect()}
    for k, x, y, z in ends[:30]:
        for h in range(6):
            for w in range(6):
                for d in range(6):
                    a, b = np.array([w / x, h / y, d / z]), np.array([(w + 1) / x, (h + 1) / y, (d + 1) / z])
                    near, far = np.minimum(a, b).max(), np.maximum(a, b).min()
                    assert ((k, h, w, d) in got) == (near <= far and near < 1 and far > 0), (k, h, w, d)


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(2)
    pts = r.uniform(0, 30, (120, 3))
    df = spark.createDataFrame([(k, 0, *map(float, p)) for k, p in enumerate(pts)], "point_id long, cloud_id long, x double, y double, z double")
    got = spatial.nearest(df.withColumnRenamed("point_id", "query_id"), df, 4, 1.0, writer(spark)).collect()
    assert len(got) == 480
    for row in got:
        d = ((pts - pts[row.query_id]) ** 2).sum(1)
        assert row.point_id == np.lexsort((np.arange(120), d))[row.rank - 1]


def test_cube_distance_and_area(spark):
    v = [(0, k, float(k & 1), float(k >> 1 & 1), float(k >> 2)) for k in range(8)]
    cell = spark.createDataFrame([(0, 0, 0, 0)], "sample_id long, h int, w int, d int")
    vertices, faces = volume.cubes(cell)
    v = vertices.select(F.col("sample_id").alias("mesh_id"), F.col("corner").cast("long").alias("vid"), "x", "y", "z")
    f = faces.select(F.col("sample_id").alias("mesh_id"), F.monotonically_increasing_id().alias("fid"), *[F.col(f"v{k}").cast("long").alias(f"v{k}") for k in range(3)])
    triangles = mesh.with_corners(f, v)
    assert triangles.count() == 12 and mesh.areas(triangles).agg(F.sum("area")).first()[0] == pytest.approx(6)
    # outward normals: each points away from the centre
    n = g.cross(g.sub(mesh.B, mesh.A), g.sub(mesh.C, mesh.A))
    assert {round(r[0]) for r in triangles.select(F.signum(g.dot(n, g.sub(mesh.A, lits(0.5, 0.5, 0.5))))).collect()} in ({1}, {-1})
    q = spark.createDataFrame([(0, 0, 0.5, 2.0, 0.5), (1, 0, 0.3, 0.4, 0.5)], "query_id long, mesh_id long, x double, y double, z double")
    got = {r.query_id: r.distance for r in spatial.signed_distance(q, triangles).collect()}
    assert got[0] == pytest.approx(1) and abs(got[1]) == pytest.approx(0.3)


def test_runs_round_trip_and_split_at_255(spark):
    cells = spark.range(300).select(F.lit(0).cast("long").alias("sample_id"), F.lit(0).alias("h"), F.lit(0).alias("w"), F.col("id").cast("int").alias("d"), F.when(F.col("id") < 256, 1.0).otherwise(0.0).alias("value"))
    runs = [(r.value, r.n) for r in volume.run_lengths(cells, 1, 300).orderBy("run").collect()]
    assert runs == [(1.0, 255), (1.0, 1), (0.0, 44)]
    r = np.random.default_rng(3)
    grid = r.random((5, 6, 7)) > 0.4
    grid[:] |= False
    files = spark.createDataFrame([("a", binary.binvox_bytes(grid)), ("b", binary.binvox_bytes(np.ones((8, 8, 8), bool)))], "file_id string, content binary")
    got = binary.parse_binvox(files).collect()
    assert {(r.i, r.j, r.k) for r in got if r.file_id == "a"} == set(map(tuple, np.argwhere(grid))) and sum(r.file_id == "b" for r in got) == 512


def test_pack_unpack(spark):
    v = spark.range(27).select(F.lit(1).cast("long").alias("sample_id"), F.floor(F.col("id") / 9).cast("int").alias("h"), F.floor(F.col("id") / 3 % 3).cast("int").alias("w"), (F.col("id") % 3).cast("int").alias("d"), F.col("id").cast("double").alias("value"))
    assert sorted(map(tuple, volume.unpack(volume.pack(v, (3, 3, 3)), 3, 3).collect())) == sorted(map(tuple, v.collect()))


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF4 2 0\n0 0 0\n1 0 0\n0 1 0\n1 1 0\n3 0 1 2\n3 1 3 2\n")
    v, f = text.parse_off(text.read_whole(spark, str(tmp_path), ".off"))
    assert v.count() == 4 and sorted((r.v0, r.v1, r.v2) for r in f.collect()) == [(0, 1, 2), (1, 3, 2)]
    (tmp_path / "b.obj").write_text("# x\nv 0 0 0\nv 1 0 0\nv 0 1 0\nvn 0 0 1\nf 1/1/1 2/2/1 3/3/1\nf 1 1 2\n")
    v, f = text.parse_obj(text.read_whole(spark, str(tmp_path), ".obj"))
    assert v.count() == 3 and [(r.v0, r.v1, r.v2) for r in f.collect()] == [(0, 1, 2)]
    bad = spark.createDataFrame([("x", "3\n1 2 3\n")], "file_id string, text string")
    with pytest.raises(Exception, match="points"):
        text.parse_points(bad).collect()
    assert text.parse_points(bad, strict=False).count() == 1
    m = np.arange(6.0).reshape(2, 3)
    got = binary.parse_matrix(spark.createDataFrame([("m", binary.matrix_bytes(m))], "file_id string, content binary")).collect()
    assert {(r.row, r.col): r.value for r in got} == {(i, j): m[i, j] for i in range(2) for j in range(3)}
    (tmp_path / "t.xml").write_text("<tracklets><item><objectType>Car</objectType><h>1.5</h><w>1.6</w><l>4</l><first_frame>7</first_frame><poses><count>2</count><item><tx>1</tx><ty>2</ty><tz>3</tz><rx>0</rx><ry>0</ry><rz>0.5</rz><state>2</state><occlusion>0</occlusion><truncation>0</truncation></item><item><tx>4</tx><ty>2</ty><tz>3</tz><rx>0</rx><ry>0</ry><rz>0.5</rz><state>2</state><occlusion>0</occlusion><truncation>-1</truncation></item></poses></item></tracklets>")
    poses = text.read_tracklets(spark, str(tmp_path / "t.xml")).orderBy("frame").collect()
    assert [(p.frame, p.tx) for p in poses] == [(7, 1.0), (8, 4.0)]
    names = [r.name for r in text.scan_directory(spark, str(tmp_path)).orderBy("key").collect()]
    assert names == ["a.off", "b.obj", "t.xml"]
    files = spark.createDataFrame([("a", "one\ntwo\n")], "file_id string, text string")
    writers.write_files(files, str(tmp_path / "out"), ".txt")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_binary_ply(spark):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 0\nend_header\n"
    body = b"".join(np.float32(v).tobytes() for v in (1, 2, 3)) + b"\x07" + b"".join(np.float32(v).tobytes() for v in (4, 5, 6)) + b"\x08"
    got = binary.parse_ply_binary(spark.createDataFrame([("p", head + body)], "file_id string, content binary")).collect()
    assert [(r.x, r.y, r.z) for r in got] == [(1, 2, 3), (4, 5, 6)]


def test_alignment_recovers_a_motion():
    r = np.random.default_rng(4)
    p = r.uniform(-10, 10, (60, 3))
    a = 0.05
    m = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    f = fitting.align(p, p @ m.T + [0.2, -0.1, 0.3])
    assert np.allclose(f["r"], m, atol=1e-6) and np.allclose(f["t"], [0.2, -0.1, 0.3], atol=1e-6) and f["inliers"] == 60
    assert fitting.align(p[:4], p)["steps"] == 0


def test_shape_fit_recovers_a_radius():
    h, w, d = np.meshgrid(*[np.arange(12.0)] * 3, indexing="ij")
    mean = (np.sqrt((h - 5.5) ** 2 + (w - 5.5) ** 2 + (d - 5.5) ** 2) - 3).ravel()
    r = np.random.default_rng(5)
    n = r.normal(size=(400, 3))
    p = 5.5 + 3.6 * n / np.linalg.norm(n, axis=1, keepdims=True)
    f = fitting.fit_shape(p, mean, np.ones((len(mean), 1)), (12, 12, 12), np.array([2.0]), pose=False)
    assert f["z"][0] == pytest.approx(-0.6, abs=0.05)


def test_surface_of_a_sphere(spark):
    h, w, d = np.meshgrid(*[np.arange(9)] * 3, indexing="ij")
    value = np.sqrt((h - 4.0) ** 2 + (w - 4.0) ** 2 + (d - 4.0) ** 2) - 2.5
    rows = [(0, int(a), int(b), int(c), float(v)) for a, b, c, v in zip(h.ravel(), w.ravel(), d.ravel(), value.ravel(), strict=True)]
    t = fitting.surface(spark.createDataFrame(rows, "sample_id long, h int, w int, d int, value double"), (9, 9, 9)).withColumnRenamed("sample_id", "mesh_id").withColumn("fid", F.monotonically_increasing_id())
    assert mesh.areas(t).agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi * 2.5**2, rel=0.06)
    faces = mesh.indexed(t)[1]
    assert mesh.edges(faces).groupBy("u", "v").count().where("count <> 2").count() == 0  # closed


def test_normals_of_a_plane(spark):
    rows = [(k, 0, float(k % 8), 5.0, float(k // 8)) for k in range(64)]
    p = spark.createDataFrame(rows, "point_id long, cloud_id long, x double, y double, z double")
    assert all(abs(r.ny + 1) < 1e-9 for r in spatial.neighbour_normals(p, 2.0).collect())


def test_greedy_assignment_against_a_loop(spark):
    r = np.random.default_rng(6)
    costs = r.random((7, 5)).round(1)
    df = spark.createDataFrame([(1, i, j, float(costs[i, j])) for i in range(7) for j in range(5)], "frame long, row_id long, col_id long, cost double")
    got = {(v.row_id, v.col_id) for v in tracking.greedy_assignment(df).collect()}
    want, c = set(), costs.copy()
    for _ in range(5):
        i, j = np.unravel_index(c.argmin(), c.shape)
        want.add((int(i), int(j)))
        c[i, :] = c[:, j] = np.inf
    assert got == want


def test_merged_vertices_against_a_loop(spark):
    r = np.random.default_rng(7)
    p = r.uniform(0, 5, (80, 3))
    df = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(p)], "mesh_id long, vid long, x double, y double, z double")
    got = {v.vid: v.target for v in mesh.merged_vertices(df, 0.8).collect()}
    heads: list[int] = []
    for k in range(80):
        hit = next((h for h in heads if ((p[h] - p[k]) ** 2).sum() <= 0.64), None)
        assert got[k] == (k if hit is None else hit)
        if hit is None:
            heads.append(k)


def test_empty_inputs(spark):
    p = spark.createDataFrame([], "point_id long, cloud_id long, x double, y double, z double")
    assert spatial.occupancy(p, (4, 4, 4)).count() == 0 and spatial.distance_field(p, (2, 2, 2)).count() == 0
    assert spatial.nearest(p.withColumnRenamed("point_id", "query_id"), p, 2, 1.0, writer(spark)).count() == 0


def test_perturbations_repeat(spark):
    p = spark.range(20).select(F.col("id").alias("point_id"), *[F.lit(1.0).alias(c) for c in "xyz"])
    a, b = (sampling.perturbed(p, "point_id", 4).orderBy("point_id", "copy").collect() for _ in range(2))
    assert a == b and len(a) == 80


def test_many_beside_many(spark):
    a, b = spark.range(50).withColumnRenamed("id", "a"), spark.range(70).withColumnRenamed("id", "b")
    assert spatial.beside_few(a, b, "b", most=16).distinct().count() == 3500


def test_shapes_and_bounds():
    assert tensors.layer_sizes(24, [3, 3], [2, 2], padded=True) == [11, 4]
    assert tensors.init_bound("xavier", 10, 20) == pytest.approx(math.sqrt(0.2))


def test_nearest_far_apart(spark):
    from voxloom.operators import spatial
    from voxloom.plans.scratch import writer

    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 5e6, 0.0, 0.0), (1, 3, 0.0, 1.0, 0.0)]
    points = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")
    queries = points.withColumnRenamed("point_id", "query_id")
    got = {(r.query_id, r.point_id, r["rank"]) for r in spatial.nearest(queries, points, 2, 1.0, writer(spark)).collect()}
    assert got == {(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2), (3, 3, 1)}
    got = {(r.query_id, r.point_id) for r in spatial.nearest(queries, points, 2, 1.0, writer(spark), apart=0).collect()}
    assert got == {(1, 2), (2, 1)}  # fewer than k are left
    assert spatial.nearest(queries, points.where("x > 1e9"), 1, 1.0, writer(spark), key=None).count() == 0


def test_hull_descent(spark):
    from voxloom.operators import mesh
    from voxloom.plans.scratch import writer

    r = np.random.default_rng(3)
    p, faces = r.normal(0, 1, (2, 9, 3)), [(3 * i + j, 3 * i + j + 1, 3 * i + j + 3) for i in range(2) for j in range(2)]
    v = spark.createDataFrame([(m, k, *map(float, p[m, k])) for m in range(2) for k in range(9)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(m, k, *t) for m in range(2) for k, t in enumerate(faces)], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    targets = v.selectExpr("mesh_id", "vid", "x AS tx", "y AS ty", "0.0D AS tz")
    sides = {tuple(sorted(s)) for t in faces for s in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
    goal, now = p * [1, 1, 0], p.copy()
    for _ in range(4):
        grad = 2 * 0.5 * (now - goal)
        for a, b in sides:
            d = now[:, a] - now[:, b]
            pull = 4 * ((d**2).sum(1, keepdims=True) - 1.44) * d
            grad[:, a] += pull
            grad[:, b] -= pull
        now = now - 0.01 * grad
    got = mesh.hull_descent(f, v, targets, 0.5, 1.2, 0.01, 4, writer(spark)).collect()
    assert len(got) == 18
    for row in got:
        assert np.allclose([row.x, row.y, row.z], now[row.mesh_id, row.vid])
    energy = lambda table: sum(row.energy for row in mesh.hull_energy(f, table, targets, 0.5, 1.2).collect())
    assert energy(mesh.hull_descent(f, v, targets, 0.5, 1.2, 1e-4, 4, writer(spark))) < energy(v)


def test_average_planes_against_a_plain_version(spark):
    r = np.random.default_rng(8)
    clouds = r.normal(0, 1, (3, 40, 3)) * [5, 0.5, 3] + [0, 7, 1]
    rows = [(k, *map(float, p)) for k, c in enumerate(clouds) for p in c] + [(9, 1.0, 2.0, 3.0)]
    got = {row.cloud_id: row for row in spatial.average_planes(spark.createDataFrame(rows, "cloud_id long, x double, y double, z double")).collect()}
    assert sorted(got) == [0, 1, 2]  # one point is no plane
    for k, c in enumerate(clouds):
        n, mean = np.linalg.svd(c - c.mean(0))[2][2], c.mean(0)
        n = -n if n @ mean > 0 else n
        assert np.allclose([got[k].nx, got[k].ny, got[k].nz, got[k].d], [*n, -n @ mean])


def test_transformed_plane_holds_transformed_points(spark):
    m = ((1, 0.1, 0, 2), (0, 1, 0.2, -1), (0.3, 0, 1, 0.5), (0, 0, 0, 1))
    row = spark.range(1).select(*[c.alias(k) for k, c in zip("abcd", g.transform_plane(m, tuple(F.lit(v) for v in (0.6, -0.8, 0.2, 1.5))), strict=True)]).first()
    for x, z in ((0, 0), (3, -2), (-7, 4)):
        moved = np.array(m) @ [x, (0.6 * x + 0.2 * z + 1.5) / 0.8, z, 1]
        assert abs(np.dot(row[:3], moved[:3]) + row.d) < 1e-9
    flat = ((1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1))
    assert spark.range(1).select(g.transform_plane(flat, tuple(F.lit(v) for v in (0.6, -0.8, 0.2, 1.5)))[0].alias("a")).first().a is None


def test_plane_alignment_recovers_a_motion():
    r = np.random.default_rng(9)
    xz = r.uniform(-5, 5, (400, 2))
    p = np.stack([xz[:, 0], 0.1 * xz[:, 0] ** 2 - 0.05 * xz[:, 1] ** 2 + 0.3 * np.sin(xz.sum(1)), xz[:, 1]], 1)
    a = 0.02
    m = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    f = fitting.align(p, p @ m.T + [0.03, -0.02, 0.02], plane=True)
    assert np.allclose(f["r"], m, atol=0.01) and np.allclose(f["t"], [0.03, -0.02, 0.02], atol=0.02)


def test_accumulated_moves_the_template_only(spark):
    rows = [(1, "template", 1.0, 0.0, 0.0), (1, "model", 9.0, 8.0, 7.0), (2, "template", 5.0, 5.0, 5.0), (2, "model", 1.0, 1.0, 1.0)]
    clouds = spark.createDataFrame(rows, "pair_id long, side string, x double, y double, z double")
    turn = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    fits = spark.createDataFrame([(1, *sum(turn, []), 10.0, 20.0, 30.0)], "pair_id long, " + ", ".join(f"{n} double" for n in names))
    got = sorted(tuple(row) for row in fitting.accumulated(clouds, fits).collect())
    assert got == [(1, "model", 9.0, 8.0, 7.0), (1, "template", 10.0, 21.0, 30.0), (2, "model", 1.0, 1.0, 1.0)]  # a pair without a fit keeps its model
