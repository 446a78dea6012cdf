"""Catalogue of joins (J), set operations (U), windows (W) and frame operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.operators import metrics, spatial, tracking, volume
from voxloom.plans import fixtures as x
from voxloom.plans.fixtures import R, Catalog, r6, rounded
from voxloom.plans.scratch import writer

catalog = Catalog()
H, W, D = x.GRID
CELLS = f"SELECT DISTINCT cloud_id, CAST(floor(y) AS INT) AS h, CAST(floor(x) AS INT) AS w, CAST(floor(z) AS INT) AS d FROM {x.POINTS} WHERE x >= 0 AND x < {W} AND y >= 0 AND y < {H} AND z >= 0 AND z < {D}"


@catalog.op("J1_voxel_occupancy", f"SELECT cloud_id, count(*) AS voxels FROM ({CELLS}) GROUP BY cloud_id")
def voxel_occupancy(spark, sf):
    return spatial.occupancy(x.points(spark, sf), x.GRID).groupBy("cloud_id").agg(F.count("*").alias("voxels"))


catalog.add("J1_voxels", lambda s, d: spatial.occupancy(x.points(s, d), x.GRID), CELLS)


def slab_sql(t1: str = "1") -> str:
    near = "greatest(least(w/x,(w+1)/x), least(h/y,(h+1)/y), least(d/z,(d+1)/z))"
    far = "least(greatest(w/x,(w+1)/x), greatest(h/y,(h+1)/y), greatest(d/z,(d+1)/z))"
    grid = f"(SELECT CAST(k//({W}*{D}) AS INT) AS h, CAST((k//{D})%{W} AS INT) AS w, CAST(k%{D} AS INT) AS d FROM (SELECT unnest(range({H * W * D})) AS k))"
    return f"SELECT DISTINCT cloud_id, h, w, d FROM {x.RAYS} r, {grid} v WHERE {near} <= {far} AND {near} < {t1} AND {far} > 0"


catalog.add("J2_free_space", lambda s, d: spatial.carved(x.rays(s, d), x.GRID), slab_sql())
catalog.add("J3_candidate_pruning", lambda s, d: spatial.occupancy(x.points(s, d).where("x < 27"), x.GRID), CELLS + " AND x < 27")
catalog.add("A9_exclusive_space", lambda s, d: volume.exclusive(spatial.carved(x.rays(s, d), x.GRID), spatial.occupancy(x.points(s, d), x.GRID)), f"SELECT * FROM ({slab_sql()}) EXCEPT SELECT * FROM ({CELLS})")
INSIDE = "abs(cos(yaw)*(x-tx)+sin(yaw)*(z-tz)) <= sx/2 AND abs(y-ty) <= sy/2 AND abs(cos(yaw)*(z-tz)-sin(yaw)*(x-tx)) <= sz/2"
catalog.add("J4_crop_by_frame", lambda s, d: spatial.crop_to_boxes(x.points(s, d).withColumn("frame", F.col("point_id") % 5), x.boxes(s, d).withColumn("frame", F.col("box_id") % 5)).select("box_id", "point_id"), f"SELECT box_id, point_id FROM {x.POINTS} p JOIN {x.BOXES} b ON p.point_id % 5 = b.box_id % 5 WHERE {INSIDE}")


@catalog.op("J5_position_mapping", "WITH m AS (SELECT vec_id AS pos, label AS drive FROM embeddings), r AS (SELECT vec_id AS j, (vec_id*7+3) % (SELECT count(*) FROM embeddings) + 1 AS v FROM embeddings) SELECT j, CAST(drive AS BIGINT) AS drive FROM r JOIN m ON m.pos = r.v - 1")
def position_mapping(spark, sf):
    vectors = x.table(spark, sf, "embeddings")
    mapping = vectors.select(F.col("vec_id").alias("pos"), F.col("label").cast("long").alias("drive"))
    shuffled = vectors.select(F.col("vec_id").alias("j"), ((F.col("vec_id") * 7 + 3) % vectors.count()).alias("pos"))
    return shuffled.join(mapping, "pos").select("j", "drive")


catalog.add("J6_frame_neighbourhood", lambda s, d: spatial.frame_neighbours(x.frames(s, d), 10, 5), f'SELECT a.track, a.frame, o AS "offset", b.frame AS other FROM {x.FRAMES} a, (SELECT CAST(unnest([-10,-5,5,10]) AS BIGINT) AS o) k, {x.FRAMES} b WHERE b.track = a.track AND b.frame = a.frame + o')


@catalog.op("J7_nearest_size", f"WITH q AS (SELECT * FROM {x.BOXES}), p AS (SELECT q.box_id, r.box_id AS ref_id, sqrt((q.sx-r.sx)*(q.sx-r.sx)+(q.sy-r.sy)*(q.sy-r.sy)+(q.sz-r.sz)*(q.sz-r.sz)) AS distance FROM q, {x.SIZES} r) SELECT box_id, ref_id, round(distance,6)+0.0 AS distance FROM p QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY p.distance, ref_id) = 1")
def nearest_size(spark, sf):
    b = x.boxes(spark, sf)
    return spatial.nearest_size(b, x.sizes(spark, sf), writer(spark)).select("box_id", "ref_id", r6(F.col("distance")).alias("distance"))


@catalog.op("J8_same_size", f"SELECT q.box_id, max(r.box_id) AS ref_id FROM {x.BOXES} q, (SELECT * FROM {x.BOXES} UNION ALL SELECT box_id+(SELECT max(vec_id)+1 FROM embeddings), sx, sy, sz, tx, ty, tz, yaw FROM {x.BOXES} WHERE box_id % 2 = 0) r WHERE (q.sx-r.sx)*(q.sx-r.sx)+(q.sy-r.sy)*(q.sy-r.sy)+(q.sz-r.sz)*(q.sz-r.sz) <= 1e-10*least(q.sx*q.sx+q.sy*q.sy+q.sz*q.sz, r.sx*r.sx+r.sy*r.sy+r.sz*r.sz) GROUP BY q.box_id")
def same_size(spark, sf):
    b = x.boxes(spark, sf)
    return spatial.same_size(b, b.unionByName(b.where("box_id % 2 = 0").crossJoin(F.broadcast(b.agg((F.max("box_id") + 1).alias("more")))).withColumn("box_id", F.col("box_id") + F.col("more")).drop("more")))


@catalog.op("J9_used_match", "WITH e AS (SELECT label AS g, vec_id AS position, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j FROM embeddings WHERE vec_id % 3 <> 0) SELECT CAST(g AS BIGINT) AS \"group\", j, position FROM e WHERE j < 5")
def used_match(spark, sf):
    v = x.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("group"), F.col("vec_id").alias("position"), (F.col("vec_id") % 3 != 0).alias("used"))
    wanted = v.select("group").distinct().select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("j"))
    return spatial.used_match(v, wanted)


D2 = "(q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z)"


@catalog.op("J10_nearest_points", f"SELECT q.point_id AS query_id, p.point_id, round({D2},6)+0.0 AS d2, CAST(row_number() OVER (PARTITION BY q.point_id ORDER BY {D2}, p.point_id) AS INT) AS rank FROM {x.POINTS} q JOIN {x.POINTS} p ON p.cloud_id = q.cloud_id QUALIFY rank <= 3")
def nearest_points(spark, sf):
    queries = x.points(spark, sf).withColumnRenamed("point_id", "query_id")
    return spatial.nearest(queries, x.points(spark, sf), 3, 4.0, writer(spark)).select("query_id", "point_id", r6(F.col("d2")).alias("d2"), "rank")


@catalog.op("J10_radius_count", f"SELECT q.point_id AS query_id, count(*) AS n FROM {x.POINTS} q JOIN {x.POINTS} p ON p.cloud_id = q.cloud_id WHERE {D2} <= 16 GROUP BY 1")
def radius_count(spark, sf):
    queries = x.points(spark, sf).withColumnRenamed("point_id", "query_id")
    return spatial.radius_search(queries, x.points(spark, sf), 4.0).groupBy("query_id").agg(F.count("*").alias("n"))


@catalog.op("J10_nearest_apart", f"SELECT q.point_id AS query_id, p.point_id, round({D2},6)+0.0 AS d2 FROM {x.POINTS} q JOIN {x.POINTS} p ON p.cloud_id = q.cloud_id WHERE abs(q.point_id - p.point_id) > 20 QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY {D2}, p.point_id) = 1")
def nearest_apart(spark, sf):
    queries = x.points(spark, sf).withColumnRenamed("point_id", "query_id")
    return spatial.nearest(queries, x.points(spark, sf), 1, 8.0, writer(spark), apart=20).select("query_id", "point_id", r6(F.col("d2")).alias("d2"))


@catalog.op("J11_correspondence", f"SELECT q.point_id AS query_id, p.point_id, round({D2},6)+0.0 AS d2 FROM {x.POINTS} q, {x.POINTS} p WHERE q.cloud_id = 0 AND p.cloud_id = 1 QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY {D2}, p.point_id) = 1")
def correspondence(spark, sf):
    points = x.points(spark, sf)
    queries = points.where("cloud_id = 0").withColumnRenamed("point_id", "query_id")
    return spatial.nearest(queries, points.where("cloud_id = 1"), 1, 6.0, writer(spark), key=None).select("query_id", "point_id", r6(F.col("d2")).alias("d2"))


def segment(a: str, b: str) -> str:
    """Squared distance of (x, y, z) from the segment between two corners, in SQL."""
    d = {n: f"({b}{n}-{a}{n})" for n in "xyz"}
    t = f"greatest(0, least(1, (({' + '.join(f'({n}-{a}{n})*{d[n]}' for n in 'xyz')})/({' + '.join(f'{d[n]}*{d[n]}' for n in 'xyz')}))))"
    return " + ".join(f"pow({n}-({a}{n}+{t}*{d[n]}), 2)" for n in "xyz")


def dots(names: dict[str, tuple[str, str]]) -> str:
    return ", ".join(f"{' + '.join(f'{a.format(n)}*{b.format(n)}' for n in 'xyz')} AS {name}" for name, (a, b) in names.items())


AB, AC, AP = "(k{0}-a{0})", "(c{0}-a{0})", "({0}-a{0})"
DISTANCE = f"""WITH p AS (SELECT point_id, x, y, z, t.*, {dots({"d00": (AB, AB), "d01": (AB, AC), "d11": (AC, AC), "d20": (AP, AB), "d21": (AP, AC)})},
(ky-ay)*(cz-az)-(kz-az)*(cy-ay) AS nx, (kz-az)*(cx-ax)-(kx-ax)*(cz-az) AS ny, (kx-ax)*(cy-ay)-(ky-ay)*(cx-ax) AS nz FROM {x.POINTS} q JOIN {x.TRIANGLES} t ON q.cloud_id = t.mesh_id),
b AS (SELECT *, d00*d11-d01*d01 AS det, (d11*d20-d01*d21)/(d00*d11-d01*d01) AS v, (d00*d21-d01*d20)/(d00*d11-d01*d01) AS w FROM p)
SELECT point_id AS query_id, round(sqrt(min(CASE WHEN v >= 0 AND w >= 0 AND v+w <= 1 THEN pow((x-ax)*nx+(y-ay)*ny+(z-az)*nz, 2)/(nx*nx+ny*ny+nz*nz) ELSE least({segment("a", "k")}, {segment("k", "c")}, {segment("c", "a")}) END)), 6)+0.0 AS distance FROM b GROUP BY point_id"""


@catalog.op("J12_triangle_distance", DISTANCE)
def triangle_distance(spark, sf):
    queries = x.points(spark, sf).selectExpr("point_id AS query_id", "cloud_id AS mesh_id", "x", "y", "z")
    return spatial.signed_distance(queries, x.triangles(spark, sf), parity=False).select("query_id", r6(F.col("distance")).alias("distance"))


HITS = f"""WITH p AS (SELECT point_id, -x AS dx, -y AS dy, -z AS dz, x-ax AS sx, y-ay AS sy, z-az AS sz, kx-ax AS e1x, ky-ay AS e1y, kz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z FROM {x.POINTS} q JOIN {x.TRIANGLES} t ON q.cloud_id = t.mesh_id),
c AS (SELECT *, dy*e2z-dz*e2y AS px, dz*e2x-dx*e2z AS py, dx*e2y-dy*e2x AS pz, sy*e1z-sz*e1y AS qx, sz*e1x-sx*e1z AS qy, sx*e1y-sy*e1x AS qz FROM p),
u AS (SELECT *, e1x*px+e1y*py+e1z*pz AS det FROM c)
SELECT point_id AS query_id, count(*) FILTER (WHERE abs(det) > 1e-6 AND (sx*px+sy*py+sz*pz)/det BETWEEN 0 AND 1 AND (dx*qx+dy*qy+dz*qz)/det >= 0 AND (sx*px+sy*py+sz*pz+dx*qx+dy*qy+dz*qz)/det <= 1 AND (e2x*qx+e2y*qy+e2z*qz)/det >= 0) AS hits FROM u GROUP BY point_id"""


@catalog.op("A8_inside_parity", HITS)
def inside_parity(spark, sf):
    queries = x.points(spark, sf).selectExpr("point_id AS query_id", "cloud_id AS mesh_id", "x", "y", "z")
    return spatial.hits_to_origin(queries, x.triangles(spark, sf)).select("query_id", "hits")


@catalog.op("J13_level_set", f"SELECT query_id, CAST(floor(distance) AS BIGINT) AS level FROM ({DISTANCE})")
def level_set(spark, sf):
    """Whole-number levels of the unsigned field; the field itself is J12's, a sweep would need the whole grid in one place."""
    return triangle_distance(spark, sf).select("query_id", F.floor("distance").alias("level"))


@catalog.op("G12_depth_render", """SELECT ray_id, round(min(t),6)+0.0 AS depth FROM (SELECT ray_id, tn/det AS t FROM ({0}) WHERE abs(det) > 1e-6 AND un/det BETWEEN 0 AND 1 AND vn/det >= 0 AND un/det+vn/det <= 1) WHERE t > 0 GROUP BY ray_id""".format(
    f"SELECT ray_id, fid, e2x*qx+e2y*qy+e2z*qz AS tn, det, -ax*px-ay*py-az*pz AS un, x*qx+y*qy+z*qz AS vn FROM (SELECT *, -ay*e1z+az*e1y AS qx, -az*e1x+ax*e1z AS qy, -ax*e1y+ay*e1x AS qz, e1x*px+e1y*py+e1z*pz AS det FROM (SELECT *, y*e2z-z*e2y AS px, z*e2x-x*e2z AS py, x*e2y-y*e2x AS pz FROM (SELECT *, kx-ax AS e1x, ky-ay AS e1y, kz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z FROM {x.RAYS} r JOIN {x.TRIANGLES} t ON r.cloud_id = t.mesh_id)))"))
def depth_render(spark, sf):
    rays = x.rays(spark, sf).withColumnRenamed("cloud_id", "mesh_id")
    return spatial.depth_image(rays, x.triangles(spark, sf)).select("ray_id", r6(F.col("depth")).alias("depth"))


@catalog.op("J14_aligned_tensors", f"SELECT a.sample_id, {R(total='sum(a.value*b.value)')} FROM {x.VOLUME} a JOIN (SELECT * FROM {x.VOLUME} WHERE value > 0) b USING (sample_id, h, w, d) GROUP BY 1")
def aligned_tensors(spark, sf):
    v = x.volume(spark, sf)
    joined = v.join(v.where("value > 0").withColumnRenamed("value", "other"), ["sample_id", "h", "w", "d"])
    return joined.groupBy("sample_id").agg(r6(F.sum(F.col("value") * F.col("other"))).alias("total"))


@catalog.op("J15_predictions", f"SELECT sample_id, {R(error='sum(abs(pred-target))')} FROM {x.PREDICTIONS} GROUP BY 1")
def prediction_errors(spark, sf):
    return x.predictions(spark, sf).groupBy("sample_id").agg(r6(F.sum(F.abs(F.col("pred") - F.col("target")))).alias("error"))


OVERLAP = f"SELECT a.frame, a.det_id AS det_a, b.det_id AS det_b, i/((a.r-a.l)*(a.b-a.t)+(b.r-b.l)*(b.b-b.t)-i) AS iou FROM {x.DETECTIONS} a JOIN {x.DETECTIONS} b ON a.frame = b.frame AND a.det_id < b.det_id, LATERAL (SELECT greatest(0, least(a.r,b.r)-greatest(a.l,b.l))*greatest(0, least(a.b,b.b)-greatest(a.t,b.t)) AS i) WHERE i > 0"
catalog.add("J17_overlaps", lambda s, d: tracking.overlaps(x.detections(s, d)).select("frame", "det_a", "det_b", x.quick6(F.col("iou")).alias("iou")), f"SELECT frame, det_a, det_b, round(iou,6)+0.0 AS iou FROM ({OVERLAP})")


@catalog.op("J16_greedy_assignment")
def greedy_assignment(spark, sf):
    """Tests hold it against a plain loop."""
    return tracking.greedy_overlaps(x.detections(spark, sf), writer(spark)).select("frame", "row_id", "col_id", r6(F.col("cost")).alias("cost"))


@catalog.op("J16_first_round", f"SELECT frame, det_a AS row_id, det_b AS col_id FROM ({OVERLAP}) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY 1-iou, det_a, det_b) = 1")
def first_round(spark, sf):
    """The pair that each frame's greedy assignment takes first."""
    one = x.detections(spark, sf)
    pairs = tracking.best_overlaps(one, one).groupBy("frame").agg(F.min(F.struct("cost", "row_id", "col_id")).alias("m"))
    return pairs.select("frame", "m.row_id", "m.col_id")


@catalog.op("W8_trajectories", f"SELECT track, count(*) AS n, string_agg(frame || ':' || det_id, ',' ORDER BY frame, det_id) AS path FROM {x.DETECTIONS} WHERE frame <= 20 GROUP BY track")
def trajectories(spark, sf):
    found = tracking.trajectories(x.detections(spark, sf), 20)
    return found.select("track", "n", F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["frame"], p["det_id"])), ",").alias("path"))


# Set operations.
catalog.add("U1_cloud_union", lambda s, d: x.points(s, d).select("point_id", "cloud_id").unionByName(x.rays(s, d).select(F.col("ray_id").alias("point_id"), "cloud_id")).groupBy("cloud_id").agg(F.count("*").alias("n")), f"SELECT cloud_id, count(*) AS n FROM (SELECT point_id, cloud_id FROM {x.POINTS} UNION ALL SELECT ray_id, cloud_id FROM {x.RAYS}) GROUP BY 1")


@catalog.op("U2_voxel_cubes", f"SELECT sample_id, 8*count(*) AS vertices, 12*count(*) AS faces, CAST(sum(8*(w+h+d)+12) AS BIGINT) AS total FROM {x.VOLUME} WHERE value > 0.5 GROUP BY 1")
def voxel_cubes(spark, sf):
    vertices, faces = volume.cubes(volume.sparse(x.volume(spark, sf)))
    counted = vertices.groupBy("sample_id").agg(F.count("*").alias("vertices"), F.sum(F.col("x") + F.col("y") + F.col("z")).cast("long").alias("total"))
    return counted.join(faces.groupBy("sample_id").agg(F.count("*").alias("faces")), "sample_id")


catalog.add("U3_mask_union", lambda s, d: x.volume(s, d).where("value > 2").select("h", "w", "d").union(x.volume(s, d).where("value < -2").select("h", "w", "d")).distinct(), f"SELECT h, w, d FROM {x.VOLUME} WHERE value > 2 UNION SELECT h, w, d FROM {x.VOLUME} WHERE value < -2")
catalog.add("U3_mask_intersection", lambda s, d: x.volume(s, d).where("value > 4 AND sample_id % 2 = 0").select("h", "w", "d").intersect(x.volume(s, d).where("value > 4 AND sample_id % 2 = 1").select("h", "w", "d")), f"SELECT h, w, d FROM {x.VOLUME} WHERE value > 4 AND sample_id % 2 = 0 INTERSECT SELECT h, w, d FROM {x.VOLUME} WHERE value > 4 AND sample_id % 2 = 1")
catalog.add("U4_tensor_append", lambda s, d: volume.appended(x.volume(s, d), x.volume(s, d).withColumn("value", F.col("value") * 2)).groupBy("sample_id").agg(r6(F.sum("value")).alias("total")), f"WITH v AS (SELECT * FROM {x.VOLUME}) SELECT sample_id, {R(total='sum(value)')} FROM (SELECT sample_id, value FROM v UNION ALL SELECT sample_id + (SELECT max(sample_id)+1 FROM v), value*2 FROM v) GROUP BY 1")
catalog.add("U4_channels", lambda s, d: volume.stacked(x.volume(s, d), x.volume(s, d).withColumn("value", -F.col("value"))).groupBy("sample_id", "channel").agg(r6(F.max("value")).alias("top")), f"SELECT sample_id, channel, round(max(value),6)+0.0 AS top FROM (SELECT sample_id, 0 AS channel, value FROM {x.VOLUME} UNION ALL SELECT sample_id, 1, -value FROM {x.VOLUME}) GROUP BY 1, 2")

# Windows.
catalog.add("W1_smoothed_loss", lambda s, d: metrics.smoothed(x.protocol(s, d), 10).select("iter", r6(F.col("smoothed")).alias("smoothed")), f"SELECT iter, round(smoothed,6)+0.0 AS smoothed FROM (SELECT iter, avg(loss) OVER (ORDER BY iter ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS smoothed FROM {x.PROTOCOL}) WHERE iter % 10 = 0")
catalog.add("W2_convergence", lambda s, d: metrics.converged(x.protocol(s, d), 20, 1.0).select("block", r6(F.col("change")).alias("change"), "first"),
            f'WITH b AS (SELECT iter//20 AS block, m FROM (SELECT iter, avg(loss) OVER (ORDER BY iter ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM {x.PROTOCOL}) WHERE iter % 20 = 0), c AS (SELECT block, abs(m - lag(m) OVER (ORDER BY block)) AS change FROM b) SELECT block, round(change,6)+0.0 AS change, (SELECT min(block) FROM c WHERE change < 1) AS "first" FROM c WHERE change IS NOT NULL')
catalog.add("W3_schedule", lambda s, d: metrics.schedule(x.protocol(s, d), 100).select("iter", *rounded(rate=F.col("rate"), momentum=F.col("momentum"))), f"SELECT iter, {R(rate='greatest(1e-4, 0.01*pow(0.9, floor(iter/100)))', momentum='least(0.9, 0.5*pow(1.05, floor(iter/100)))')} FROM {x.PROTOCOL}")
catalog.add("W4_cumulative", lambda s, d: x.triangles(s, d).select("mesh_id", "fid", r6(F.sum(F.abs("ax")).over(Window.partitionBy("mesh_id").orderBy("fid").rowsBetween(Window.unboundedPreceding, 0))).alias("total")), f"SELECT mesh_id, fid, {R(total='sum(abs(ax)) OVER (PARTITION BY mesh_id ORDER BY fid ROWS UNBOUNDED PRECEDING)')} FROM {x.TRIANGLES}")
SIGN = f"SELECT sample_id, (h*4+w)*4+d AS k, CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END AS value FROM {x.VOLUME}"
catalog.add("W5_run_lengths", lambda s, d: volume.run_lengths(x.volume(s, d).withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0)), 4, 4),
            f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY k) - row_number() OVER (PARTITION BY sample_id, value ORDER BY k) AS i FROM ({SIGN})), g AS (SELECT sample_id, value, min(k) AS f, count(*) AS n FROM r GROUP BY sample_id, value, i) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY f) - 1 AS run, CAST(value AS DOUBLE) AS value, n FROM g")
catalog.add("W6_running_index", lambda s, d: x.detections(s, d).where("track < 5").select("frame", "det_id", (F.row_number().over(Window.partitionBy("frame").orderBy("det_id")) - 1).cast("long").alias("n")), f"SELECT frame, det_id, row_number() OVER (PARTITION BY frame ORDER BY det_id) - 1 AS n FROM {x.DETECTIONS} WHERE track < 5")
