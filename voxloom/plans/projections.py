"""Catalogue of geometric projections (P) and predicates (F)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxloom.functions import geometry as g
from voxloom.operators import volume, spatial
from voxloom.plans import fixtures as x
from voxloom.plans.fixtures import R, Catalog, rounded

catalog = Catalog()
P = g.vec("x", "y", "z")


def over_points(name: str, make, sql: dict[str, str]) -> None:
    """A projection of each point; make() gives the new columns."""
    catalog.add(name, lambda spark, sf: x.points(spark, sf).select("point_id", *rounded(**make())), f"SELECT point_id, {R(**sql)} FROM {x.POINTS}")


def named(v, names=("x", "y", "z")) -> dict:
    return dict(zip(names, v, strict=True))


lits = lambda *v: tuple(F.lit(float(a)) for a in v)
over_points("P1_translate", lambda: named(g.add(P, lits(1.5, -2, 3))), {"x": "x+1.5", "y": "y-2", "z": "z+3"})
over_points("P2_scale", lambda: named(g.scale(P, lits(2, 0.5, -1))), {"x": "x*2", "y": "y*0.5", "z": "-z"})
RX = ("x", "cos(0.3)*y-sin(0.3)*z", "sin(0.3)*y+cos(0.3)*z")
RY = (f"cos(0.5)*({RX[0]})+sin(0.5)*({RX[2]})", RX[1], f"cos(0.5)*({RX[2]})-sin(0.5)*({RX[0]})")
RZ = (f"cos(-0.7)*({RY[0]})-sin(-0.7)*({RY[1]})", f"sin(-0.7)*({RY[0]})+cos(-0.7)*({RY[1]})", RY[2])
over_points("P3_rotate_euler", lambda: named(g.rotate(P, lits(0.3, 0.5, -0.7))), named(RZ))
over_points("P3_rotate_back", lambda: named(g.rotate_back(g.rotate(P, lits(0.3, 0.5, -0.7)), lits(0.3, 0.5, -0.7))), {"x": "x", "y": "y", "z": "z"})
M3 = ((0.36, 0.48, -0.8), (-0.8, 0.6, 0.0), (0.48, 0.64, 0.6))
over_points("P4_rotate_matrix", lambda: named(g.matmul(M3, P)), named([f"{a}*x+{b}*y+({c})*z" for a, b, c in M3]))
M4 = ((1, 0.1, 0, 2), (0, 1, 0.2, -1), (0.3, 0, 1, 0.5), (0.01, 0, 0, 1))
over_points("P5_homogeneous", lambda: named(g.transform4(M4, P)) | named(g.transform4(M4, P, divide=False), ("ax", "ay", "az")),
            named([f"({a}*x+{b}*y+{c}*z+{d})/(0.01*x+1)" for a, b, c, d in M4[:3]]) | named([f"({a}*x+{b}*y+{c}*z+{d})" for a, b, c, d in M4[:3]], ("ax", "ay", "az")))
over_points("P6_mirror_switch", lambda: named(g.switch(g.mirror(P, 0), 0, 1)), {"x": "y", "y": "-x", "z": "z"})
over_points("P7_scanner_axes", lambda: named(g.from_scanner(P)), {"x": "-y", "y": "z", "z": "x"})
# A public example calibration of camera against scanner axes.
VELO = ((0.0, -1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0))
SHIFT = (0.27, -0.06, -0.33)
over_points("P8_camera_to_scanner", lambda: named(g.matmul(tuple(zip(*VELO, strict=True)), g.sub(P, lits(*SHIFT)))), {"x": "z-(-0.33)", "y": "-(x-0.27)", "z": "-(y-(-0.06))"})
over_points("P9_unproject", lambda: named(g.unproject(F.col("x"), F.col("y"), F.col("z"), 50, 45, 27, 12)), {"x": "(x+0.5-27)/50*z", "y": "(y+0.5-12)/45*z", "z": "z"})
over_points("P10_to_grid", lambda: named(g.to_grid(P, lits(27, 12, 12), F.lit(0.4), F.lit(30.0), 0.1, x.GRID)),
            {"x": "(cos(-0.4)*(x-27)+sin(-0.4)*(z-12))*54/36+27", "y": "(y-12)*54/36+12", "z": "(cos(-0.4)*(z-12)-sin(-0.4)*(x-27))*54/36+12"})
over_points("P15_disparity", lambda: {"depth": g.disparity_to_depth(F.col("x") * 256, 0.54, 721.0), "disparity": g.depth_to_disparity(F.col("z") + 1, 0.54, 721.0).cast("double")},
            {"depth": "CASE WHEN 0.54*721.0/x BETWEEN 1 AND 1000 THEN 0.54*721.0/x END", "disparity": "CASE WHEN z+1 BETWEEN 1 AND 1000 THEN floor(0.54*721.0/(z+1)*256) END"})
over_points("P19_height", lambda: {"y": g.height_at((0.02, -0.99, 0.05, 1.6), F.col("x"), F.col("z"))}, {"y": "(-1.6-0.05*z-0.02*x)/-0.99"})
AFFINE = (*M4[:3], (0, 0, 0, 1))
TURNED = ("((x+0.06*y-0.3*z)/1.006)", "((-0.1*x+y+0.03*z)/1.006)", "((0.02*x-0.2*y+z)/1.006)")
over_points("P20_transform_plane", lambda: named(g.transform_plane(AFFINE, (*P, F.col("x") - F.col("y"))), ("a", "b", "c", "d")), named((*TURNED, f"x-y-(2*{TURNED[0]}-{TURNED[1]}+0.5*{TURNED[2]})"), ("a", "b", "c", "d")))
ANGLE = "(x*40-1000)"
over_points("P21_wrap", lambda: {"wrapped": g.wrap_angle(F.col("x") * 40 - 1000, -180, 180), "bounced": g.bounce_angle(F.col("x") * 40 - 1000, -90, 90)},
            {"wrapped": f"{ANGLE}-360*floor(({ANGLE}+180)/360)", "bounced": f"90-abs(({ANGLE}+90)-360*floor(({ANGLE}+90)/360)-180)"})
GREY = "(y/12-1)"
over_points("P22_jet", lambda: named(g.jet(F.col("y") / 12 - 1), ("red", "green", "blue")), {n: f"greatest(0,least(1,1.5-2*abs({GREY}+({s}))))" for n, s in (("red", -0.5), ("green", 0), ("blue", 0.5))})
over_points("P27_squared_distance", lambda: {"d2": g.squared(P, lits(27, 12, 12))}, {"d2": "(x-27)*(x-27)+(y-12)*(y-12)+(z-12)*(z-12)"})
over_points("X14_vector_algebra", lambda: {
    "dot": g.dot(P, lits(1, 2, 3)), "cx": g.cross(P, lits(1, 2, 3))[0], "length": g.norm(P), "clamped": F.greatest(F.lit(5.0), F.least(F.lit(20.0), F.col("x"))),
    "det": g.determinant3([P, lits(0, 1, 2), lits(3, 0, 1)]), "inv00": g.inverse3([list(P), list(lits(0, 1, 2)), list(lits(3, 0, 1))])[0][0],
}, {"dot": "x+2*y+3*z", "cx": "y*3-z*2", "length": "sqrt(x*x+y*y+z*z)", "clamped": "greatest(5,least(20,x))", "det": "x*1-y*(0-6)+z*(0-3)", "inv00": "1/(x*1-y*(0-6)+z*(0-3))"})
over_points("X15_ray_angles", lambda: named(g.normal_angles(P), ("rx", "ry", "rz")), {"rx": "acos(0.0)", "ry": "acos(0.0)", "rz": "acos(0.0)"})
over_points("F13_road_plane", lambda: {
    n: F.when((F.col("y") > 0.1) & (F.col("y") < 9) & (F.col("x") * F.col("x") + F.col("z") * F.col("z") < 1600), F.col(n)).otherwise(0.0) for n in "xyz"
}, {n: f"CASE WHEN y > 0.1 AND y < 9 AND x*x+z*z < 1600 THEN {n} ELSE 0 END" for n in "xyz"})
over_points("F13_keep_road", lambda: {n: F.when((F.col("y") < 8) & (F.col("x") * F.col("x") + F.col("z") * F.col("z") < 1600), F.col(n)).otherwise(0.0) for n in "xyz"},
            {n: f"CASE WHEN y < 8 AND x*x+z*z < 1600 THEN {n} ELSE 0 END" for n in "xyz"})


@catalog.op("P11_box_canonical", f"SELECT point_id, box_id, {R(x='(cos(yaw)*(x-tx)+sin(yaw)*(z-tz))*54/sx', y='(y-ty)*54/sx', z='(cos(yaw)*(z-tz)-sin(yaw)*(x-tx))*54/sx')} FROM {x.POINTS}, {x.BOXES} WHERE abs(cos(yaw)*(x-tx)+sin(yaw)*(z-tz)) <= sx/2 AND abs(y-ty) <= sy/2 AND abs(cos(yaw)*(z-tz)-sin(yaw)*(x-tx)) <= sz/2")
def box_canonical(spark, sf):
    """The points of each box in the box's own coordinates."""
    both = spatial.points_in_boxes(x.points(spark, sf), x.boxes(spark, sf))
    own = g.canonical(P, g.vec("sx", "sy", "sz"), g.vec("tx", "ty", "tz"), F.col("yaw"), 54)
    return both.select("point_id", "box_id", *[x.quick6(c).alias(n) for n, c in named(own).items()])


MID = "(max({0})+min({0}))/2"


@catalog.op("P12_unit_cube", f"SELECT point_id, {R(**{n: f'(p.{n}-m{n})/(s*1.1)' for n in 'xyz'})} FROM {x.POINTS} p JOIN (SELECT cloud_id, {', '.join(f'{MID.format(n)} AS m{n}' for n in 'xyz')}, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM {x.POINTS} GROUP BY 1) c USING (cloud_id)")
def unit_cube(spark, sf):
    points = x.points(spark, sf)
    return spatial.unit_cube(points, 0.1).select("point_id", *rounded(x=F.col("x"), y=F.col("y"), z=F.col("z")))


@catalog.op("P13_yaw_pose", f"SELECT box_id, {R(m00='cos(yaw)*2', m02='sin(yaw)*2', m11='2.0', m20='-sin(yaw)*2', m22='cos(yaw)*2', m03='tx', m13='ty', m23='tz')} FROM {x.BOXES}")
def yaw_pose(spark, sf):
    m = g.pose_of(F.col("yaw"), g.vec("tx", "ty", "tz"), F.lit(2.0))
    return x.boxes(spark, sf).select("box_id", *rounded(m00=m[0][0], m02=m[0][2], m11=m[1][1], m20=m[2][0], m22=m[2][2], m03=m[0][3], m13=m[1][3], m23=m[2][3]))


@catalog.op("P14_look_at", f"SELECT point_id, {R(f='-x/n', k='50.0', r11='CASE WHEN n > 0 THEN -(-0.8) END')} FROM (SELECT point_id, x, sqrt(x*x+y*y+z*z) AS n FROM {x.POINTS})")
def look_at(spark, sf):
    """The view axis from the origin to each point, an intrinsic matrix' focal length, and a plane's alignment."""
    view = g.look_at(P, lits(0, 0, 0), lits(0, 1, 0))
    plane = g.plane_alignment(lits(0.6, -0.8, 0, 1.5))
    return x.points(spark, sf).select("point_id", *rounded(f=view[2][0], k=g.intrinsics(50, 45, 27, 12)[0][0], r11=plane[0][0]))


@catalog.op("P16_pixel_normals", f"""WITH v AS (SELECT vec_id AS img, CAST(k//8 AS INT) AS v, CAST(k%8 AS INT) AS u, CAST(embedding[k+1] AS DOUBLE)*5 AS z FROM embeddings, (SELECT unnest(range(64)) AS k)),
n AS (SELECT img, v, u, lead(z) OVER (PARTITION BY img, v ORDER BY u)-z AS dx, lead(z) OVER (PARTITION BY img, u ORDER BY v)-z AS dy FROM v)
SELECT img, v, u, {R(nx='-dx/sqrt(dx*dx+dy*dy+1)', ny='-dy/sqrt(dx*dx+dy*dy+1)', nz='1/sqrt(dx*dx+dy*dy+1)')} FROM n WHERE dx IS NOT NULL AND dy IS NOT NULL""")
def pixel_normals(spark, sf):
    k = F.col("k")
    grid = x.table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("k", "e"))
    grid = grid.select("img", F.floor(k / 8).cast("int").alias("v"), (k % 8).alias("u"), (k % 8).cast("double").alias("x"), F.floor(k / 8).cast("double").alias("y"), (F.col("e").cast("double") * 5).alias("z"))
    return spatial.pixel_normals(grid, "img").select("img", "v", "u", *rounded(nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")))


@catalog.op("P18_coloured_cloud", f"SELECT p.point_id, {R(x='p.x', y='p.y', z='p.z')}, CAST(c.label*20 AS BIGINT) AS r FROM {x.POINTS} p JOIN embeddings c ON c.vec_id = p.point_id WHERE c.label % 2 = 0")
def coloured_cloud(spark, sf):
    colours = x.table(spark, sf, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("point_id"), (F.col("label") * 20).cast("long").alias("r"))
    return x.points(spark, sf).join(colours, "point_id").select("point_id", *rounded(x=F.col("x"), y=F.col("y"), z=F.col("z")), "r")


@catalog.op("P22_palette", "SELECT vec_id, CAST([240,245,251,213,153,136,124,100,64,61][(vec_id % 10)+1] AS INT) AS r FROM embeddings")
def palette(spark, sf):
    return x.table(spark, sf, "embeddings").select("vec_id", F.get(g.palette_colour(F.col("vec_id")), 0).cast("int").alias("r"))


CORNER = "CAST(embedding[1+CAST(((floor(u)+{0})*16+(floor(v)+{1})*4+floor(w)+{2}) AS INT)] AS DOUBLE)*20"


@catalog.op("P23_trilinear", f"""WITH q AS (SELECT vec_id AS sample_id, embedding, 3*abs({x.E(1)}) AS u, 3*abs({x.E(2)}) AS v, 3*abs({x.E(3)}) AS w FROM embeddings)
SELECT sample_id, {R(value=' + '.join(f"{'(u-floor(u))' if a else '(1-u+floor(u))'}*{'(v-floor(v))' if b else '(1-v+floor(v))'}*{'(w-floor(w))' if c else '(1-w+floor(w))'}*{CORNER.format(a, b, c)}" for a in (0, 1) for b in (0, 1) for c in (0, 1)))} FROM q""")
def trilinear(spark, sf):
    wanted = x.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("vec_id").alias("query_id"), *[(3 * F.abs(x.e(k + 1))).alias(n) for k, n in enumerate(("ph", "pw", "pd"))])
    return spatial.trilinear(wanted, x.volume(spark, sf)).select("sample_id", *rounded(value=F.col("value")))


@catalog.op("P24_car_box", f"SELECT box_id, CAST(1.7 AS DOUBLE) AS height, CAST(2.0 AS DOUBLE) AS width, CAST(4.5 AS DOUBLE) AS length, {R(x='tx', y='ty', z='tz', yaw='yaw')} FROM {x.BOXES}")
def car_box(spark, sf):
    return x.boxes(spark, sf).select("box_id", *spatial.car_size(), *rounded(x=F.col("tx"), y=F.col("ty"), z=F.col("tz"), yaw=F.col("yaw")))


@catalog.op("P25_box_corners", f"SELECT box_id, CAST(k AS INT) AS corner, {R(x='tx+cos(yaw)*px-sin(yaw)*pz', y='ty+py', z='tz+sin(yaw)*px+cos(yaw)*pz', largest='greatest(sx,sy,sz)')} FROM (SELECT *, ((k//4)*2-1)*sx/2 AS px, (((k//2)%2)*2-1)*sy/2 AS py, ((k%2)*2-1)*sz/2 AS pz FROM {x.BOXES}, (SELECT unnest(range(8)) AS k))")
def box_corners(spark, sf):
    return spatial.box_corners(x.boxes(spark, sf)).select("box_id", "corner", *rounded(x=F.col("x"), y=F.col("y"), z=F.col("z"), largest=F.greatest("sx", "sy", "sz")))


@catalog.op("P26_box_pose", f"SELECT box_id, {R(x='cos(0.25)*tx+sin(0.25)*tz+1', y='ty+2', z='cos(0.25)*tz-sin(0.25)*tx+3', yaw='yaw+0.25')} FROM {x.BOXES}")
def box_pose(spark, sf):
    moved = g.add(g.rotate_y(g.vec("tx", "ty", "tz"), F.lit(0.25)), lits(1, 2, 3))
    return x.boxes(spark, sf).select("box_id", *rounded(**named(moved), yaw=F.col("yaw") + F.acos(F.cos(F.lit(0.25)))))


# Predicates.
def counted(name: str, make, sql: str) -> None:
    catalog.add(name, lambda spark, sf: make(spark, sf), sql)


counted("F1_point_in_box", lambda s, d: x.points(s, d).where(g.within(P, lits(20, 8, 8), lits(34, 16, 16))).select("point_id"), f"SELECT point_id FROM {x.POINTS} WHERE x BETWEEN 20 AND 34 AND y BETWEEN 8 AND 16 AND z BETWEEN 8 AND 16")
IN_BOX = "abs(cos(yaw)*(x-tx)+sin(yaw)*(z-tz)) <= sx/2 AND abs(y-ty) <= sy/2 AND abs(cos(yaw)*(z-tz)-sin(yaw)*(x-tx)) <= sz/2"
counted("F2_points_in_oriented_box", lambda s, d: spatial.points_in_boxes(x.points(s, d), x.boxes(s, d)).select("box_id", "point_id"), f"SELECT box_id, point_id FROM {x.POINTS}, {x.BOXES} WHERE {IN_BOX}")
counted("F3_points_in_unrotated_box", lambda s, d: spatial.points_in_boxes(x.points(s, d), x.boxes(s, d), oriented=False).select("box_id", "point_id"), f"SELECT box_id, point_id FROM {x.POINTS}, {x.BOXES} WHERE abs(x-tx) <= sx/2 AND abs(y-ty) <= sy/2 AND abs(z-tz) <= sz/2")
SLAB = "greatest(least(({lo}{0})/{1},({hi}{0})/{1})"
NEAR = "greatest(least((tx-sx/2)/x,(tx+sx/2)/x), least((ty-sy/2)/y,(ty+sy/2)/y), least((tz-sz/2)/z,(tz+sz/2)/z))"
FAR = "least(greatest((tx-sx/2)/x,(tx+sx/2)/x), greatest((ty-sy/2)/y,(ty+sy/2)/y), greatest((tz-sz/2)/z,(tz+sz/2)/z))"


@catalog.op("F4_ray_box", f"SELECT ray_id, box_id FROM {x.RAYS}, {x.BOXES} WHERE {NEAR} <= {FAR} AND {NEAR} < 1 AND {FAR} > 0")
def ray_box(spark, sf):
    return spatial.rays_in_boxes(x.rays(spark, sf), x.boxes(spark, sf))


A, B, C = g.vec("ax", "ay", "az"), g.vec("kx", "ky", "kz"), g.vec("cx", "cy", "cz")
RT = """SELECT ray_id, fid, e2x*qx+e2y*qy+e2z*qz AS tn, det, -ax*px-ay*py-az*pz AS un, x*qx+y*qy+z*qz AS vn FROM (SELECT *, -ay*e1z+az*e1y AS qx, -az*e1x+ax*e1z AS qy, -ax*e1y+ay*e1x AS qz, e1x*px+e1y*py+e1z*pz AS det FROM (
SELECT *, y*e2z-z*e2y AS px, z*e2x-x*e2z AS py, x*e2y-y*e2x AS pz FROM (SELECT *, kx-ax AS e1x, ky-ay AS e1y, kz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z FROM {rays}, {triangles})))"""


@catalog.op("F5_ray_triangle", f"SELECT ray_id, fid, {R(t='tn/det')} FROM ({RT.format(rays=x.RAYS, triangles=x.TRIANGLES)}) WHERE abs(det) > 1e-6 AND un/det BETWEEN 0 AND 1 AND vn/det >= 0 AND un/det+vn/det <= 1")
def ray_triangle(spark, sf):
    return spatial.rays_on_triangles(x.rays(spark, sf), x.triangles(spark, sf)).select("ray_id", "fid", *rounded(t=F.col("hit")))


@catalog.op("F6_triangle_box")
def triangle_box(spark, sf):
    """Triangles that overlap a fixed box; tests compare it with a dense sampling of the triangles."""
    return x.triangles(spark, sf).where(g.triangle_overlaps_box(lits(27, 12, 12), lits(6, 4, 4), A, B, C)).select("mesh_id", "fid")


AREA = "(({p}y-y)*({q}x-x)-({p}x-x)*({q}y-y))"


@catalog.op("F7_point_in_triangle", f"SELECT point_id, fid FROM {x.POINTS} p JOIN {x.TRIANGLES} t ON p.cloud_id = t.mesh_id WHERE sign({AREA.format(p='k', q='c')}) = sign({AREA.format(p='c', q='a')}) AND sign({AREA.format(p='c', q='a')}) = sign({AREA.format(p='a', q='k')})")
def point_in_triangle(spark, sf):
    both = x.points(spark, sf).join(x.triangles(spark, sf), F.col("cloud_id") == F.col("mesh_id"))
    return both.where(g.point_in_triangle_2d(P[:2], A[:2], B[:2], C[:2])).select("point_id", "fid")


counted("F8_type_filter", lambda s, d: x.table(s, d, "events").where(F.lower("event_type") == "purchase").select("event_id"), "SELECT event_id FROM events WHERE lower(event_type) = 'purchase'")
counted("F9_min_points", lambda s, d: spatial.boxes_with_points(x.points(s, d), x.boxes(s, d), 50), f"SELECT box_id, count(*) AS n FROM {x.POINTS}, {x.BOXES} WHERE {IN_BOX} GROUP BY box_id HAVING count(*) >= 50")
counted("F10_valid_depth", lambda s, d: x.points(s, d).where("z < 12").select("point_id"), f"SELECT point_id FROM {x.POINTS} WHERE z < 12")
counted("F11_non_empty_samples", lambda s, d: volume.non_empty(x.volume(s, d))[0].select("sample_id", "h", "w", "d", *rounded(value=F.col("value"))), f"SELECT sample_id, h, w, d, {R(value='value')} FROM {x.VOLUME} WHERE sample_id IN (SELECT sample_id FROM {x.VOLUME} GROUP BY 1 HAVING sum(value) > 0)")
counted("F12_exclude_list", lambda s, d: spatial.without(x.table(s, d, "documents").select("doc_id", "lang"), x.table(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
counted("F14_crop_to_rectangle", lambda s, d: spatial.crop_to_detection(x.points(s, d).withColumn("frame", F.col("point_id") % 50), x.detections(s, d), 15.0).select("det_id", "point_id"),
        f"SELECT det_id, point_id FROM {x.POINTS} p JOIN {x.DETECTIONS} d ON p.point_id % 50 = d.frame WHERE x+30 >= l AND x+30 < r AND y+40 >= t AND y+40 < b AND NOT (abs(x) < 1 AND abs(y) < 1 AND abs(z) < 1) AND (x-27)*(x-27)+(y-12)*(y-12)+(z-12)*(z-12) <= 225")
counted("F15_mask", lambda s, d: spatial.masked(x.points(s, d), x.table(s, d, "embeddings").where("label < 3").select(F.col("vec_id").alias("point_id")), "point_id").select("point_id", *rounded(x=F.col("x"), y=F.col("y"), z=F.col("z"))),
        f"SELECT point_id, {R(**{n: f'CASE WHEN cloud_id < 3 THEN 0 ELSE {n} END' for n in 'xyz'})} FROM {x.POINTS}")
FACE = "SELECT vec_id AS fid, vec_id % 7 AS v0, vec_id % 5 AS v1, vec_id % 3 AS v2 FROM embeddings"
counted("F16_degenerate_faces", lambda s, d: x.table(s, d, "embeddings").selectExpr("vec_id AS fid", "vec_id % 7 AS v0", "vec_id % 5 AS v1", "vec_id % 3 AS v2").where("v0 <> v1 AND v1 <> v2 AND v0 <> v2"), f"SELECT * FROM ({FACE}) WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2")
counted("F17_fit_acceptance", lambda s, d: x.table(s, d, "embeddings").select(F.col("vec_id").alias("pair_id"), (x.e(1) * x.e(1)).alias("residual"), (F.col("vec_id") % 40).alias("inliers")).where("residual < 0.001 AND inliers >= 31 div 2").select("pair_id"),
        f"SELECT vec_id AS pair_id FROM embeddings WHERE {x.E(1)}*{x.E(1)} < 0.001 AND vec_id % 40 >= 31//2")
