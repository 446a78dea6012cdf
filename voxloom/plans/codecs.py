"""Catalogue of sources (S), sinks (K), converters, and iterative fits (G).

The driver's tables hold no files, so objects are written as texts by the sinks and read back.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import fitting, mesh, volume
from voxloom.plans import fixtures as x
from voxloom.plans.aggregates import SHEET_F, SHEET_V, grid_mesh
from voxloom.plans.fixtures import Catalog, R, r6, rounded
from voxloom.plans.scratch import shared_folder, writer
from voxloom.sources import binary, text, writers

catalog = Catalog()
op, add = catalog.op, catalog.add


def r3(c) -> F.Column:
    return F.round(c, 3) + F.lit(0.0)


def sheet(spark, sf):
    """The sheets with vertices numbered from 0 in each."""
    v, f = grid_mesh(spark, sf)
    own = lambda df, *names: df.withColumns({n: F.col(n) - 256 * F.col("mesh_id") for n in names})
    return own(v.withColumn("z", r3(F.col("z"))), "vid"), own(f, "v0", "v1", "v2")


V3 = f"(SELECT mesh_id, vid-256*mesh_id AS vid, x, y, round(z, 3)+0.0 AS z FROM {SHEET_V})"
F3 = f"(SELECT mesh_id, fid, v0-256*mesh_id AS v0, v1-256*mesh_id AS v1, v2-256*mesh_id AS v2 FROM {SHEET_F})"


def mesh_text(head: str, vertex: str, face: str) -> str:
    """SQL for a text of each mesh."""
    v = f"(SELECT mesh_id, count(*) AS nv, string_agg({vertex}, '\n' ORDER BY vid) AS tv FROM {V3} GROUP BY 1)"
    f = f"(SELECT mesh_id, count(*) AS nf, string_agg({face}, '\n' ORDER BY fid) AS tf FROM {F3} GROUP BY 1)"
    return f"SELECT CAST(mesh_id AS VARCHAR) AS file_id, {head} || tv || '\n' || coalesce(tf || '\n', '') AS text FROM {v} LEFT JOIN {f} USING (mesh_id)"


OFF_TEXT = mesh_text("'OFF\n' || nv || ' ' || coalesce(nf, 0) || ' 0\n'", "x || ' ' || y || ' ' || z", "'3 ' || v0 || ' ' || v1 || ' ' || v2")
OBJ_TEXT = mesh_text("''", "'v ' || x || ' ' || y || ' ' || z", "'f ' || (v0+1) || ' ' || (v1+1) || ' ' || (v2+1)")
VERTICES = f"SELECT CAST(mesh_id AS VARCHAR) AS file_id, vid, x, y, z FROM {V3}"
add("K2_write_off", lambda s, d: writers.off(*sheet(s, d)), OFF_TEXT)
add("K3_write_obj", lambda s, d: writers.obj(*sheet(s, d)), OBJ_TEXT)
one_line = lambda files: files.withColumn("text", F.regexp_replace("text", "^OFF\n", "OFF"))
add("S2_read_off", lambda s, d: text.parse_off(writers.off(*sheet(s, d)))[0].select("file_id", "vid", "x", "y", "z"), VERTICES)
add("S2_read_off_faces", lambda s, d: text.parse_off(one_line(writers.off(*sheet(s, d))))[1].select("file_id", "fid", "v0", "v1", "v2"), f"SELECT CAST(mesh_id AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY mesh_id ORDER BY fid)-1 AS fid, v0, v1, v2 FROM {F3}")
add("S3_read_obj", lambda s, d: text.parse_obj(writers.obj(*sheet(s, d)))[0].select("file_id", "vid", "x", "y", "z"), VERTICES)
add("K13_off_to_obj", lambda s, d: convert(writers.off(*sheet(s, d))), OBJ_TEXT)


def convert(files):
    """OFF texts as OBJ texts."""
    v, f = text.parse_off(files)
    return writers.obj(v.withColumnRenamed("file_id", "mesh_id"), f.withColumnRenamed("file_id", "mesh_id"))


def cloud(spark, sf):
    return x.points(spark, sf).select("cloud_id", "point_id", *[r3(F.col(c)).alias(c) for c in "xyz"])


CLOUD = f"(SELECT cloud_id, point_id, {', '.join(f'round({c}, 3)+0.0 AS {c}' for c in 'xyz')} FROM {x.POINTS})"
POINTS_TEXT = f"SELECT CAST(cloud_id AS VARCHAR) AS file_id, count(*) || '\n' || string_agg(x || ' ' || y || ' ' || z, '\n' ORDER BY point_id) || '\n' AS text FROM {CLOUD} GROUP BY cloud_id"
PLY_HEAD = "'\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n'"
PLY_TEXT = f"SELECT CAST(cloud_id AS VARCHAR) AS file_id, 'ply\nformat ascii 1.0\nelement vertex ' || count(*) || {PLY_HEAD} || string_agg(x || ' ' || y || ' ' || z || ' 0 0 0', '\n' ORDER BY point_id) || '\n' AS text FROM {CLOUD} GROUP BY cloud_id"
add("K5_write_points", lambda s, d: writers.points(cloud(s, d)), POINTS_TEXT)
add("K4_write_ply", lambda s, d: writers.ply(cloud(s, d)), PLY_TEXT)
add("S6_read_points", lambda s, d: text.parse_points(writers.points(cloud(s, d))), f"SELECT CAST(cloud_id AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id)-1 AS point_id, x, y, z FROM {CLOUD}")
add("S4_read_ply", lambda s, d: text.parse_ply(writers.ply(cloud(s, d))), f"SELECT CAST(cloud_id AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id)-1 AS point_id, x, y, z, CAST(0 AS INT) AS r, CAST(0 AS INT) AS g, CAST(0 AS INT) AS b FROM {CLOUD}")
add("K13_points_to_ply", lambda s, d: writers.ply(text.parse_points(writers.points(cloud(s, d))).withColumnRenamed("file_id", "cloud_id")), PLY_TEXT)
NINE = ("sx", "sy", "sz", "tx", "ty", "tz", "rx", "ry", "rz")


def whole_boxes(spark, sf):
    """Boxes whose numbers are whole quarters, so that two places hold them."""
    quarter = lambda k: (F.floor(F.abs(x.e(k)) * 400) / 4).cast("double")
    return x.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("frame"), F.col("vec_id").alias("box_id"), *[quarter(k + 1).alias(n) for k, n in enumerate(NINE)], F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("meta"))


BOXED = f"(SELECT CAST(label AS BIGINT) AS frame, vec_id AS box_id, {', '.join(f'floor(abs({x.E(k + 1)})*400)/4 AS {n}' for k, n in enumerate(NINE))}, 'm' || vec_id AS meta FROM embeddings)"
add("K6_write_boxes", lambda s, d: writers.boxes(whole_boxes(s, d), "frame", "meta"), f"SELECT CAST(frame AS VARCHAR) AS file_id, count(*) || '\n' || string_agg(printf('{' '.join(['%.2f'] * 9)}', {', '.join(NINE)}) || ' ' || meta, '\n' ORDER BY box_id) || '\n' AS text FROM {BOXED} GROUP BY frame")
add("S9_read_boxes", lambda s, d: text.parse_boxes(writers.boxes(whole_boxes(s, d), "frame", "meta")), f"SELECT CAST(frame AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY frame ORDER BY box_id)-1 AS box_id, {', '.join(NINE)}, meta FROM {BOXED}")


def label_lines(spark, sf):
    """Label lines of 15 fields; with every third one a score."""
    line = F.concat_ws(" ", F.lit("Car 0 0 0 1 2 3 4"), *[F.col(n).cast("string") for n in NINE[:7]], F.when(F.col("box_id") % 3 == 0, F.lit("0.5")))
    return whole_boxes(spark, sf).select(F.col("frame").cast("string").alias("file_id"), F.col("box_id").alias("line_no"), line.alias("line"))


add("S8_read_labels", lambda s, d: text.parse_labels(label_lines(s, d)), f"SELECT CAST(frame AS VARCHAR) AS file_id, box_id AS line_no, 'Car' AS type, sx AS height, sy AS width, sz AS length, tx AS x, ty AS y, tz AS z, rx AS yaw, CASE WHEN box_id % 3 = 0 THEN 0.5 END AS score FROM {BOXED}")


def detection_lines(spark, sf):
    """Every second line in the tracking format with frame and track first."""
    plain = F.concat_ws(" ", F.lit("Car 1 2 0"), *[F.col(n).cast("string") for n in NINE], F.lit("7.0"), F.lit("0.0"), F.lit("0.25"))
    line = F.when(F.col("box_id") % 2 == 1, F.concat_ws(" ", F.col("frame").cast("string"), F.col("box_id").cast("string"), plain)).otherwise(plain)
    return whole_boxes(spark, sf).select(F.lit("all").alias("file_id"), F.col("box_id").alias("line_no"), line.alias("line"))


add("S18_read_detections", lambda s, d: text.parse_detections(detection_lines(s, d)).select("line_no", F.coalesce("frame", F.lit(-1)).alias("frame"), F.coalesce("track", F.lit(-1)).alias("track"), "l", "height", "x", r6(F.col("yaw")).alias("yaw"), "score"),
    f"SELECT box_id AS line_no, CASE WHEN box_id%2=1 THEN frame ELSE -1 END AS frame, CASE WHEN box_id%2=1 THEN box_id ELSE -1 END AS track, sx AS l, ty AS height, ry AS x, round(-pi()/2,6) AS yaw, 0.25 AS score FROM {BOXED}")


def poses(spark, sf):
    return whole_boxes(spark, sf).select("frame", F.col("box_id").alias("track"), F.col("box_id").alias("line_no"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), F.lit(-1.5707963267948966).alias("yaw"))


add("K10_write_detections", lambda s, d: writers.detections(poses(s, d), "frame"), f"SELECT CAST(frame AS VARCHAR) AS file_id, string_agg(frame || ' ' || box_id || ' Car -1 -1 -10 0 0 0 0 2 2 4.2 ' || tx || ' ' || ty || ' ' || tz || ' 0.0 1', '\n' ORDER BY box_id) || '\n' AS text FROM {BOXED} GROUP BY frame")
matrix = lambda s, d: x.volume(s, d).select("sample_id", (F.col("h") * 4 + F.col("w")).cast("long").alias("row"), F.col("d").cast("long").alias("col"), r3(F.col("value")).alias("value"))
MATRIX = f"(SELECT sample_id, CAST(h*4+w AS BIGINT) AS row, CAST(d AS BIGINT) AS col, round(value,3)+0.0 AS value FROM {x.VOLUME})"
add("K9_write_matrix", lambda s, d: writers.matrix_csv(matrix(s, d), "sample_id"), f"SELECT CAST(sample_id AS VARCHAR) AS file_id, string_agg(value, ',' ORDER BY row, col) AS text FROM {MATRIX} GROUP BY sample_id")
add("S13_read_matrix", lambda s, d: text.parse_matrix_csv(writers.matrix_csv(matrix(s, d), "sample_id"), 4), f"SELECT CAST(sample_id AS VARCHAR) AS file_id, row, col, value FROM {MATRIX}")


def number_lines(spark, sf, n: int, name: str | None = None):
    values = [F.floor(x.e(k + 1) * 100).cast("string") for k in range(n)]
    line = F.concat_ws(" ", *([F.lit(f"{name}:")] if name else []), *values)
    return x.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("file_id"), F.col("vec_id").alias("line_no"), line.alias("line"))


FLOORED = lambda k: f"floor({x.E(k)}*100)"
add("S16_read_calibration", lambda s, d: text.parse_calibration(number_lines(s, d, 12, "P0")).select("line_no", "name", F.get("m", 0).alias("m0"), F.get("m", 11).alias("m11"), F.get("m", 15).alias("m15")), f"SELECT vec_id AS line_no, 'P0' AS name, {FLOORED(1)} AS m0, {FLOORED(12)} AS m11, CAST(1 AS DOUBLE) AS m15 FROM embeddings")
add("S17_read_plane", lambda s, d: text.parse_plane(number_lines(s, d, 4).withColumn("line_no", F.col("line_no") % 50)), f"SELECT CAST(label AS VARCHAR) AS file_id, {', '.join(f'{FLOORED(k + 1)} AS {n}' for k, n in enumerate('abcd'))} FROM embeddings WHERE vec_id % 50 = 3")
add("S19_read_annotations", lambda s, d: text.parse_annotations(number_lines(s, d, 5)), f"SELECT CAST(label AS VARCHAR) AS file_id, CAST({FLOORED(1)} AS BIGINT) AS id, {', '.join(f'{FLOORED(k + 2)} AS {n}' for k, n in enumerate(('yaw', 'x', 'y', 'z')))} FROM embeddings")
add("K10_write_annotations", lambda s, d: writers.annotations(whole_boxes(s, d).select("frame", F.col("box_id").alias("id"), F.col("rx").alias("yaw"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z")), "frame"), f"SELECT CAST(frame AS VARCHAR) AS file_id, string_agg(box_id || ' ' || rx || ' ' || tx || ' ' || ty || ' ' || tz, '\n' ORDER BY box_id) || '\n' AS text FROM {BOXED} GROUP BY frame")
add("S20_read_viewpoints", lambda s, d: text.parse_viewpoints(number_lines(s, d, 3)), f"SELECT CAST(label AS VARCHAR) AS file_id, vec_id AS view, {', '.join(f'{FLOORED(k + 1)} AS {n}' for k, n in enumerate('xyz'))} FROM embeddings")
add("S21_read_ids", lambda s, d: text.parse_ids(x.table(s, d, "embeddings").select(F.col("label").cast("string").alias("file_id"), F.col("vec_id").alias("line_no"), F.when(F.col("vec_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("vec_id").cast("string"))).alias("line"))), "SELECT CAST(label AS VARCHAR) AS file_id, vec_id AS line_no, vec_id AS id FROM embeddings WHERE vec_id % 4 <> 0")
add("S22_natural_scan", lambda s, d: x.table(s, d, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit("_"), (F.col("page_id") % 3).cast("string"), F.lit(".txt")).alias("name")).select("name", natural("name").alias("key")), "SELECT 'f' || page_id || '_' || (page_id % 3) || '.txt' AS name, 'f' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '_' || lpad(CAST(page_id % 3 AS VARCHAR), 12, '0') || '.txt' AS key FROM pages")
add("S11_json_config", lambda s, d: x.table(s, d, "events").select("event_id", F.from_json("props", "k LONG")["k"].alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
add("K12_write_json", lambda s, d: writers.as_json(x.table(s, d, "events").select("event_id", "user_id", "event_type"), "event_id"), """SELECT CAST(event_id AS VARCHAR) AS file_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS text FROM events""")
add("K11_metric_lines", lambda s, d: writers.metric_lines(x.points(s, d).agg(F.count("*").alias("points"), r6(F.max("x")).alias("far"))), f"SELECT 'points' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {x.POINTS} UNION ALL SELECT 'far', round(max(x),6) FROM {x.POINTS}")
add("K8_wireframe", lambda s, d: writers.wireframe_svg(x.triangles(s, d)).select("file_id", F.regexp_count("text", F.lit("<polygon")).cast("long").alias("faces")), f"SELECT CAST(mesh_id AS VARCHAR) AS file_id, count(*) AS faces FROM {x.TRIANGLES} GROUP BY 1")
RUNS = lambda s, d: volume.run_lengths(x.volume(s, d).withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0)), 4, 4)


@op("S12_run_decoding", f"SELECT sample_id, string_agg(CASE WHEN value > 0 THEN '1' ELSE '0' END, '' ORDER BY h, w, d) AS bits FROM {x.VOLUME} GROUP BY sample_id")
def run_decoding(spark, sf):
    """Runs back to cells."""
    runs = RUNS(spark, sf).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("run", "value", "n"))).alias("r"))
    cells = volume.expand_runs(F.transform("r", lambda r: r["value"]), F.transform("r", lambda r: r["n"].cast("int")))
    return runs.select("sample_id", F.array_join(F.transform(cells, lambda v: v.cast("int").cast("string")), "").alias("bits"))


def natural(name: str):
    from voxloom.functions.strings import natural_key

    return natural_key(F.col(name))


# Binary formats: bytes are made from the vectors, and parsed.
def vector_bytes(spark, sf, head: bytes = b"", doubles: bool = False):
    """(file_id, content): each vector as little-endian numbers behind a head."""
    import pandas as pd

    kind = "<f8" if doubles else "<f4"

    def make(batches):
        for batch in batches:
            yield pd.DataFrame({"file_id": batch["vec_id"].astype(str), "content": [head + np.asarray(v, kind).tobytes() for v in batch["embedding"]]})

    return x.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(make, "file_id string, content binary")


SCAN = ", ".join(f"round({sign}CAST(embedding[k*4+{j}] AS DOUBLE),6)+0.0 AS {n}" for n, j, sign in (("x", 2, "-"), ("y", 3, ""), ("z", 1, "")))
add("S7_read_scan", lambda s, d: binary.parse_scan(vector_bytes(s, d)).select("file_id", "point_id", *rounded(**{c: F.col(c) for c in "xyz"})), f"SELECT CAST(vec_id AS VARCHAR) AS file_id, k AS point_id, {SCAN} FROM embeddings, (SELECT unnest(range(16)) AS k)")
add("S14_read_binary_matrix", lambda s, d: binary.parse_matrix(vector_bytes(s, d, binary.struct.pack("<qq", 16, 4), True)).select("file_id", "row", "col", r6(F.col("value")).alias("value")), "SELECT CAST(vec_id AS VARCHAR) AS file_id, k % 16 AS row, k // 16 AS col, round(CAST(embedding[k+1] AS DOUBLE),6)+0.0 AS value FROM embeddings, (SELECT unnest(range(64)) AS k)")
PLY = b"ply\nformat binary_little_endian 1.0\nelement vertex 16\nproperty float x\nproperty float y\nproperty float z\nproperty float q\nend_header\n"
add("S4_read_binary_ply", lambda s, d: binary.parse_ply_binary(vector_bytes(s, d, PLY)).select("file_id", "point_id", *rounded(**{c: F.col(c) for c in "xyz"})), f"SELECT CAST(vec_id AS VARCHAR) AS file_id, k AS point_id, {', '.join(f'round(CAST(embedding[k*4+{j + 1}] AS DOUBLE),6)+0.0 AS {n}' for j, n in enumerate('xyz'))} FROM embeddings, (SELECT unnest(range(16)) AS k)")
add("S20_read_normal_map", lambda s, d: binary.parse_normal_map(vector_bytes(s, d), 8).groupBy("file_id").agg(F.count("*").alias("pixels")), "SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(64*4//3 AS BIGINT) AS pixels FROM embeddings")


@op("S12_read_binvox", f"SELECT CAST(sample_id AS VARCHAR) AS file_id, CAST(h AS BIGINT) AS i, CAST(w AS BIGINT) AS j, CAST(d AS BIGINT) AS k FROM {x.VOLUME} WHERE value > 0")
def read_binvox(spark, sf):
    """Vectors' signs as voxel files, written (K7) and read."""
    import pandas as pd

    def make(batches):
        for batch in batches:
            yield pd.DataFrame({"file_id": batch["vec_id"].astype(str), "content": [binary.binvox_bytes((np.asarray(v) > 0).reshape(4, 4, 4)) for v in batch["embedding"]]})

    files = x.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(make, "file_id string, content binary")
    return binary.parse_binvox(files)


add("K7_binvox_runs", RUNS, f"WITH c AS (SELECT sample_id, (h*4+w)*4+d AS k, CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END AS value FROM {x.VOLUME}), g AS (SELECT sample_id, value, min(k) AS f, count(*) AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY sample_id, value ORDER BY k) AS i FROM c) GROUP BY sample_id, value, i) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY f)-1 AS run, CAST(value AS DOUBLE) AS value, n FROM g")


@op("S5_read_m", VERTICES)
def read_m(spark, sf):
    v, f = sheet(spark, sf)
    lines = v.select(F.concat(F.lit("Vertex "), (F.col("vid") + 1).cast("string"), F.lit(" "), writers.coordinates("x", "y", "z")).alias("line"), "vid", F.col("mesh_id").cast("string").alias("file_id"))
    files = lines.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vid", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return text.parse_m(files)[0].select("file_id", "vid", "x", "y", "z")


def tracklet_texts(spark, sf):
    """One file of each frame's boxes: each box is a tracklet of two poses."""
    pose = lambda x_, y_: F.concat(*[p for n, c in (("tx", x_), ("ty", y_), ("tz", F.col("tz")), ("rx", F.lit(0)), ("ry", F.lit(0)), ("rz", F.col("rz"))) for p in (F.lit(f"<{n}>"), c.cast("string"), F.lit(f"</{n}>"))], F.lit("<state>2</state><occlusion>0</occlusion><truncation>-1</truncation>"))
    item = F.concat(
        F.lit("<item><objectType>Car</objectType><h>"), F.col("sx").cast("string"), F.lit("</h><w>"), F.col("sy").cast("string"), F.lit("</w><l>"), F.col("sz").cast("string"), F.lit("</l><first_frame>"), F.col("box_id").cast("string"),
        F.lit("</first_frame><poses><count>2</count><item>"), pose(F.col("tx"), F.col("ty")), F.lit("</item><item>"), pose(F.col("ty"), F.col("tx")), F.lit("</item></poses></item>"),
    )
    return whole_boxes(spark, sf).groupBy(F.col("frame").cast("string").alias("file_id")).agg(F.concat(F.lit("<tracklets>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</tracklets>")).alias("text"))


add("S10_read_tracklets", lambda s, d: text.parse_tracklets(tracklet_texts(s, d)).select("file_id", "object_type", "h", "first_frame", "frame", "tx", "ty", "rz", "truncation"),
    f"SELECT CAST(frame AS VARCHAR) AS file_id, 'Car' AS object_type, sx AS h, box_id AS first_frame, box_id+k AS frame, CASE WHEN k = 0 THEN tx ELSE ty END AS tx, CASE WHEN k = 0 THEN ty ELSE tx END AS ty, rz, CAST(-1 AS INT) AS truncation FROM {BOXED}, (SELECT unnest(range(2)) AS k)")


@op("K1_landed_tensors", f"SELECT sample_id, h, w, d, {R(value='value')} FROM {x.VOLUME}")
def landed_tensors(spark, sf):
    """Tensors written to the shared folder, a sample's rows together and in order, and read back."""
    path = f"{shared_folder(spark)}/tensors-{uuid.uuid4().hex}"
    binary.write_tensor(x.volume(spark, sf), path)
    return binary.read_tensor(spark, path).select("sample_id", "h", "w", "d", r6(F.col("value")).alias("value"))


# Iterative fits: rows only; tests recover known motions and shapes.
def pairs(spark, sf):
    """Each cloud and a turned, shifted copy of it."""
    p = x.points(spark, sf).select(F.col("cloud_id").alias("pair_id"), "point_id", "x", "y", "z")
    c, s = float(np.cos(0.02)), float(np.sin(0.02))
    moved = p.select("pair_id", "point_id", (c * F.col("x") + s * F.col("z") + 0.3).alias("x"), (F.col("y") - 0.2).alias("y"), (c * F.col("z") - s * F.col("x") + 0.1).alias("z"))
    return p.withColumn("side", F.lit("template")).unionByName(moved.withColumn("side", F.lit("model")))


add("G1_alignment", lambda s, d: fitting.alignments(pairs(s, d)).select("pair_id", *[F.round(F.col(f"t{k}"), 3).alias(f"t{k}") for k in range(3)], "steps"))
add("G2_plane_alignment", lambda s, d: fitting.alignments(pairs(s, d), plane=True).select("pair_id", *[F.round(F.col(f"t{k}"), 3).alias(f"t{k}") for k in range(3)], "steps"))


@op("G3_accumulated_voxels")
def accumulated_voxels(spark, sf):
    """Clouds aligned, accepted, united and voxelised."""
    from voxloom.operators import spatial

    p = pairs(spark, sf)
    fits = fitting.accepted(fitting.alignments(p), p.where("side = 'template'").groupBy("pair_id").agg(F.count("*").alias("n")))
    united = fitting.accumulated(p, fits).withColumnRenamed("pair_id", "cloud_id")
    return spatial.occupancy(united, x.GRID).groupBy("cloud_id").agg(F.count("*").alias("voxels"))


def model() -> tuple:
    """A sphere's field on a 6 x 6 x 6 grid and two ways in which it can change."""
    h, w, d = np.meshgrid(*[np.arange(6.0)] * 3, indexing="ij")
    field = np.sqrt((h - 2.5) ** 2 + (w - 2.5) ** 2 + (d - 2.5) ** 2) - 1.5
    return field.ravel().tolist(), np.stack([np.ones(216), (h - 2.5).ravel()], 1).tolist(), (6, 6, 6), [1.0, 0.5]


def small_clouds(spark, sf):
    return x.points(spark, sf).select("cloud_id", *[(F.col(c) / n * 5).alias(c) for c, n in (("x", 54), ("y", 24), ("z", 24))])


add("G4_shape_fit", lambda s, d: fitting.shape_fits(small_clouds(s, d), *model(), pose=False).select("cloud_id", F.round(F.get("z", 0), 3).alias("z0"), F.round("cost", 3).alias("cost")))
add("G5_pose_fit", lambda s, d: fitting.shape_fits(small_clouds(s, d), *model()).select("cloud_id", F.round("yaw", 2).alias("yaw"), F.round("cost", 2).alias("cost")))
add("G6_alternating_fit", lambda s, d: fitting.shape_fits(small_clouds(s, d), *model()).select("cloud_id", F.round("cost", 2).alias("cost")))
add("G8_surface", lambda s, d: fitting.surface(x.volume(s, d), (4, 4, 4)).groupBy("sample_id").agg(F.count("*").alias("triangles")))


@op("G10_hull_descent")
def hull_descent(spark, sf):
    """Three steps of gradient descent on the hull energy (A14); tests hold them against numpy."""
    v, f = grid_mesh(spark, sf)
    targets = v.select("mesh_id", "vid", F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(0.0).alias("tz"))
    return mesh.hull_descent(f, v, targets, 0.5, 1.2, 0.01, 3, writer(spark)).select("mesh_id", "vid", *rounded(**{c: F.col(c) for c in "xyz"}))
