"""Text formats. Each reader has a parser that works on (file_id, line_no, line) or whole texts, without UDFs.

read_*(spark, path) lands files as rows; parse_*(df) takes rows that are there already. Lines come
from splitting whole files, so that a file is never cut; files of this kind hold one object each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_whole(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """(file_id, text) for each file under a path; file_id is the file's path."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{extension}" if extension else "*")
    return rows.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, line), numbered from 0, without line ends."""
    return files.select("file_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def number(values: Column, k) -> Column:
    return F.try_element_at(values, F.lit(k + 1) if isinstance(k, int) else k + 1).try_cast("double")


def checked(actual: Column, wanted: Column, what: str, value: Column) -> Column:
    """The value where actual equals wanted; an error else."""
    return F.when(actual == wanted, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), actual.cast("string"), F.lit(" for "), wanted.cast("string"))))


def parse_off(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (file_id, vid, x, y, z) and faces (file_id, fid, v0, v1, v2) of OFF texts.

    The counts may follow OFF on the same line. Only triangles are read; face indices have to exist.
    """
    body = files.select("file_id", fields(F.regexp_replace(F.regexp_replace("text", r"(?m)#.*$", " "), r"^\s*OFF", "")).alias("t"))
    counted = body.select("file_id", "t", number(F.col("t"), 0).cast("long").alias("n"), number(F.col("t"), 1).cast("long").alias("m"))
    at = lambda k: F.get("t", k.cast("int"))
    vertices = counted.where("n > 0").select("file_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("vid"))
    vertices = vertices.select("file_id", "vid", *[at(3 + F.col("vid") * 3 + k).cast("double").alias(c) for k, c in enumerate("xyz")])
    faces = counted.where("m > 0").select("file_id", "t", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("fid"))
    base = 3 + F.col("n") * 3 + F.col("fid") * 4
    corner = lambda k: F.when(at(base + k).cast("long") < F.col("n"), at(base + k).cast("long")).otherwise(F.raise_error(F.lit("a face names a vertex that isn't there")))
    faces = faces.where(at(base) == "3").select("file_id", "fid", *[corner(k + 1).alias(f"v{k}") for k in range(3)])
    return vertices, faces


def parse_obj(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of OBJ texts: lines v and f, indices from 1, degenerate faces dropped."""
    rows = lines(files).select("file_id", "line_no", fields(F.col("line")).alias("t"))
    first = F.get("t", 0)
    kept = rows.where(first.isin("v", "f")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("rows"))
    pick = lambda tag: F.posexplode(F.filter("rows", lambda r: F.get(r["t"], 0) == tag))
    vertices = kept.select("file_id", pick("v").alias("vid", "r")).select("file_id", F.col("vid").cast("long").alias("vid"), *[number(F.col("r.t"), k + 1).alias(c) for k, c in enumerate("xyz")])
    index = lambda k: (F.substring_index(F.get("r.t", k + 1), "/", 1).cast("long") - 1).alias(f"v{k}")
    faces = kept.select("file_id", pick("f").alias("fid", "r")).select("file_id", F.col("fid").cast("long").alias("fid"), *[index(k) for k in range(3)])
    return vertices, faces.where("v0 <> v1 AND v1 <> v2 AND v0 <> v2")


def parse_points(files: DataFrame, strict: bool = True) -> DataFrame:
    """(file_id, point_id, x, y, z) of texts with a count line; strict checks the count."""
    rows = files.select("file_id", F.filter(F.transform(F.split("text", "\r?\n"), lambda s: F.trim(s)), lambda s: s != "").alias("rows"))
    count = F.get("rows", 0).cast("long")
    body = F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1)))
    body = checked(F.size(body).cast("long"), count, "points", body) if strict else body
    out = rows.select("file_id", F.posexplode(body).alias("k", "line")).select("file_id", F.col("k").cast("long").alias("point_id"), fields(F.col("line")).alias("t"))
    return out.select("file_id", "point_id", *[number(F.col("t"), k).alias(c) for k, c in enumerate("xyz")])


def parse_ply(files: DataFrame) -> DataFrame:
    """(file_id, point_id, x, y, z, r, g, b) of ascii PLY vertices; colours are null where there are none."""
    rows = files.select("file_id", F.split("text", "end_header\\s*\r?\n").alias("p"))
    count = F.regexp_extract(F.get("p", 0), r"element vertex (\d+)", 1).cast("int")
    body = F.slice(F.split(F.get("p", 1), "\r?\n"), F.lit(1), count)
    out = rows.select("file_id", F.posexplode(body).alias("k", "line")).select("file_id", F.col("k").cast("long").alias("point_id"), fields(F.col("line")).alias("t"))
    return out.select("file_id", "point_id", *[number(F.col("t"), k).alias(c) for k, c in enumerate("xyz")], *[number(F.col("t"), k + 3).cast("int").alias(c) for k, c in enumerate("rgb")])


def parse_m(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of .m meshes: lines 'Vertex id x y z' and 'Face id a b c', ids from 1."""
    t = lines(files).select("file_id", fields(F.col("line")).alias("t"))
    id_of = lambda k: number(F.col("t"), k).cast("long") - 1
    vertices = t.where(F.get("t", 0) == "Vertex").select("file_id", id_of(1).alias("vid"), *[number(F.col("t"), k + 2).alias(c) for k, c in enumerate("xyz")])
    faces = t.where(F.get("t", 0) == "Face").select("file_id", id_of(1).alias("fid"), *[id_of(k + 2).alias(f"v{k}") for k in range(3)])
    return vertices, faces


def parse_labels(rows: DataFrame) -> DataFrame:
    """Boxes of label lines with 15 or 16 fields: type, height, width, length, position and yaw, and the score if there is one."""
    t = rows.select("file_id", "line_no", fields(F.col("line")).alias("t")).where(F.size("t") >= 15)
    names = ("height", "width", "length", "x", "y", "z", "yaw")
    return t.select("file_id", "line_no", F.get("t", 0).alias("type"), *[number(F.col("t"), 8 + k).alias(n) for k, n in enumerate(names)], number(F.col("t"), 15).alias("score"))


def parse_boxes(files: DataFrame) -> DataFrame:
    """(file_id, box_id, size, translation, rotation, meta) of texts with a count line and 9 or 10 fields a line."""
    rows = files.select("file_id", F.filter(F.transform(F.split("text", "\r?\n"), lambda s: F.trim(s)), lambda s: s != "").alias("rows"))
    body = F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1)))
    body = checked(F.size(body).cast("long"), F.get("rows", 0).cast("long"), "boxes", body)
    t = rows.select("file_id", F.posexplode(body).alias("k", "line")).select("file_id", F.col("k").cast("long").alias("box_id"), fields(F.col("line")).alias("t"))
    names = ("sx", "sy", "sz", "tx", "ty", "tz", "rx", "ry", "rz")
    return t.select("file_id", "box_id", *[number(F.col("t"), k).alias(n) for k, n in enumerate(names)], F.get("t", 9).alias("meta"))


def parse_detections(rows: DataFrame) -> DataFrame:
    """Detections of lines with 16 fields, or more than 16 with frame and track first; the yaw is turned by -pi/2."""
    t = rows.select("file_id", "line_no", fields(F.col("line")).alias("t")).where(F.size("t") >= 16)
    skip = F.when(F.size("t") > 16, 2).otherwise(0)
    at = lambda k: number(F.col("t"), skip + k)
    tracked = F.size("t") > 16
    names = {"truncated": 1, "occluded": 2, "l": 4, "t": 5, "r": 6, "b": 7, "height": 8, "width": 9, "length": 10, "x": 11, "y": 12, "z": 13}
    return t.select(
        "file_id", "line_no", F.when(tracked, number(F.col("t"), 0).cast("long")).alias("frame"), F.when(tracked, number(F.col("t"), 1).cast("long")).alias("track"),
        F.get("t", skip).alias("type"), *[at(k).alias(n) for n, k in names.items()], (at(14) - 1.5707963267948966).alias("yaw"), at(15).alias("score"),
    )


def parse_matrix_csv(files: DataFrame, columns: int) -> DataFrame:
    """(file_id, row, col, value) of comma-separated numbers, filled row by row."""
    values = files.select("file_id", F.posexplode(F.split(F.regexp_replace("text", r"\s+", ""), ",")).alias("k", "v")).where("v <> ''")
    return values.select("file_id", F.floor(F.col("k") / columns).alias("row"), (F.col("k") % columns).cast("long").alias("col"), F.col("v").cast("double").alias("value"))


def parse_calibration(rows: DataFrame) -> DataFrame:
    """(file_id, name, m): 'name: 12 numbers' or 12 numbers, as 16 numbers with the row (0, 0, 0, 1)."""
    t = rows.select("file_id", "line_no", F.when(F.col("line").contains(":"), F.substring_index("line", ":", 1)).alias("name"), fields(F.substring_index("line", ":", -1)).alias("t")).where(F.size("t") == 12)
    return t.select("file_id", "line_no", "name", F.concat(F.transform("t", lambda v: v.cast("double")), F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])).alias("m"))


def parse_plane(rows: DataFrame) -> DataFrame:
    """(file_id, a, b, c, d) from the fourth line."""
    t = rows.where("line_no = 3").select("file_id", fields(F.col("line")).alias("t"))
    return t.select("file_id", *[number(F.col("t"), k).alias(n) for k, n in enumerate("abcd")])


def parse_annotations(rows: DataFrame) -> DataFrame:
    """(file_id, id, yaw, x, y, z) of lines with five fields."""
    t = rows.select("file_id", fields(F.col("line")).alias("t")).where(F.size("t") == 5)
    return t.select("file_id", number(F.col("t"), 0).cast("long").alias("id"), *[number(F.col("t"), k + 1).alias(n) for k, n in enumerate(("yaw", "x", "y", "z"))])


def parse_viewpoints(rows: DataFrame) -> DataFrame:
    """(file_id, view, x, y, z) of lines with three fields."""
    t = rows.select("file_id", F.col("line_no").alias("view"), fields(F.col("line")).alias("t")).where(F.size("t") == 3)
    return t.select("file_id", "view", *[number(F.col("t"), k).alias(n) for k, n in enumerate("xyz")])


def parse_ids(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, id); blank lines are skipped."""
    return rows.where(F.trim("line") != "").select("file_id", "line_no", F.trim("line").cast("long").alias("id"))


POSE = "STRUCT<tx:double,ty:double,tz:double,rx:double,ry:double,rz:double,state:int,occlusion:int,truncation:int>"
TRACKLET = f"objectType string, h double, w double, l double, first_frame long, poses STRUCT<count:long,item:ARRAY<{POSE}>>"


def poses_of(items: DataFrame, *keys: str) -> DataFrame:
    """A row for each pose of each tracklet: (keys, object_type, h, w, l, first_frame, frame, tx, ty, tz, rx, ry, rz, state, occlusion, truncation)."""
    spread = items.where("objectType IS NOT NULL").select(*keys, F.col("objectType").alias("object_type"), "h", "w", "l", "first_frame", F.posexplode("poses.item").alias("k", "p"))
    return spread.select(*keys, "object_type", "h", "w", "l", "first_frame", (F.col("first_frame") + F.col("k")).alias("frame"), "p.*")


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """Poses of tracklet files. Spark's own XML reader finds the outer items; the schema is given, so nothing is inferred."""
    return poses_of(spark.read.format("xml").option("rowTag", "item").schema(TRACKLET).load(path))


def parse_tracklets(files: DataFrame) -> DataFrame:
    """Poses of tracklet texts (file_id, text): a root element with items."""
    fields_of = ",".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ", 1) for f in TRACKLET.split(", ")))
    parsed = F.from_xml(F.col("text"), f"item ARRAY<STRUCT<{fields_of}>>")
    return poses_of(files.select("file_id", F.explode(parsed["item"]).alias("i")).select("file_id", "i.*"), "file_id")


def read_config(path: str) -> dict:
    """A JSON configuration; of repeated keys the last counts."""
    import json

    with open(path) as f:
        return json.load(f)


def scan_directory(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """(path, name, length, key) of the files under a path; ordered by key they are in natural order."""
    from voxloom.functions.strings import base_name, natural_key

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}" if extension else "*").load(path)
    return files.select("path", base_name(F.col("path")).alias("name"), "length", natural_key(base_name(F.col("path"))).alias("key"))


def unzip(archive: str, target: str) -> list[str]:
    """Names of the extracted files; for a local archive, before it is landed."""
    import zipfile

    with zipfile.ZipFile(archive) as z:
        z.extractall(target)
        return z.namelist()
