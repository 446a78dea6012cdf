"""Text sinks: objects as (file_id, text) rows, and a writer that puts each row into a file of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """(key, n, body): the lines of each object in order, each with a line end."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.concat(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"), F.lit("\n")).alias("body"))


def coordinates(*names: str) -> Column:
    return F.concat_ws(" ", *[F.col(n).cast("string") for n in names])


def off(vertices: DataFrame, faces: DataFrame, key: str = "mesh_id") -> DataFrame:
    """(file_id, text) of OFF meshes."""
    v = joined(vertices, key, "vid", coordinates("x", "y", "z")).withColumnsRenamed({"n": "nv", "body": "bv"})
    f = joined(faces, key, "fid", F.concat(F.lit("3 "), coordinates("v0", "v1", "v2")))
    text = F.concat(F.lit("OFF\n"), F.concat_ws(" ", F.col("nv").cast("string"), F.coalesce("n", F.lit(0)).cast("string"), F.lit("0")), F.lit("\n"), F.col("bv"), F.coalesce("body", F.lit("")))
    return v.join(f, key, "left").select(F.col(key).cast("string").alias("file_id"), text.alias("text"))


def obj(vertices: DataFrame, faces: DataFrame, key: str = "mesh_id") -> DataFrame:
    """(file_id, text) of OBJ meshes; faces count from 1."""
    v = joined(vertices, key, "vid", F.concat(F.lit("v "), coordinates("x", "y", "z"))).withColumnRenamed("body", "bv")
    one = [(F.col(f"v{k}") + 1).cast("string") for k in range(3)]
    f = joined(faces, key, "fid", F.concat(F.lit("f "), F.concat_ws(" ", *one))).drop("n")
    return v.join(f, key, "left").select(F.col(key).cast("string").alias("file_id"), F.concat(F.col("bv"), F.coalesce("body", F.lit(""))).alias("text"))


def ply(points: DataFrame, key: str = "cloud_id", colour: tuple[int, int, int] | None = (0, 0, 0)) -> DataFrame:
    """(file_id, text) of ascii PLY clouds; a fixed colour, or the columns r, g and b."""
    rgb = F.lit(" ".join(map(str, colour))) if colour else coordinates("r", "g", "b")
    rows = joined(points, key, "point_id", F.concat_ws(" ", coordinates("x", "y", "z"), rgb))
    head = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"),
        F.lit("\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"),
    )
    return rows.select(F.col(key).cast("string").alias("file_id"), F.concat(head, "body").alias("text"))


def points(rows: DataFrame, key: str = "cloud_id") -> DataFrame:
    """(file_id, text): a count line, then a line for each point."""
    out = joined(rows, key, "point_id", coordinates("x", "y", "z"))
    return out.select(F.col(key).cast("string").alias("file_id"), F.concat(F.col("n").cast("string"), F.lit("\n"), "body").alias("text"))


def boxes(rows: DataFrame, key: str, meta: str | None = None) -> DataFrame:
    """(file_id, text): a count line, then nine numbers with two places and the meta word."""
    names = ("sx", "sy", "sz", "tx", "ty", "tz", "rx", "ry", "rz")
    line = F.format_string(" ".join(["%.2f"] * 9), *[F.col(n) for n in names])
    out = joined(rows, key, "box_id", F.concat_ws(" ", line, F.col(meta)) if meta else line)
    return out.select(F.col(key).cast("string").alias("file_id"), F.concat(F.col("n").cast("string"), F.lit("\n"), "body").alias("text"))


def detections(rows: DataFrame, key: str) -> DataFrame:
    """(file_id, text): track lines of 18 fields; type, rectangle and size are constants, the yaw is turned back by pi/2."""
    line = F.concat_ws(" ", F.col("frame").cast("string"), F.col("track").cast("string"), F.lit("Car -1 -1 -10 0 0 0 0 2 2 4.2"), coordinates("x", "y", "z"), (F.col("yaw") + 1.5707963267948966).cast("string"), F.lit("1"))
    return joined(rows, key, "line_no", line).select(F.col(key).cast("string").alias("file_id"), F.col("body").alias("text"))


def annotations(rows: DataFrame, key: str) -> DataFrame:
    return joined(rows, key, "id", coordinates("id", "yaw", "x", "y", "z")).select(F.col(key).cast("string").alias("file_id"), F.col("body").alias("text"))


def matrix_csv(rows: DataFrame, key: str) -> DataFrame:
    """(file_id, text): all values of a matrix (key, row, col, value) on one line."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "col", "value")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["value"].cast("string")), ",").alias("text")).select(F.col(key).cast("string").alias("file_id"), "text")


def wireframe_svg(triangles: DataFrame, key: str = "mesh_id", scale: float = 10.0) -> DataFrame:
    """(file_id, text): every face's outline, seen along z."""
    pair = lambda p: F.concat_ws(",", *[F.round(F.col(f"{p}{c}") * scale, 2).cast("string") for c in "xy"])
    line = F.concat(F.lit('<polygon fill="none" stroke="black" points="'), F.concat_ws(" ", pair("a"), pair("k"), pair("c")), F.lit('"/>'))
    return joined(triangles, key, "fid", line).select(F.col(key).cast("string").alias("file_id"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), "body", F.lit("</svg>\n")).alias("text"))


def metric_lines(row: DataFrame) -> DataFrame:
    """(metric, value) of a one-row table."""
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in row.columns]), F.array(*[F.col(c).cast("double") for c in row.columns]))).alias("metric", "value"))


def as_json(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("file_id"), F.to_json(F.struct(*rows.columns)).alias("text"))


def write_files(files: DataFrame, path: str, extension: str) -> None:
    """A folder for each file_id with its text in a part file; repeated writes replace a folder."""
    named = files.withColumn("name", F.concat("file_id", F.lit(extension)))
    ended = F.regexp_replace("text", "\n$", "").alias("text")  # the writer ends the row with a line end
    named.select("name", ended).write.mode("overwrite").partitionBy("name").text(path)
