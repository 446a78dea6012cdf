"""Binary formats, decoded from whole files in Arrow batches: scans, matrices, voxel runs, images and tensors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bytes(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """(file_id, content) for each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}" if extension else "*").load(path)
    return files.select(F.col("path").alias("file_id"), "content")


def decoded(files: DataFrame, one, schema: str) -> DataFrame:
    """Rows of each file: one(content) gives a table without file_id; files without content give none."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                if content is not None:
                    table = one(bytes(content))
                    table.insert(0, "file_id", file_id)
                    yield table

    return files.select("file_id", "content").mapInPandas(decode, f"file_id string, {schema}")


def parse_scan(files: DataFrame) -> DataFrame:
    """(file_id, point_id, x, y, z): float32 quadruples, reflectance dropped, axes turned to ours; no limit on points."""
    def one(content: bytes) -> pd.DataFrame:
        p = np.frombuffer(content, "<f4", len(content) // 16 * 4).reshape(-1, 4).astype(float)
        return pd.DataFrame({"point_id": np.arange(len(p)), "x": -p[:, 1], "y": p[:, 2], "z": p[:, 0]})

    return decoded(files, one, "point_id long, x double, y double, z double")


def parse_matrix(files: DataFrame) -> DataFrame:
    """(file_id, row, col, value): int64 rows and columns, then doubles column by column."""
    def one(content: bytes) -> pd.DataFrame:
        rows, columns = struct.unpack("<qq", content[:16])
        m = np.frombuffer(content, "<f8", rows * columns, 16).reshape(columns, rows)
        col, row = np.divmod(np.arange(rows * columns), max(rows, 1))
        return pd.DataFrame({"row": row, "col": col, "value": m.ravel()})

    return decoded(files, one, "row long, col long, value double")


def matrix_bytes(m: np.ndarray) -> bytes:
    return struct.pack("<qq", *m.shape) + np.asfortranarray(m, "<f8").tobytes(order="F")


def parse_binvox(files: DataFrame) -> DataFrame:
    """(file_id, i, j, k): set voxels; runs of (value, count) bytes in x, z, y order."""
    def one(content: bytes) -> pd.DataFrame:
        head, _, data = content.partition(b"data\n")
        a, b, c = next(map(int, line.split()[1:]) for line in head.splitlines() if line.startswith(b"dim"))
        runs = np.frombuffer(data, np.uint8)
        cells = np.repeat(runs[::2], runs[1::2])
        i, k, j = np.unravel_index(np.flatnonzero(cells), (a, c, b))
        return pd.DataFrame({"i": i, "j": j, "k": k})

    return decoded(files, one, "i long, j long, k long")


def binvox_bytes(cells: np.ndarray) -> bytes:
    """A boolean grid as binvox: runs of at most 255."""
    flat = np.ascontiguousarray(np.swapaxes(cells, 1, 2)).ravel().astype(np.uint8)
    starts = np.flatnonzero(np.diff(flat, prepend=1 - flat[:1]))
    counts = np.diff(np.append(starts, len(flat)))
    runs = bytearray()
    for value, n in zip(flat[starts].tolist(), counts.tolist(), strict=True):
        while n:
            runs += bytes((value, min(n, 255)))
            n -= min(n, 255)
    return b"#binvox 1\ndim %d %d %d\ntranslate 0 0 0\nscale 1\ndata\n" % cells.shape + bytes(runs)


def parse_ply_binary(files: DataFrame) -> DataFrame:
    """(file_id, point_id, x, y, z) of binary little-endian PLY vertices whose first properties are x, y and z."""
    kinds = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "short": "<i2", "ushort": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4"}

    def one(content: bytes) -> pd.DataFrame:
        head, _, data = content.partition(b"end_header\n")
        fields: list[tuple[str, str]] = []
        n, at = 0, ""
        for words in (line.split() for line in head.decode("ascii", "replace").splitlines()):
            if words[:1] == ["element"]:
                at, n = words[1], int(words[2]) if words[1] == "vertex" else n
            elif words[:1] == ["property"] and at == "vertex":
                fields.append((words[2], kinds[words[1]]))
        p = np.frombuffer(data, np.dtype(fields), n)
        return pd.DataFrame({"point_id": np.arange(n)} | {c: p[c].astype(float) for c in "xyz"})

    return decoded(files, one, "point_id long, x double, y double, z double")


def parse_normal_map(files: DataFrame, width: int) -> DataFrame:
    """(file_id, v, u, nx, ny, nz) of raw 8-bit RGB normal maps: 0..255 stands for -1..1."""
    def one(content: bytes) -> pd.DataFrame:
        p = np.frombuffer(content, np.uint8, len(content) // 3 * 3).reshape(-1, 3) / 127.5 - 1
        v, u = np.divmod(np.arange(len(p)), width)
        return pd.DataFrame({"v": v, "u": u, "nx": p[:, 0], "ny": p[:, 1], "nz": p[:, 2]})

    return decoded(files, one, "v long, u long, nx double, ny double, nz double")


def read_hdf5(spark: SparkSession, path: str, key: str = "tensor") -> DataFrame:
    """(file_id, k, value) of a dataset in flat order, where h5py is installed; else land tensors as Parquet."""
    try:
        import h5py
    except ImportError as error:
        raise RuntimeError("h5py is not installed: land tensors as Parquet and use read_tensor") from error
    import io

    def one(content: bytes) -> pd.DataFrame:
        with h5py.File(io.BytesIO(content)) as f:
            values = f[key][()].ravel()
        return pd.DataFrame({"k": np.arange(len(values)), "value": values.astype(float)})

    return decoded(read_bytes(spark, path), one, "k long, value double")


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    """A landed tensor in long form."""
    return spark.read.parquet(path)


def write_tensor(volume: DataFrame, path: str) -> None:
    """Tensors as Parquet, a sample's rows together and in order; an older table is replaced."""
    volume.repartition("sample_id").sortWithinPartitions("sample_id", "h", "w", "d").write.mode("overwrite").parquet(path)
