"""What the corpus operators share: shared scratch tables, word patterns and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: So many links at most are made stars at once, in one task.
RUN = 500_000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a local session (tests)
    gets a temporary one; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="voxloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.n = 0

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df written under name, partitioned by a column if one is given, and read back; an older table of that name is removed."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        if name in self.paths:
            self.remove(self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                self.remove(self.paths.pop(name))

    def remove(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_side(scratch: Scratch, df: DataFrame, name: str, most: int = 100_000, weight: F.Column | None = None) -> tuple[DataFrame, bool]:
    """df as a table, and whether its size allows a broadcast: its rows, or for rows of no fixed size the sum of their weights."""
    table = scratch.table(df, name)
    size = table.count() if weight is None else table.agg(F.sum(weight)).first()[0] or 0
    return table, size <= most


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the components of the links (u, v) each node but the least, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (above := root[root])).any():
            root = above
        left = root[a] != root[b]
        a, b = a[left], b[left]
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def stars(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, with the same components: of each partition, up to RUN links at a time, the stars about their least nodes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda some: pd.DataFrame(dict(zip("uv", forest(*(np.concatenate([x[c].to_numpy() for x in some]) for c in "uv")), strict=True)))
        held: list[pd.DataFrame] = []
        for batch in batches:
            if held and sum(map(len, held)) + len(batch) > RUN:
                yield made(held)
                held = []
            held.append(batch)
        if held:
            yield made(held)

    return links.mapInPandas(of, "u long, v long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the links (a, b), two long columns without nulls.

    Returns (node, root) for each node of a link; root is the least node of its component.
    Each task makes the links that it holds stars, so that no more of them go on than it has nodes;
    there are as many tasks as the links take at RUN a task. Links of one run are ready then. More
    go by alternating stars: first each node sends its larger neighbours to its least neighbour,
    then its smaller ones; a round is two aggregations and two equi-joins on the links, and about
    log(n) rounds are needed. Hubs only meet in min(), which combines before the shuffle, and
    in equi-joins, which Spark splits where they are skewed.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    pairs = scratch.table(stars(pairs), "links")
    seen = None
    while True:
        runs = -(-pairs.count() // RUN)
        pairs = scratch.table(stars(pairs.coalesce(max(1, runs))), "links")
        if runs <= 1:
            break
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = scratch.table(small.where("u <> v").distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
