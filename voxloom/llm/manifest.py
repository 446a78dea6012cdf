"""A Merkle manifest of a dataset, kept as a store of nodes in Parquet that is partitioned by level.

Each row is a leaf, the digest of its fields. The leaves of a group (here a language) are dealt out
in ranges of their order, sorted, and written; a leaf's place in its group is its place in its
range plus the sizes of the ranges before, which are a small table. From there on a coordinate
(group, level, place) names a node. Levels are built in bands of ten: a run of 1024 places that
begin at a multiple of 1024 is one small group of rows, read in order, and gives its nodes of ten
levels to the store; the last of these is the band's result, from which the next band is read.
Groups end at their own height. Their roots, in order, are the leaves of one more such tree.

Proofs come from the same store, from the top down: a band's run meets what stands above it, one
row for each run, by coordinate, takes the siblings of its own levels on the way, and hands both
to the runs below. So no digest is repeated for all leaves below it, no run holds more than 1024
leaves, and no level needs the whole tree in one place, however uneven the groups are.

Defined results: nulls are fields like any other (a null language is a group and comes first, a
null doc_id comes first in its group); rows of one doc_id are ordered by their leaves, repeated
rows are leaves side by side; other columns are ignored; an empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, small_side

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a band.
BAND = 10


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[n]) for n in FIELDS]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def placed(rows: DataFrame, group: str, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """rows with `place` (from 0, in their group's order) and `size` (of the group), as a table. Rows are sorted by ranges; only the ranges' sizes meet."""
    at = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    sorted_rows = scratch.table(sorted_rows.withColumn("range", F.shiftright("at", 33)), f"{name}-sorted")
    ranges = sorted_rows.groupBy(group, "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(group).alias("r_group"), F.col("range").alias("r_range"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    ranges, few = small_side(scratch, ranges, f"{name}-ranges")
    both = sorted_rows.join(F.broadcast(ranges) if few else ranges, F.col(group).eqNullSafe(F.col("r_group")) & (F.col("range") == F.col("r_range")))
    return both.withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("at", "range", "r_group", "r_range", "first", "before")


def above(nodes: list[str], size: int, start: int, levels: int = BAND) -> Iterator[tuple[list[str], int, int]]:
    """The levels over a run of nodes: (digests, size of the whole level, place of the first), from the level over them up to the root of the group or of the band."""
    for _ in range(levels):
        if size <= 1:
            return
        nodes = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        size, start = (size + 1) // 2, start // 2
        yield nodes, size, start


def run_of(place: Column) -> Column:
    return F.shiftright(place, BAND)


def banded(base: int):
    """A function from the runs of a level (group, place, size, digest) to the nodes of the band over it."""

    def build(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("place")
        out, group, k = [], run["group"].iloc[0], base
        for nodes, size, start in above(run["digest"].tolist(), int(run["size"].iloc[0]), int(run["place"].iloc[0])):
            k += 1
            out.append(pd.DataFrame({"level": k, "group": group, "place": range(start, start + len(nodes)), "size": size, "digest": nodes}))
        return pd.concat(out) if out else pd.DataFrame(columns=["level", "group", "place", "size", "digest"])

    return build


NODE = "level int, group long, place long, size long, digest string"


class Tree:
    """The store of nodes over leaves (group, place, size, digest)."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str):
        self.scratch, self.name = scratch, name
        self.bands = [leaves.select("group", "place", "size", "digest")]  # the level at the foot of each band
        self.roots = leaves.where("size = 1").select("group", "digest")
        while True:
            foot = self.bands[-1]
            if foot.where("size > 1").isEmpty():
                break
            base = BAND * (len(self.bands) - 1)
            nodes = foot.where("size > 1").groupBy("group", run_of(F.col("place")).alias("run")).applyInPandas(banded(base), NODE)
            store = scratch.table(nodes, f"{name}-levels-{base}", by="level")
            self.bands.append(store.where(F.col("level") == base + BAND).select("group", "place", "size", "digest"))
            self.roots = self.roots.unionByName(store.where("size = 1").select("group", "digest"))

    def proofs(self, rows: DataFrame, root_proofs: DataFrame, make, schema: str) -> DataFrame:
        """make(run, siblings above) for the runs of leaves.

        rows: the leaves with what `make` needs; root_proofs: (group, proof), what stands above each
        group's root, written as siblings() does.
        """
        known = root_proofs.select("group", F.lit(0).cast("long").alias("run"), "proof")
        for band in range(len(self.bands) - 1, 0, -1):
            foot = self.bands[band]
            handed = known.groupBy("group", "run").cogroup(foot.groupBy("group", run_of(F.col("place")).alias("run"))).applyInPandas(hand_down, "group long, run long, proof string")
            known = self.scratch.table(handed, f"{self.name}-proofs")
        keyed = rows.groupBy("group", run_of(F.col("place")).alias("run"))
        return known.groupBy("group", "run").cogroup(keyed).applyInPandas(make, schema)


def siblings(digests: list[str], size: int, start: int) -> list[str]:
    """For each node of a run the siblings within the band, each written as its side and digest (a dash for none), from the node upwards."""
    out: list[str] = [""] * len(digests)
    levels = [(digests, size, start), *above(digests, size, start)]
    for step, (nodes, width, first) in enumerate(levels[:BAND]):
        if width <= 1:
            break
        for k in range(len(digests)):
            other = ((start + k) >> step) ^ 1
            out[k] += ("L" if other < ((start + k) >> step) else "R") + nodes[other - first] if other < width else "-"
    return out


def hand_down(known: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
    """The proofs of a run's nodes as those of the runs below them; a group that isn't as high as this band keeps its own."""
    if not len(run):
        return known[["group", "run", "proof"]]
    run = run.sort_values("place")
    mine = siblings(run["digest"].tolist(), int(run["size"].iloc[0]), int(run["place"].iloc[0]))
    return pd.DataFrame({"group": run["group"].to_numpy(), "run": run["place"].to_numpy(), "proof": [p + known["proof"].iloc[0] for p in mine]})


STEP = re.compile(r"-|[LR][0-9a-f]{64}")


def folded(node: str, proof: str) -> str:
    """The root that follows from a node and its siblings."""
    for step in STEP.findall(proof):
        node = digest(step[1:] + node if step[0] == "L" else node + step[1:])
    return node


def plain(proof: str) -> str:
    """The siblings' digests without their sides."""
    return "".join(step[1:] for step in STEP.findall(proof))


PROVEN = "name string, group long, place long, leaf string, proof string, proof_sha256 string, folded_root string"


def proven(known: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
    if not len(run):  # an empty table
        return pd.DataFrame(columns=[f.split()[0] for f in PROVEN.split(", ")], dtype=object)
    run = run.sort_values("place")
    mine = siblings(run["digest"].tolist(), int(run["size"].iloc[0]), int(run["place"].iloc[0]))
    proofs = [p + known["proof"].iloc[0] for p in mine]
    return pd.DataFrame({
        "name": run["name"], "group": run["group"], "place": run["place"], "leaf": run["digest"], "proof": proofs,
        "proof_sha256": [digest(plain(p)) for p in proofs], "folded_root": [folded(c if c else d, p) for c, d, p in zip(run["changed"], run["digest"], proofs, strict=True)]})


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, place, proof, proof_sha256, folded_root, verified) for each row.

    tampered: a condition on docs; such a row's root is folded from a leaf with 1 added to n_chars.
    proof: the siblings from the leaf up to the root, each as its side (L or R) and its digest, a dash at levels where a node stands alone.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    own = {n: F.col(n) for n in FIELDS}
    changed = F.when(tampered, leaf(own | {"n_chars": F.col("n_chars") + 1})) if tampered is not None else F.lit(None).cast("string")
    # Repeated rows are told apart by a number, so that they need not lie in one range.
    rows = scratch.table(docs.select("doc_id", "lang", leaf(own).alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("tie")), "rows")
    langs = scratch.table(rows.select("lang").distinct().withColumn("all", F.lit(0).cast("long")), "names")
    groups = placed(langs, "all", [F.col("lang").cast("binary").asc_nulls_first()], scratch, "langs")
    groups, few = small_side(scratch, groups.select(F.col("lang").alias("g_lang"), F.col("place").alias("group"), F.col("size").alias("groups")), "groups")
    named = rows.join(F.broadcast(groups) if few else groups, F.col("lang").eqNullSafe(F.col("g_lang"))).select("group", "doc_id", "digest", "changed", "tie")
    leaves = placed(named, "group", [F.col("group").asc(), F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("tie").asc()], scratch, "leaves")
    leaves = scratch.table(leaves.drop("tie").withColumnRenamed("doc_id", "name").withColumn("name", F.col("name").cast("string")), "leaves")
    scratch.drop("rows", "leaves-sorted")
    tree = Tree(leaves, scratch, "tree")
    subroots = scratch.table(tree.roots.join(groups.drop("g_lang"), "group").withColumnRenamed("digest", "subroot"), "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("place"), F.col("groups").alias("size"), F.col("subroot").alias("digest"), F.col("group").cast("string").alias("name"), F.lit(None).cast("string").alias("changed"))
    top = Tree(tops, scratch, "top")
    nothing = docs.sparkSession.createDataFrame([(0, "")], "group long, proof string")
    over = top.proofs(tops, nothing, proven, PROVEN).select(F.col("name").cast("long").alias("group"), "proof")
    found = tree.proofs(leaves, scratch.table(over, "over"), proven, PROVEN)
    subroots = subroots.select("group", "subroot")
    found = found.join(F.broadcast(subroots) if few else subroots, "group").crossJoin(F.broadcast(top.roots.select(F.col("digest").alias("root"))))  # one row
    kind = dict(docs.dtypes)["doc_id"]
    return found.select(F.col("name").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "place", "proof", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
