"""Near-duplicate documents by 64-bit SimHash fingerprints and deletion-variant signatures.

Two fingerprints within 3 bits, cut into two halves of 32 bits, have a half in which they differ
by at most one bit. So each half is indexed once as it is and once for each of its set bits with
that bit deleted (written as zero); a half that lacks the bit finds the other by plain equality.
Each pair whose halves are equal meets in one exact entry, each pair whose halves differ in one
bit in one variant entry; the join then verifies the whole distance, so that only true links
leave it. A half that very many fingerprints share is dealt on by the other half in the same way.
Exact copies share a fingerprint and are one row from the first aggregation on.

Defined results: a null or empty text has no shingle, fingerprint zero, and is linked like any
other; a null doc_id stays a row, and component_id is null only where no doc_id is reachable; repeated rows stay repeated; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, components, small_side

SEED = 42
HALF = (1 << 32) - 1


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_long(text) -> F.Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return F.pandas_udf(of, "long")(text)


def cut_variants(part: Column, width: int) -> Column:
    """(key, cut) of a part of so many bits: itself, and for each of its set bits the part without it."""
    one = F.lit(1).cast("long")
    deleted = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(part, i) == 1),
        lambda i: F.struct(part.bitwiseXOR(F.call_function("shiftleft", one, i)).alias("key"), F.lit(True).alias("cut")),
    )
    return F.concat(F.array(F.struct(part.alias("key"), F.lit(False).alias("cut"))), deleted)


def parts_of(value: Column, width: int) -> Column:
    """Both parts of so many bits."""
    return F.array(*[F.struct(F.lit(k).alias("side"), F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("part")) for k in (0, 1)])


def links(prints: DataFrame, bits: int = 3, scratch: Scratch | None = None, full: int = 256) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints (column fp) that differ in 1 to `bits` <= 3 bits; a pair can come more than once.

    A half that more than `full` fingerprints share is dealt on: pairs that meet in it differ by
    at most 3 bits in the other half, so in one of that half's quarters by at most one bit, and
    the quarters are indexed and met in the same way.
    """
    if not 0 < bits <= 3:
        raise ValueError("two halves serve distances up to 3")
    scratch = scratch or Scratch(prints.sparkSession, "simhash")
    halves = prints.select("fp", F.explode(parts_of(F.col("fp"), 32)).alias("s")).select("fp", "s.side", F.col("s.part").alias("half"))
    index = halves.select("side", F.col("fp").alias("a"), F.explode(cut_variants(F.col("half"), 32)).alias("k")).select("side", "a", "k.key", "k.cut")
    probe = halves.select("side", F.col("fp").alias("b"), F.col("half").alias("key"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & (F.col("cut") | (F.col("a") < F.col("b")))
    crowded = probe.groupBy("side", "key").agg(F.count("*").alias("n")).where(F.col("n") > full).select("side", "key")
    crowded, few = small_side(scratch, crowded, "crowded")
    if crowded.isEmpty():
        return index.join(probe, ["side", "key"]).where(near).select("a", "b")
    crowded = F.broadcast(crowded) if few else crowded
    found = index.join(probe.join(crowded, ["side", "key"], "left_anti"), ["side", "key"]).where(near).select("a", "b")

    def quarters(df: DataFrame, fp: str) -> DataFrame:
        """The members of crowded halves with both quarters of their other half."""
        other = F.when(F.col("side") == 0, F.shiftrightunsigned(fp, 32)).otherwise(F.col(fp).bitwiseAND(F.lit(HALF)))
        return df.join(crowded, ["side", "key"], "left_semi").withColumn("q", F.explode(parts_of(other, 16))).withColumns({"quarter": F.col("q.side"), "part": F.col("q.part")}).drop("q")

    def variants(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.explode(cut_variants(F.col("part"), 16))).withColumns({"deep": F.col("v.key"), "cut_deep": F.col("v.cut")}).drop("v", "part")

    # In a quarter either of the two may be the one that has the bit more.
    ours, theirs = quarters(index, "a"), quarters(probe, "b")
    on = ["side", "key", "quarter", "deep"]
    more = variants(ours).join(theirs.withColumnRenamed("part", "deep"), on).where(near).select("a", "b")
    less = ours.withColumnRenamed("part", "deep").join(variants(theirs).where("cut_deep"), on).where(near).select("a", "b")
    return found.unionByName(more).unionByName(less)


def classes(rows: DataFrame, scratch: Scratch, bits: int = 3) -> DataFrame:
    """(fp, root, least) for each distinct fingerprint of rows (doc_id, fp): its component and its least doc_id."""
    prints = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    linked = components(links(prints, bits, scratch), scratch).withColumnRenamed("node", "fp")
    return scratch.table(prints.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")


def near_duplicates(docs: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links, for each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(docs.select("doc_id", fingerprint_long("text").alias("fp")), "rows")
    found = classes(rows, scratch, bits)
    best = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(found.join(best, "root"), "fp").select("doc_id", "fp", "component_id")


def hashed_rows(docs: DataFrame) -> F.Column:
    return F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def keep_first(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of docs for each root of rows (doc_id, row_hash, root): that of the least doc_id (a null one last), then of the least row hash.

    rows: one for each row of docs, as a table. The texts meet the keys of the rows that go, and
    stay in place where these keys are few enough to be broadcast.
    """
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_hash"))
    keys = rows.groupBy("doc_id", "row_hash").agg(F.first("root").alias("root"), F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(rank).alias("rank")).select("root", F.col("rank.doc_id").alias("f_id"), F.col("rank.row_hash").alias("f_hash"))
    keys = keys.join(first, "root").select("doc_id", "row_hash", "n", (F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("row_hash") == F.col("f_hash"))).alias("stays"))
    keys = keys.where("NOT stays OR n > 1").select(F.col("doc_id").alias("k_id"), F.col("row_hash").alias("k_hash"), "stays")
    keys, small = small_side(scratch, keys, "keys", 500_000)
    hashed = docs.withColumn("voxloom_row_hash", hashed_rows(docs))
    of = lambda some: (F.broadcast(some) if small else some, (F.col("voxloom_row_hash") == F.col("k_hash")) & F.col("doc_id").eqNullSafe(F.col("k_id")))
    alone = hashed.join(*of(keys), "left_anti")
    repeated = keys.where("stays")
    if not repeated.isEmpty():  # rows that stay, and stand there more than once
        alone = alone.unionByName(hashed.join(*of(repeated), "left_semi").dropDuplicates(["voxloom_row_hash", "doc_id"]))
    return alone.select(*docs.columns)


def keep_one(docs: DataFrame, bits: int = 3) -> DataFrame:
    """One row of docs for each component of the links of up to so many bits."""
    scratch = Scratch(docs.sparkSession, "keep")
    rows = scratch.table(docs.select("doc_id", hashed_rows(docs).alias("row_hash"), fingerprint_long("text").alias("fp")), "rows")
    rows = scratch.table(rows.join(classes(rows, scratch, bits).select("fp", "root"), "fp").select("doc_id", "row_hash", "root"), "roots")
    return keep_first(docs, rows, scratch)
