"""Near-duplicate documents by Jaccard similarity of word shingles, through wide SimHash fingerprints.

A fingerprint of 512 bits is drawn from a document's distinct shingles. As similarity s means an
angle of arccos(2 s / (1 + s)) between the sets of two documents of one size, each bit differs
with a known chance, 0.15 at s = 0.8. Each of several tables takes a segment of the fingerprint
and indexes it as it is and once for each of its set bits with that bit deleted, so that equality
joins find documents whose segments differ by one bit (or by one bit each). A segment has a few
bits more than the documents' number has, and there are as many tables as the wanted recall at
the least similarity takes, so both follow from the number of documents.

That chance holds for sets of many shingles. Documents of few shingles meet exactly instead: of two
that are similar enough each has, among its rarest shingles, one of the other's (their number follows
from the similarity), so these shingles are their keys. What is rare is said by one order of all
shingles, the most frequent ones last; any order finds the same pairs.

What meets is verified: the whole fingerprint settles clear cases, and pairs within its margin of
error whose documents aren't in one class yet are compared shingle by shingle. In keys of many
documents all meet the key's first document, and then only documents that are in different
classes meet, by a fingerprint four times as wide, so that a group of copies doesn't come out in
all its pairs, and no link between classes is left out. Of a group whose documents are just not
similar enough all pairs within that fingerprint's margin are compared.

Defined results: texts without a word are alike, and equal to each other; texts of fewer words
than a shingle are one shingle; rows with equal fingerprints are one class; a null doc_id stays a
row; repeated rows are one class.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, components, small_side
from voxloom.llm.simhash import SEED, hashed_rows, keep_first

WORDS = 8
BITS = 64 * WORDS
#: Words of the fingerprints that are compared in full keys.
FINE = 4 * WORDS
#: Bits of a node's number within a member of a key.
CUT = 56
#: Documents of at most so many distinct shingles have their rarest shingles as keys.
SHORT = 80
#: So many of the most frequent shingles come last in the order of shingles.
FREQUENT = 100_000
#: A key of more documents than this is full: its documents meet the first of them, and later those of other classes.
FULL = 8
#: While there are more than so many pairs a node to compare, the most promising ones are first.
CROWDED = 2


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted; A-Z are lower-cased, words are cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    some = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in some], dtype=np.uint64))


def spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_print(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Of each bit of so many further hashes, whether more than half of the shingles have it; as numbers."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255):  # sums of 255 bits fit in a byte
        part = h[at : at + 255]
        rows = np.stack([spread(part, k) for k in range(words)], 1).view(np.uint8)
        ones += np.add.reduce(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)


def differing(similarity: float) -> float:
    """The chance that a bit differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@functools.cache
def differing_in_short(similarity: float, most: int = SHORT) -> float:
    """The greatest chance that a bit differs, over all sizes of sets of which the smaller has at most so many shingles."""

    def heads(n: int) -> np.ndarray:  # chances of 0 to n set bits
        return np.array([math.comb(n, k) for k in range(n + 1)]) / 2**n

    def majority(own: int, size: int, common: int) -> np.ndarray:  # of `size` shingles, for each number of common bits
        tail = np.append(np.cumsum(heads(own)[::-1])[::-1], 0.0)
        return tail[np.clip(size // 2 + 1 - np.arange(common + 1), 0, own + 1)]

    greatest = 0.0
    for n in range(1, most + 1):
        for m in range(n, int(n / similarity + 1e-9) + 1):
            common = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            a, b = majority(n - common, n, common), majority(m - common, m, common)
            greatest = max(greatest, float((heads(common) * (a + b - 2 * a * b)).sum()))
    return greatest


def share_of_tables(bits: int, p: float) -> float:
    """The chance that two segments meet: none differs, one does, or two of which each document has one."""
    return (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1) + bits * (bits - 1) / 4 * p**2 * (1 - p) ** (bits - 2)


def segments(documents: int, similarity: float, recall: float) -> list[list[int]]:
    """The bits of each table's segment."""
    bits = max(16, int(documents).bit_length() + 6)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - share_of_tables(bits, differing(similarity))))
    r = np.random.default_rng(21)
    order = np.concatenate([r.permutation(BITS) for _ in range(-(-tables * bits // BITS))])
    return [sorted(order[k * bits : (k + 1) * bits].tolist()) for k in range(tables)]


def entries(prints: DataFrame, cut: list[list[int]]) -> DataFrame:
    """(key, member): of each table the segment itself and its deletion variants. member: the node, and above it 1 + the deleted bit, or 0."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node = batch["node"].to_numpy()
            for at in range(0, len(node), 2048):
                some = np.stack([np.asarray(x, np.int64) for x in batch["print"].iloc[at : at + 2048]])
                bits = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").astype(bool)
                keys, nodes = [], []
                for t, places in enumerate(cut):
                    mine = bits[:, places]
                    value = (mine.astype(np.uint64) << np.arange(len(places), dtype=np.uint64)).sum(1, dtype=np.uint64)
                    row, place = np.nonzero(mine)
                    every = np.concatenate([value, value[row] ^ (np.uint64(1) << place.astype(np.uint64))])
                    keys.append(np.uint64(t << len(places)) | every)  # plain numbers, as their leading zeros are shuffled for nothing
                    nodes.append(np.concatenate([node[at : at + 2048], node[at : at + 2048][row] | (place + 1) << CUT]))
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "member": np.concatenate(nodes)})

    return prints.select("node", "print").mapInPandas(of, "key long, member long")


def prefixes(prints: DataFrame, similarity: float, frequent: list[int]) -> DataFrame:
    """(key, member): of each node (node, shingles) the rarest shingles, one of which any similar document has among its own.

    frequent: shingles by falling frequency. Keys are negative, those of segments aren't.
    """
    known = np.array(frequent, np.int64)
    place = np.argsort(known)
    known, rank = known[place], len(known) - place

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for node, shingles in zip(batch["node"], batch["shingles"], strict=True):
                h = np.asarray(shingles, np.int64)
                at = np.searchsorted(known, h)
                late = np.zeros(len(h), np.int64)
                found = at < len(known)
                found[found] = known[at[found]] == h[found]
                late[found] = rank[at[found]]
                h = h[np.lexsort((h, late))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
                keys.append(~(h.view(np.uint64) >> np.uint64(1)).view(np.int64))
                nodes.append(np.full(len(h), node, np.int64))
            yield pd.DataFrame({"key": np.concatenate(keys), "member": np.concatenate(nodes)})

    return prints.select("node", "shingles").mapInPandas(of, "key long, member long")


def node_of(member: Column) -> Column:
    return member.bitwiseAND(F.lit((1 << CUT) - 1))


def cut_of(member: Column) -> Column:
    return F.shiftright(member, CUT)


def alike(x: Column, y: Column) -> Column:
    """Whether two members of a key have the same bit deleted: then their segments are equal, and meet as they are, too."""
    return (cut_of(x) == cut_of(y)) & (cut_of(x) > 0)


def apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def promising(pairs: DataFrame) -> DataFrame:
    """Of each class's pairs (a, b, d, ra, rb) the one with the least distance and the one with the least other class."""
    own = pairs.select("*", F.col("ra").alias("of"), F.col("rb").alias("other")).unionByName(pairs.select("*", F.col("rb").alias("of"), F.col("ra").alias("other")))
    best = own.groupBy("of").agg(F.min_by(F.struct("a", "b", "ra", "rb"), F.struct("d", "other", "a", "b")).alias("x"), F.min_by(F.struct("a", "b", "ra", "rb"), F.struct("other", "d", "a", "b")).alias("y"))
    return best.select(F.explode(F.array("x", "y")).alias("one")).select("one.*").distinct()


def margin(p: float, bits: int, deviations: float) -> int:
    """How many of so many bits differ at most, but for so many standard deviations."""
    return int(p * bits + deviations * math.sqrt(p * (1 - p) * bits))


class Finder:
    """The classes of documents whose shingles have at least `similarity`."""

    def __init__(self, docs: DataFrame, width: int, similarity: float, recall: float, scratch: Scratch):
        self.docs, self.width, self.similarity, self.recall, self.scratch = docs, width, similarity, recall, scratch
        self.p = differing(similarity)

    def reach(self, short: Column, bits: int) -> Column:
        """How many bits differ at most; of short documents no pair is left out before it is compared."""
        return F.when(short, margin(differing_in_short(self.similarity), bits, 6)).otherwise(margin(self.p, bits, 3))

    def sketches(self) -> DataFrame:
        """(doc_id, row_hash, print, shingles): the shingles of short documents, else null."""
        width = self.width

        def of(texts: pd.Series) -> pd.DataFrame:
            sets = [shingle_hashes(t, width) for t in texts]
            return pd.DataFrame({"print": [wide_print(h) for h in sets], "shingles": [h.view(np.int64) if len(h) <= SHORT else None for h in sets]})

        made = F.pandas_udf(of, "print array<long>, shingles array<long>")("text")
        return self.docs.select("doc_id", hashed_rows(self.docs).alias("row_hash"), made.alias("made")).select("doc_id", "row_hash", "made.*")

    def entries(self) -> DataFrame:
        """(key, member) of all nodes: segments of documents with many shingles, the rarest shingles of short ones.

        The sizes overlap, so that any two similar documents have keys of one kind.
        """
        short = self.prints.where("shingles IS NOT NULL").select("node", "shingles")
        long = self.prints.where(F.col("shingles").isNull() | (F.size("shingles") > int(self.similarity * SHORT)))
        counts = short.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(f"n > {FULL}")
        frequent = [r.s for r in counts.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()]
        return entries(long, segments(long.count(), self.similarity, self.recall)).unionByName(prefixes(short, self.similarity, frequent))

    def met(self) -> DataFrame:
        """Of keys up to FULL nodes their pairs (a, b) without a key, of fuller ones (key, first node a, node b, member).

        short: the key is a shingle.
        One shuffle by key serves all of it. A key in which all have the same bit deleted says no more than their whole segment.
        """
        every = self.entries().repartition("key")
        shared = every.groupBy("key").agg(F.count("*").alias("n"), F.min("member").alias("first"), F.max(cut_of(F.col("member"))).alias("last_cut"))
        shared = shared.where((F.col("n") > 1) & ((F.col("last_cut") == 0) | (cut_of(F.col("first")) < F.col("last_cut")))).drop("last_cut")
        held = every.join(shared, "key")
        few = held.where(f"n <= {FULL}").groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("all"))
        pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.filter(F.slice("all", i + 2, FULL), lambda y: ~alike(x, y)), lambda y: F.struct(F.least(node_of(x), node_of(y)).alias("a"), F.greatest(node_of(x), node_of(y)).alias("b")))))
        none = F.lit(None).cast("long")
        short = (F.col("key") < 0).alias("short")
        few = few.select(short, F.explode(pairs).alias("p")).select(none.alias("key"), "p.a", "p.b", none.alias("member"), "short")
        full = held.where(f"n > {FULL}").select("key", node_of(F.col("first")).alias("a"), node_of(F.col("member")).alias("b"), "member", short)
        return self.scratch.table(few.unionByName(full), "met")

    def within(self, pairs: DataFrame, prints: DataFrame, bits: int) -> DataFrame:
        """Pairs (a, b, short) of nodes with the distance d of their prints (node, print) of so many bits, those out of reach left out."""
        side = lambda node, fp: prints.select(F.col("node").alias(node), F.col("print").alias(fp))
        both = pairs.join(side("a", "of_a"), "a").join(side("b", "of_b"), "b")
        return both.select("a", "b", "short", apart("of_a", "of_b").alias("d")).where(F.col("d") <= self.reach(F.col("short"), bits))

    def classes(self, links: DataFrame) -> DataFrame:
        linked = components(links, self.scratch).withColumnRenamed("node", "n")
        return self.scratch.table(self.prints.select("node").join(linked, F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("root")), "classes")

    def across(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of the pairs those whose nodes are in different classes, with the classes ra and rb."""
        side = lambda node, root: classes.select(F.col("node").alias(node), F.col("root").alias(root))
        return pairs.drop("ra", "rb").join(side("a", "ra"), "a").join(side("b", "rb"), "b").where("ra <> rb")

    def merged(self, links: DataFrame, classes: DataFrame) -> DataFrame:
        """The classes with what the links (ra, rb) between them make one. Only these classes are nodes there, and each two of them one link."""
        linked = components(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), self.scratch)
        linked = linked.select(F.col("node").alias("root"), F.col("root").alias("whole"))
        return self.scratch.table(classes.join(linked, "root", "left").select("node", F.coalesce("whole", "root").alias("root")), "classes")

    def from_texts(self, nodes: DataFrame, make, kind: str, name: str) -> DataFrame:
        """(node, made): what `make` makes of the shingles of each node's document."""
        wanted = self.prints.join(nodes.distinct(), "node").select("node", F.col("one.doc_id").alias("w_id"), F.col("one.row_hash").alias("w_hash"))
        wanted, small = small_side(self.scratch, wanted, f"{name}-wanted", 500_000)
        width = self.width

        def of(texts: pd.Series) -> pd.Series:
            return pd.Series([make(shingle_hashes(t, width)) for t in texts])

        same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row_hash") == F.col("w_hash"))
        texts = self.docs.select("doc_id", "text", hashed_rows(self.docs).alias("row_hash")).join(F.broadcast(wanted) if small else wanted, same)
        # Rows that repeat each other make the same.
        return self.scratch.table(texts.select("node", F.pandas_udf(of, kind)("text").alias("made")).dropDuplicates(["node"]), name)

    def compared(self, pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """The classes with what those pairs (a, b, d) link whose documents have the similarity, shingle by shingle.

        In a group of near copies nearly all pairs are near. While pairs are many times their nodes, each node's
        most promising ones are compared first: what they make one class needs no further comparison, and the links
        of a round are no more than twice the nodes. A round that links few is the last of these, and then all pairs
        that are still between classes are compared.
        """
        pairs = self.scratch.table(self.across(pairs, classes).select("a", "b", "d", "ra", "rb"), f"{name}-unsure")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        # Half a hash tells one shingle from the few thousand of another document.
        sets = self.from_texts(nodes, lambda h: (h >> np.uint64(32)).astype(np.uint32).view(np.int32), "array<int>", f"{name}-sets")
        held, crowded = sets.count(), True
        while count := pairs.count():
            crowded = crowded and count > CROWDED * held
            some = promising(pairs) if crowded else pairs
            links = self.scratch.table(self.similar(some, sets), f"{name}-links")
            if found := links.count():
                classes = self.merged(links, classes)
            if not crowded:
                break
            crowded = 10 * found >= held  # else what is left is mostly not similar
            pairs = self.scratch.table(self.across(pairs.join(some, ["a", "b"], "left_anti"), classes), f"{name}-left")
        return classes

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, ra, rb) whose sets of shingles have the similarity."""
        side = lambda node, of: sets.select(F.col("node").alias(node), F.col("made").alias(of))
        both = pairs.join(side("a", "of_a"), "a").join(side("b", "of_b"), "b")
        common = F.size(F.array_intersect("of_a", "of_b"))
        union = F.size("of_a") + F.size("of_b") - common
        return both.where(common >= F.lit(self.similarity) * union).select("a", "b", "ra", "rb")

    def linked(self, near: DataFrame, bits: int, classes: DataFrame | None, name: str) -> DataFrame:
        """The classes with what the near pairs add: the clear ones first, then those that a comparison confirms."""
        tight = ~F.col("short") & (F.col("d") <= margin(self.p, bits, -3))
        sure = self.scratch.table(near.where(tight).select("a", "b"), f"{name}-sure")
        if classes is None:
            classes = self.classes(sure)
        elif not sure.isEmpty():
            classes = self.merged(self.across(sure, classes), classes)
        return self.compared(near.where(~tight), classes, name)

    def roots(self) -> DataFrame:
        """(doc_id, row_hash, root) for each row of docs."""
        scratch = self.scratch
        rows = scratch.table(self.sketches(), "rows")
        prints = rows.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_hash", "shingles")).alias("one"))
        prints = prints.select("print", F.col("one").dropFields("shingles").alias("one"), "one.shingles")
        # The numbers are written with the table, and so stay the same.
        self.prints = prints = scratch.table(prints.withColumn("node", F.monotonically_increasing_id()), "prints")
        met = self.met()
        # A quarter of the fingerprint sorts most pairs out that met by chance, before all of it is shuffled.
        # A pair that met in many keys is one before that: by a's partitions, which the join with a needs anyway.
        pairs = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "short").repartition("a").groupBy("a", "b").agg(F.max("short").alias("short"))
        pairs = self.within(pairs, prints.select("node", F.slice("print", 1, 2).alias("print")), 128).select("a", "b", "short")
        near = scratch.table(self.within(pairs, prints, BITS), "near")
        classes = self.linked(near, BITS, None, "first")
        full = met.where("key IS NOT NULL").select("key", F.col("b").alias("node"), "member")
        if not full.isEmpty():
            # Of two classes in a key at least one isn't its greatest; two lesser ones meet once, in the order of nodes.
            # A node has no more keys than it has entries, so what belongs to a node is joined to one row for all of them.
            held = full.groupBy("node").agg(F.collect_list(F.struct("key", "member")).alias("keys")).join(classes, "node").select("node", "root", F.inline("keys"))
            keys = held.groupBy("key").agg(F.mode("root", True).alias("main"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "main")
            held = scratch.table(held.join(keys, "key").withColumn("minor", F.col("root") != F.col("main")).drop("main"), "held")
            fine = self.from_texts(held.select("node"), lambda h: wide_print(h, FINE), "array<long>", "fine")
            held = held.groupBy("node", "root").agg(F.collect_list(F.struct("key", "member", "minor")).alias("keys")).join(fine, "node").select("node", "root", "made", F.inline("keys"))
            p, q = held.where("minor").alias("p"), held.alias("q")
            once = (~F.col("q.minor") | (F.col("p.node") < F.col("q.node"))) & ~alike(F.col("p.member"), F.col("q.member"))
            reach = self.reach(F.col("p.key") < 0, 64 * FINE)
            rest = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.root") != F.col("q.root")) & once & (apart("p.made", "q.made") <= reach))
            rest = rest.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"), (F.col("p.key") < 0).alias("short"), apart("p.made", "q.made").alias("d"))
            rest = rest.groupBy("a", "b", "d").agg(F.max("short").alias("short"))
            classes = self.linked(scratch.table(rest, "rest"), 64 * FINE, classes, "last")
        return scratch.table(rows.join(prints.select("print", "node"), "print").join(classes, "node").select("doc_id", "row_hash", "root"), "roots")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One row of docs for each class of rows whose shingles of so many words have at least the similarity.

    recall: the chance that two documents of just this similarity meet in some table; more similar
    ones meet more often, and those of a class need only be linked through each other.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    return keep_first(docs, Finder(docs, width, similarity, recall, scratch).roots(), scratch)
