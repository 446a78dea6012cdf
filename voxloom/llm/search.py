"""Ranked lexical search by trees of greatest impacts over ranges of documents.

The queries are a stated set, taken in blocks of a bounded size. For a block, each task reads its
documents once and cuts them into segments, ranges of a bounded number of documents and postings;
a segment is one row of a table: its documents' ids and lengths, and the occurrences of the
block's terms. Document frequencies, numbers and lengths of all documents are sums over these
rows. From them follows what each occurrence adds to a score, and for each term of a segment a
tree of maxima: over single documents, then ranges of 16, 256 and so on up to the segment.

A range's bound for a query is the sum of its terms' maxima, and no document in it scores more.
The search is branch and bound, best first: of all segments the one of the highest bound is
opened for each query, its k-th score is what others have to reach, and then every segment whose
bound reaches it is searched. Within a segment a heap yields the open range of the highest bound,
which is split into the ranges below; of equal bounds ranges come before documents, and documents
in the order of their ids, so that ties are settled as if all scores were known. No range is left
out that could hold a result, whatever number of documents share a score.

Defined results: texts that are null or have no term are no documents (they count nowhere), items
without terms have no results; terms of an item count once; a null doc_id is last among equals;
repeated documents each have their rank, repeated items each have their results; other columns
are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch

#: A term is a run of ASCII letters and digits and of all that isn't ASCII; a byte that is none of these separates.
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
FOLD = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))
#: Documents and postings of a segment; the ranges of a tree hold FAN of those below.
DOCUMENTS, POSTINGS, FAN = 4096, 1 << 20, 16
#: Bytes of a block of queries.
BLOCK = 2 << 20
SEGMENT = "segment long, ids array<long>, named array<boolean>, lengths array<long>, terms array<int>, ends array<int>, docs array<int>, counts array<int>, n long, total long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def cut_segments(words: dict[bytes, int], most_documents: int, most_postings: int) -> Callable:
    """A function from documents (doc_id, text) to segments: postings of the given words, by term, then by document."""

    def rows(held: list) -> pa.RecordBatch:
        ids, lengths, found = zip(*held, strict=True)
        doc = np.repeat(np.arange(len(held)), [len(f) for f in found])
        pairs = np.array([p for f in found for p in f.items()], np.int64).reshape(-1, 2)
        order = np.lexsort((doc, pairs[:, 0]))
        terms, ends = np.unique(pairs[order, 0], return_counts=True)
        one = lambda a, kind: pa.array([np.asarray(a)], pa.list_(kind))
        return pa.RecordBatch.from_arrays([
            pa.array([0], pa.int64()), one([i if i is not None else 0 for i in ids], pa.int64()), one(np.array([i is not None for i in ids]), pa.bool_()), one(lengths, pa.int64()), one(terms.astype(np.int32), pa.int32()), one(np.cumsum(ends).astype(np.int32), pa.int32()),
            one(doc[order].astype(np.int32), pa.int32()), one(pairs[order, 1].astype(np.int32), pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())],
            names=[f.split()[0] for f in SEGMENT.split(", ")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        postings = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    terms = terms_of(text)
                    if not terms:
                        continue
                    found = Counter(t for t in map(words.get, terms) if t is not None)
                    held.append((doc, len(terms), found))
                    postings += len(found)
                    if len(held) >= most_documents or postings >= most_postings:
                        yield rows(held)
                        held, postings = [], 0
        if held:
            yield rows(held)

    return of


class Segment:
    """A segment's trees: for each level sorted keys (term, range) with the greatest impact of a document in the range."""

    def __init__(self, row: dict, weights: np.ndarray, average: tuple[int, int]):
        self.ids, self.named = np.asarray(row["ids"], np.int64), np.asarray(row["named"], bool)
        n, total = average
        spans = np.diff(np.asarray(row["ends"], np.int64), prepend=0)
        terms, docs, tf = np.repeat(np.asarray(row["terms"], np.int64), spans), np.asarray(row["docs"], np.int64), np.asarray(row["counts"], np.int64)
        m = np.array([10 + 90 * x * n // total for x in np.asarray(row["lengths"]).tolist()], np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])) if len(docs) else np.zeros(0, np.int64)
        self.levels, self.widths = [], []
        width = len(self.ids)
        while True:
            self.levels.append((terms * width + docs, impact))
            self.widths.append(width)
            if width <= 1:
                break
            width, docs = -(-width // FAN), docs // FAN
            key = terms * width + docs
            new = np.flatnonzero(np.diff(key, prepend=-1))
            impact = np.maximum.reduceat(impact, new) if len(new) else impact
            terms, docs = terms[new], docs[new]

    def bound(self, terms: np.ndarray) -> int:
        """Of the whole segment, for a query's terms."""
        return int(self.below(len(self.levels), 0, terms)[1].sum())

    def below(self, level: int, node: int, terms: np.ndarray) -> tuple[int, np.ndarray]:
        """(first, bounds) of the ranges that a range is split into, from its level to the one below."""
        keys, values = self.levels[level - 1]
        width, low = self.widths[level - 1], node * FAN
        high = min(width, low + FAN)
        a, b = np.searchsorted(keys, terms * width + low), np.searchsorted(keys, terms * width + high)
        size = b - a
        at = np.arange(size.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        bounds = np.zeros(high - low, np.int64)
        np.add.at(bounds, keys[at] - np.repeat(terms * width + low, size), values[at])
        return low, bounds

    def best(self, terms: np.ndarray, k: int, least: int) -> list[tuple[int, bool, int]]:
        """The k best (score, whether the id isn't null, id) with a score of `least` or more, which is above 0."""
        heap: list[tuple] = [(-self.bound(terms), 0, 0, 0, len(self.levels), 0)]
        out: list[tuple[int, bool, int]] = []
        while heap and len(out) < k and -heap[0][0] >= least:
            bound, document, _, doc, level, node = heapq.heappop(heap)
            if document:
                out.append((-bound, bool(self.named[node]), int(doc)))
                continue
            low, bounds = self.below(level, node, terms)
            for child in np.flatnonzero(bounds >= least).tolist():
                if level == 1:
                    d = low + child
                    heapq.heappush(heap, (-int(bounds[child]), 1, int(not self.named[d]), int(self.ids[d]), 0, d))
                else:
                    heapq.heappush(heap, (-int(bounds[child]), 0, 0, 0, level - 1, low + child))
        return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: c[k].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[k].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}


def bounds_of(queries: list[np.ndarray], weights: np.ndarray, average: tuple[int, int]) -> Callable:
    """A function from segments to (query, segment, bound), for each query the task's segment of the highest bound."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(0, 0)] * len(queries)
        for row in rows_of(batches):
            segment = Segment(row, weights, average)
            best = [max(b, (segment.bound(q), row["segment"])) for b, q in zip(best, queries, strict=True)]
        some = [(k, *b) for k, b in enumerate(best) if b[0] > 0]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in some], pa.int64()) for n, i in (("query", 0), ("segment", 2), ("bound", 1))})

    return of


def searched(queries: list[np.ndarray], weights: np.ndarray, average: tuple[int, int], k: int, least: list[int], only: dict[int, list[int]] | None = None) -> Callable:
    """A function from segments to (query, score, named, doc_id), the k best of each segment for each query; only: the queries of a segment."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            segment = Segment(row, weights, average)
            some = [(q, *hit) for q in (range(len(queries)) if only is None else only[row["segment"]]) for hit in segment.best(queries[q], k, max(1, least[q]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["query", "score", "named", "doc_id"])

    return of


HITS = "query long, score long, named boolean, doc_id long"


def block_results(docs: DataFrame, texts: list[bytes | None], k: int, scratch: Scratch, most_documents: int, most_postings: int) -> DataFrame | None:
    """(query, rank, doc_id, score) for the queries of one block, by their number; None without a document."""
    each = [sorted(set(terms_of(t))) for t in texts]
    words = {w: n for n, w in enumerate(sorted(set().union(*each)))}
    segments = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_segments(words, most_documents, most_postings), SEGMENT)
    segments = scratch.table(segments.withColumn("segment", F.monotonically_increasing_id()), "segments")
    n, total = segments.agg(F.sum("n"), F.sum("total")).first()
    if not n or not words:
        return None
    # A term's documents in a segment lie between two ends.
    frequency = segments.select(F.explode(F.arrays_zip("terms", F.transform("ends", lambda e, i: e - F.when(i > 0, F.element_at("ends", i)).otherwise(0)).alias("df"))).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    weights = np.zeros(len(words), np.int64)
    for term, df in frequency.collect():  # a row for each term of the block
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    queries = [np.array([words[w] for w in e], np.int64) for e in each]
    found = segments.mapInArrow(bounds_of(queries, weights, (n, total)), "query long, segment long, bound long")
    only: dict[int, list[int]] = {}
    for query, segment in found.groupBy("query").agg(F.max_by("segment", F.struct("bound", "segment"))).collect():  # a row for each query
        only.setdefault(segment, []).append(query)
    first = segments.where(F.col("segment").isin(list(only))).mapInArrow(searched(queries, weights, (n, total), k, [0] * len(queries), only), HITS)
    least = [0] * len(queries)
    for query, count, score in first.groupBy("query").agg(F.count("*"), F.min("score")).collect():
        least[query] = score if count == k else 0
    every = segments.mapInArrow(searched(queries, weights, (n, total), k, least), HITS)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("named").desc(), "doc_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, most_documents: int = DOCUMENTS, most_postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items its k best documents with a score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    kind = items.schema["item_id"].dataType
    some = items.select("item_id", "text")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block + 1
    parts = []
    for number in range(blocks):
        rows = (some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number) if blocks > 1 else some).collect()  # a block of the stated queries, of a bounded size
        found = block_results(docs, [r.text.encode("utf-8", "surrogatepass") if r.text else None for r in rows], k, scratch, most_documents, most_postings) if rows else None
        if found is not None:
            names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], f"query long, item_id {kind.simpleString()}")
            part = found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            parts.append(scratch.table(part, f"block{number}") if blocks > 1 else part)
            if blocks > 1:
                scratch.drop("segments")
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
