"""Passages that repeat across documents, by Rabin-Karp hashes of all windows of so many words.

A text's bytes get one polynomial hash for each word, and these one for each window, both from
running sums, so that a window costs a few array operations. Windows are hashed in chunks of
documents (some megabytes of text, documents in the order of their ids). A chunk settles by
itself what repeats within it and sends each distinct hash once, dealt to buckets by its leading
bits. Spark groups the buckets, and each finds, for every hash, the least document of all chunks:
windows of greater documents are to go. The answers return to the chunk that asked, one row for
each chunk and bucket, and there the windows merge into maximal intervals of words, a row for
each document that loses some. These meet the documents once, which stay in place where the
intervals are few enough to be broadcast.

A window that a third of all documents share is sent once by each chunk, and a bucket holds a
bounded share of the hashes, as there are more buckets where there is more text. Windows count as
the same if their 64 bits are equal, which two different windows are with a chance of 2^-64.
Chunks are made anew where an executor is lost, so docs should come from a table, as a scan gives
the same rows in the same order again.

Defined results: a null or empty text has no words; texts shorter than a window lose nothing; a
null doc_id is neither smaller nor greater than another, so that its row neither takes words from
others nor loses its own; rows of one doc_id do not take words from each other; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, small_side
from voxloom.llm.similar import spread

#: Bytes of text of a chunk, and for which there is a bucket.
CHUNK = 8 << 20
#: Bytes whose words are hashed at once.
SLICE = 1 << 20
#: What is broadcast at most.
BROADCAST = 32 << 20
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTES = np.random.default_rng(31).integers(1, 1 << 64, 256, dtype=np.uint64)
#: Odd, so that they have inverses among the numbers of 64 bits.
BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64."""
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(8)
def small_power_table(base: int) -> np.ndarray:
    return power_table(base, SLICE)


def powers(base: int, n: int) -> np.ndarray:
    return small_power_table(base)[:n] if n <= SLICE else power_table(base, n)


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of each run of values, wherever it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]


def words_in(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each text followed by a space, start and end of each word in them, and the first word of each text (and the number of all)."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts] + [b""]), np.uint8)
    gap = IS_SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(gap & ~before)
    offsets = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])]).astype(np.int64)
    return data, start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        low = start[i]
        j = max(i + 1, int(np.searchsorted(end, low + SLICE - 1, "right")))
        out[i:j] = rolled(BYTES[data[low : end[j - 1]]], start[i:j] - low, end[i:j] - low, BASE)
        i = j
    return spread(out, 0)


def windows(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window, the word it starts with, the first word of each text and the number of all)."""
    data, start, end, first = words_in(texts)
    words = word_hashes(data, start, end)
    n = max(0, len(words) - width + 1)
    at = np.arange(n)
    hashes = spread(rolled(words, at, at + width, WINDOW_BASE), 1)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = text[width - 1 :] == text[:n] if n else np.zeros(0, bool)
    return hashes[whole], at[whole], first


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as compressed planes of bytes; of rising ones the differences."""
    values = values.astype(np.uint64)
    if rising and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, n: int, rising: bool = False) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    values = np.ascontiguousarray(np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if rising else values


def pieces_of(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.Table]:
    """The rows in runs of so many bytes of text, or one row of more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).fill_null(0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + most - size, "right")) - 1) if size < most else at
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(upto[end] - upto[at])
            if end < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = end
    if held:
        yield pa.Table.from_batches(held)


def texts_of(table: pa.Table) -> list[bytes | None]:
    return table.column("text").cast(pa.large_binary()).to_pylist()


ASKED = "bucket long, chunk long, n long, hashes binary, words binary, documents long, firsts binary, ids binary, payload binary"


def asking(width: int, bits: int):
    """A function from documents (doc_id, text, text_hash) to what their chunks ask of the buckets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for table in pieces_of(batches):
            ids = table.column("doc_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            table, ids = table.take(order), ids[order]
            hashes, words, first = windows(texts_of(table), width)
            chunk += 1
            if not len(hashes):
                continue
            by_hash = np.argsort(hashes)
            hashes, words = hashes[by_hash], words[by_hash]
            new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            chosen = np.minimum.reduceat(words, new)  # in the least document, as words are in the order of documents
            repeat = np.repeat(chosen, np.diff(new, append=len(hashes)))
            text_of = lambda w: np.searchsorted(first, w, "right") - 1
            other = words != repeat
            w, own = words[other], repeat[other]
            gone = ids[text_of(w)] != ids[text_of(own)]  # in a greater document of this chunk
            payload = [ids.view(np.uint64), table.column("text_hash").to_numpy().view(np.uint64), first, w[gone], w[~gone], own[~gone]]
            hashes, words = hashes[new], chosen
            edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = []
            for b in range(1 << bits):
                h, some = hashes[edges[b] : edges[b + 1]], words[edges[b] : edges[b + 1]]
                if len(h) or not b:
                    texts = np.unique(text_of(some))
                    rows.append((b, chunk, len(h), packed(h, True), packed(some), len(texts), packed(first[texts], True), packed(ids[texts].view(np.uint64)),
                        pa.serialize_pandas(pd.DataFrame({"n": [len(p) for p in payload], "data": [packed(p) for p in payload]})).to_pybytes() if not b else None))
            names = [f.split()[0] for f in ASKED.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.binary() if f.endswith("binary") else pa.int64()) for k, (n, f) in enumerate(zip(names, ASKED.split(", "), strict=True))})

    return ask


def answered(group: pd.DataFrame) -> pd.DataFrame:
    """Of each chunk in a bucket the windows (as words they start with) whose hash a smaller document of any chunk has."""
    some, ids = [], []
    for n, h, w, t, f, i in zip(*(group[c] for c in ("n", "hashes", "words", "documents", "firsts", "ids")), strict=True):
        words = unpacked(w, n).astype(np.int64)
        some.append((unpacked(h, n, True), words))
        ids.append(unpacked(i, t).view(np.int64)[np.searchsorted(unpacked(f, t, True).astype(np.int64), words, "right") - 1])
    hashes, ids = np.concatenate([h for h, _ in some]), np.concatenate(ids)
    gone = np.zeros(len(hashes), bool)
    if len(hashes):
        order = np.argsort(hashes)
        new = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
        least = np.minimum.reduceat(ids[order], new)
        gone[order] = ids[order] > np.repeat(least, np.diff(new, append=len(hashes)))
    out, at = [], 0
    for chunk, payload, (_, words) in zip(group["chunk"], group["payload"], some, strict=True):
        mine = words[gone[at : at + len(words)]]
        at += len(words)
        if len(mine) or payload is not None:
            out.append((chunk, len(mine), packed(mine), payload))
    return pd.DataFrame(out, columns=["chunk", "n", "words", "payload"])


def merged(width: int):
    """A function from a chunk's answers to (doc_id, text_hash, spans), the maximal intervals of words that each document loses."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        payload = pa.deserialize_pandas(next(p for p in group["payload"] if p is not None))
        ids, hashes, first, gone, follower, leader = (unpacked(d, n) for n, d in zip(payload["n"], payload["data"], strict=True))
        first = first.astype(np.int64)
        flag = np.zeros(first[-1] + 1, bool)
        for n, words in zip(group["n"], group["words"], strict=True):
            flag[unpacked(words, n).astype(np.int64)] = True
        flag[follower.astype(np.int64)] = flag[leader.astype(np.int64)]
        flag[gone.astype(np.int64)] = True
        starts = np.flatnonzero(flag)
        change = np.zeros(first[-1] + width + 1, np.int64)
        change[starts] += 1
        np.subtract.at(change, starts + width, 1)
        covered = np.cumsum(change)[: first[-1]] > 0
        edge = np.zeros(first[-1] + 1, bool)  # where a text begins, an interval ends
        edge[first] = True
        last = np.concatenate([[False], covered])[:-1] if len(covered) else covered
        low = np.flatnonzero(covered & (~last | edge[:-1]))
        following = np.concatenate([covered[1:], [False]]) if len(covered) else covered
        high = np.flatnonzero(covered & (~following | edge[1:])) + 1
        text = np.searchsorted(first, low, "right") - 1
        rows = []
        for run in np.split(np.arange(len(low)), np.flatnonzero(np.diff(text)) + 1) if len(low) else []:
            t = text[run[0]]
            rows.append((ids.view(np.int64)[t], hashes.view(np.int64)[t], [{"start": int(a - first[t]), "end": int(b - first[t])} for a, b in zip(low[run], high[run], strict=True)]))
        return pd.DataFrame(rows, columns=["doc_id", "text_hash", "spans"])

    return merge


def repeated_spans(docs: DataFrame, width: int = 13, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, spans) of each text that loses words: intervals of words covered by windows that start in a smaller document too."""
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // chunk).bit_length())
    asked = named.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(asking(width, bits), ASKED)
    found = asked.groupBy("bucket").applyInPandas(answered, "chunk long, n long, words binary, payload binary")
    spans = found.groupBy("chunk").applyInPandas(merged(width), "doc_id long, text_hash long, spans array<struct<start:int,end:int>>")
    return spans.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))  # rows that repeat each other lose the same


def kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in pieces_of(batches):
        texts = texts_of(table)
        data, start, end, first = words_in(texts)
        change = np.zeros(len(start) + 1, np.int64)
        for k, spans in enumerate(table.column("spans").to_pylist()):
            for s in spans or ():
                change[first[k] + s["start"]] += 1
                change[first[k] + s["end"]] -= 1
        keep = np.cumsum(change)[:-1] == 0
        edges = np.zeros(len(data) + 2, np.int8)  # a word that is kept goes with what follows it, which becomes a space
        np.add.at(edges, start[keep], 1)
        np.add.at(edges, end[keep] + 1, -1)
        out = data.copy()
        out[end] = 0x20
        out = out[np.cumsum(edges, dtype=np.int8)[: len(data)] > 0].tobytes()
        sizes = np.concatenate([[0], np.cumsum(np.where(keep, end - start + 1, 0))])
        left = np.concatenate([[0], np.cumsum(keep)])
        kept = [out[sizes[a] : max(sizes[a], sizes[b] - 1)] for a, b in zip(first[:-1], first[1:], strict=True)]
        n = np.diff(first)
        yield pa.RecordBatch.from_arrays(
            [*(table.column(c).combine_chunks() for c in ("doc_id", "spans")), pa.array(n, pa.int64()), pa.array(n - np.diff(left[first]), pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
            names=["doc_id", "spans", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, width: int = 13, chunk: int = CHUNK, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for each row: its text without the words of windows that start in a smaller document too, joined by one space."""
    scratch = Scratch(docs.sparkSession, "passages")
    spans, few = small_side(scratch, repeated_spans(docs, width, chunk), "spans", broadcast, 64 + 16 * F.size("spans"))
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "spans")
    spans = F.broadcast(spans) if few else spans.hint("shuffle_hash")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    both = texts.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left").select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)["doc_id"]
    return both.mapInArrow(kept_texts, f"doc_id {kind}, spans array<struct<start:int,end:int>>, n_words long, n_removed long, kept string").select("doc_id", "n_words", "n_removed", "spans", "kept")
