"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest capacity; pieces are dealt by hash into
shards of about `shard_items`, so that a task's memory doesn't depend on the input, and only
(doc_id, lengths) rows are shuffled. Within a shard best-fit decreasing fills the open sequence
with the least room that takes the piece, and otherwise opens a new one of the size that costs
least for each token it can be expected to hold. Each sequence is downsized at the end to the
least capacity that holds its contents. The same with a floor under all new sizes, for every
floor, is tried on the whole shard too, and the packing of the least total cost is taken.

Defined results: null and empty texts are pieces of length 0 and are placed too; rows that
repeat each other are placed as often as they occur (they are counted, then dealt in parts, so
that no doc_id is hot); a null doc_id is an id of its own; an empty table gives no sequences.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, word_count

CAPACITIES = (512, 1024, 2048, 4096)
SEQUENCES = "seq_id long, capacity int, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<int>"


def best_fit(lengths: list[int], order: list[int], capacities: tuple[int, ...], floor: int | None, overhead: int) -> tuple[list[list[int]], list[int]]:
    """Contents (positions in lengths) and sizes of the sequences; order goes from long to short.

    A new sequence gets the size of the least cost for each token that it can be expected to
    hold: the piece, and of the shorter pieces still to come as much as there is and fits. With
    a floor it gets the least size of at least the floor.
    """
    bins: list[list[int]] = []
    sizes: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    open_rooms = 0  # bit r: a sequence with r tokens of room is open
    ascending = [lengths[i] for i in reversed(order)]
    below = [0, *accumulate(ascending)]  # tokens of the shortest pieces
    for k, i in enumerate(order):
        need = lengths[i]
        fits = open_rooms >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            some = [c for c in capacities if c >= need]
            if floor is None:
                to_come = len(order) - k - 1
                held = lambda c: need + min(c - need, below[min(to_come, bisect_right(ascending, c - need))])  # noqa: B023, E731
                left = min(some, key=lambda c: ((c + overhead) / max(held(c), 1), c))  # noqa: B023
            else:
                left = next((c for c in some if c >= floor))
            b = len(bins)
            bins.append([])
            sizes.append(left)
        bins[b].append(i)
        left -= need
        room[left].append(b)
        open_rooms |= 1 << left
    return bins, sizes


def pack(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[list[int]], list[int]]:
    """The packing of least cost, a sequence's cost being its capacity plus `overhead`; sizes are downsized."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best = None
    for floor in (None, *capacities):
        bins, _ = best_fit(lengths, order, capacities, floor, overhead)
        sizes = [next(c for c in capacities if c >= sum(lengths[i] for i in b)) for b in bins]
        cost = sum(sizes) + overhead * len(sizes)
        if best is None or cost < best[0]:
            best = (cost, bins, sizes)
    return best[1], best[2]


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64, shard_items: int = 20_000, tokens=None) -> DataFrame:
    """One row for each sequence: its size, and the pieces (doc_id, first token, number of tokens) in it."""
    capacities, largest = tuple(sorted(capacities)), max(capacities)
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select("doc_id", (word_count("text") if tokens is None else tokens).cast("long").alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("times"))
    rows = scratch.table(rows, "counted")
    pieces = F.greatest(F.ceil(F.col("n") / largest), F.lit(1)).cast("long")
    total = rows.agg(F.sum(F.col("times") * pieces)).first()[0] or 0
    shards = max(1, -(-total // shard_items))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 1000)))
    dealt = rows.withColumn("part", part).withColumn("times", F.least(F.lit(1000), F.col("times") - 1000 * F.col("part")).cast("int"))
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    dealt = dealt.select(
        F.pmod(F.xxhash64(F.lit(11), "doc_id", "n", "part", "piece"), F.lit(shards)).alias("shard"),
        F.col("doc_id").isNull().alias("nameless"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "times",
        (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("int").alias("length"),
    )

    def fill(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        items = groups.sort_values(["nameless", "doc_id", "start", "length"])
        items = items.loc[items.index.repeat(items["times"])]
        ids = [None if no else d for no, d in zip(items["nameless"].tolist(), items["doc_id"].tolist(), strict=True)]
        starts, lengths = items["start"].tolist(), items["length"].tolist()
        bins, sizes = pack(lengths, capacities, overhead)
        return pd.DataFrame({
            "seq_id": [(key[0] << 32) + k for k in range(len(bins))], "capacity": sizes, "n_tokens": [sum(lengths[i] for i in b) for b in bins],
            "doc_ids": [[ids[i] for i in b] for b in bins], "starts": [[starts[i] for i in b] for b in bins], "lengths": [[lengths[i] for i in b] for b in bins],
        })

    return dealt.groupBy("shard").applyInPandas(fill, SEQUENCES)
