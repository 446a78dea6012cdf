"""Mixing sources to target weights by a temperature, realised as budgeted block permutations.

Weights are the sources' token shares to the power of an exponent, normalised. The exponent is
bisected so that the weights' entropy meets a target, or so that no source is repeated more than
a limit. Each source's documents are dealt by hash into blocks, more of them the more
documents there are, so that the task that orders a source's cut block has few of them; an epoch
over a source is a permutation of its blocks; whole epochs are walked and of the last one as many blocks as the
source's budget holds, the block at its edge being cut at a document.

Only (doc_id, source, tokens, hash) rows are aggregated. What reaches the driver is one row per
source; beyond `most_sources` rows the moments of the bisection are aggregated by Spark and the
limits are joined by source and block instead of being broadcast.

Defined results: a null source is a source of its own (null); null or empty texts have no tokens
and follow their block; rows that repeat each other fall on the same side of a cut; a source
without tokens is kept once; empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, small_side, word_count


@dataclass(frozen=True)
class Plan:
    """target_entropy: as a share of the logarithm of the number of sources; budget: tokens, or "cover", the least that drops no document, or None, as many as there are; blocks: the least number of blocks of each source; block_rows: so many documents a block, if there was one source only; spread: the parts of a source where sources are too many for a broadcast."""

    target_entropy: float | None = None
    max_repeats: float | None = None
    budget: float | str | None = None
    blocks: int = 4096
    block_rows: int = 1 << 16
    spread: int = 64
    seed: int = 7
    most_sources: int = 100_000


class Moments:
    """What the bisection asks of the sources' tokens, in numpy or as one aggregate over a table."""

    def __init__(self, sources: DataFrame, small: bool):
        self.sources, self.small = sources.where("tokens > 0"), small
        if small:
            self.tokens = np.array(sorted(float(r[0]) for r in self.sources.select("tokens").collect()))  # sorted: the same sums in any run
            self.n, self.total = len(self.tokens), float(self.tokens.sum())
            self.least, self.most = (float(self.tokens.min()), float(self.tokens.max())) if self.n else (1.0, 1.0)
        else:
            self.n, self.total, self.least, self.most = self.sources.agg(F.count("*"), F.sum("tokens").cast("double"), F.min("tokens").cast("double"), F.max("tokens").cast("double")).first()

    def sums(self, power: float) -> tuple[float, float]:
        """Sum of x and of x ln x, for x = (tokens / total) ** power."""
        if self.small:
            x = (self.tokens / self.total) ** power
            return float(x.sum()), float((x * np.log(x)).sum())
        x = F.pow(F.col("tokens") / self.total, F.lit(power))
        return tuple(self.sources.agg(F.sum(x), F.sum(x * F.log(x))).first())

    def entropy(self, power: float) -> float:
        z, s = self.sums(power)
        return math.log(z) - s / z

    def repeats(self, power: float, budget: float | str) -> float:
        """Of the source that is repeated most."""
        if budget == "cover":
            return (self.most / self.least) ** (1 - power) if power <= 1 else (self.most / self.least) ** (power - 1)
        z = self.sums(power)[0]
        return max(budget * (t / self.total) ** power / z / t for t in (self.least, self.most))

    def budget(self, power: float, budget: float | str) -> float:
        if budget != "cover":
            return float(budget)
        z = self.sums(power)[0]
        return max(t * z / (t / self.total) ** power for t in (self.least, self.most))


def exponent(m: Moments, plan: Plan) -> float:
    """1 keeps the shares, 0 makes them equal. The repetition limit goes before the entropy."""
    if m.n < 2:
        return 1.0
    budget = plan.budget if plan.budget is not None else m.total
    power = 1.0
    if plan.target_entropy is not None:
        aim, low, high = plan.target_entropy * math.log(m.n), 0.0, 16.0
        for _ in range(50):
            power = (low + high) / 2
            low, high = (power, high) if m.entropy(power) > aim else (low, power)
    elif plan.max_repeats is not None:
        power = 0.0
    if plan.max_repeats is not None and power < 1 and m.repeats(power, budget) > plan.max_repeats:
        low, high = power, 1.0
        for _ in range(50):
            power = (low + high) / 2
            low, high = (power, high) if m.repeats(power, budget) > plan.max_repeats else (low, power)
        power = high
    return round(power, 12)


def mixture(docs: DataFrame, plan: Plan, scratch: Scratch) -> tuple[DataFrame, bool, int]:
    """By source its weight, whole epochs and cut of the last one; whether the sources are few; the number of blocks."""
    rows = scratch.table(docs.select("doc_id", "source", word_count("text").alias("tokens")).withColumn("h", F.xxhash64(F.lit(plan.seed), "doc_id", "tokens")), "rows")
    blocks_each = max(plan.blocks, -(-rows.count() // plan.block_rows))
    block = F.pmod(F.col("h"), F.lit(blocks_each)).cast("int").alias("block")
    blocks = scratch.table(rows.groupBy("source", block).agg(F.sum("tokens").alias("tokens")), "blocks")
    sources, small = small_side(scratch, blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources", plan.most_sources)
    m = Moments(sources, small)
    power = exponent(m, plan)
    budget = m.budget(power, plan.budget if plan.budget is not None else m.total) if m.n else 0.0
    z = m.sums(power)[0] if m.n else 1.0
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(m.total or 1.0), F.lit(power)) / F.lit(z)).otherwise(0.0)
    aim = F.round(F.col("weight") * F.lit(budget)).cast("long")
    if plan.budget == "cover":
        aim = F.greatest(aim, F.col("tokens"))
    sources = sources.withColumn("weight", share).select(
        "source", "tokens", "weight",
        F.when(F.col("tokens") > 0, F.floor(aim / F.greatest("tokens", F.lit(1))).cast("long")).otherwise(F.lit(1).cast("long")).alias("epochs"),
        F.when(F.col("tokens") > 0, aim % F.greatest("tokens", F.lit(1))).otherwise(0).alias("rest"),
    )
    # The last epoch: blocks in its permutation, up to the one in which the rest of the budget ends.
    same = F.col("source").eqNullSafe(F.col("s"))
    turn = lambda: F.xxhash64(F.lit(plan.seed), F.col("epochs"), F.col("source"), F.col("block"))
    inner = lambda: F.xxhash64(F.col("h"), F.col("epochs"))
    sides = sources.withColumnRenamed("source", "s").drop("tokens")
    dealt = blocks.join(F.broadcast(sides) if small else sides, same).withColumn("turn", turn())
    before = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    edge = dealt.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).where("before <= rest AND rest < before + tokens")
    edge = scratch.table(edge.select("source", "block", "turn", (F.col("rest") - F.col("before")).alias("left"), "epochs"), "edge")
    sharp = F.broadcast(edge) if small else edge  # at most one block of each source
    e = sharp.select(F.col("source").alias("s"), F.col("block").alias("b"), "left", "epochs")
    inside = rows.withColumn("block", block).join(e, same & (F.col("block") == F.col("b")))
    inside = inside.select("source", "left", inner().alias("inner"), "tokens").groupBy("source", "left", "inner").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("inner").rowsBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("upto", F.sum("tokens").over(upto)).where("upto <= left").groupBy("source").agg(F.max("inner").alias("cut"))
    limits = sources.join(edge.select(F.col("source").alias("s"), F.col("turn").alias("edge_turn"), F.col("block").alias("edge_block")), same, "left").drop("s")
    limits = limits.join(cut.withColumnRenamed("source", "s"), same, "left").drop("s")
    return scratch.table(limits, "limits"), small, blocks_each


def mix_sources(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each time that a document is to be seen.

    The document's columns, then weight (its source's), epoch (from 0), and block_turn and
    doc_turn: sorted by (epoch, block_turn, doc_turn), the rows are the schedule. Columns of
    docs with these four names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    limits, small, blocks_each = mixture(docs, plan, scratch)
    limits = limits.withColumnRenamed("source", "s").drop("tokens")
    h = F.xxhash64(F.lit(plan.seed), "doc_id", word_count("text"))
    mine = docs.select(F.struct(*docs.columns).alias("row"), "source", h.alias("h"), F.pmod(h, F.lit(blocks_each)).cast("int").alias("block"))
    same = F.col("source").eqNullSafe(F.col("s"))
    if small:  # one row of each source, counted
        joined = mine.join(F.broadcast(limits), same, "left")
    else:  # by source and block modulo `spread`, so that a hot source is dealt to many tasks
        dealt = limits.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(plan.spread - 1))))
        joined = mine.join(dealt, same & (F.pmod("block", F.lit(plan.spread)) == F.col("b")), "left")
    turn = lambda epoch: F.xxhash64(F.lit(plan.seed), F.col(epoch), F.col("source"), F.col("block"))
    order = F.struct(turn("epochs").alias("t"), F.col("block").alias("b"))
    edge = F.struct(F.col("edge_turn").alias("t"), F.col("edge_block").alias("b"))
    within = F.coalesce(F.xxhash64("h", "epochs") <= F.col("cut"), F.lit(False))
    last = F.col("edge_turn").isNotNull() & ((order < edge) | ((order == edge) & within))
    copies = F.col("epochs") + F.when(last, 1).otherwise(0)
    seen = joined.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("weight", "epoch", "block_turn", "doc_turn")]
    return seen.select(*own, "weight", "epoch", turn("epoch").alias("block_turn"), F.xxhash64("h", "epoch").alias("doc_turn"))
