"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy arrays.

The statistics come from whole texts in one pass over Arrow batches; only the sample is shuffled. The
trees are fitted on the driver on a bounded sample of labelled rows (`most_labelled`, taken by
hash over all labels), with monotone constraints on the features where more can only be worse,
and travel as five small arrays.

Defined results: a null or empty text has no words, so base_failed; a null doc_id stays a row;
repeated rows are judged each alike; labels that disagree about a doc_id count as their mean;
without labels of both kinds the trees keep everything that the base rules keep.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and 1 or -1 where the chance of good quality may only rise or fall with them.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "distinct_share": 0, "bang_share": -1, "digit_share": 0, "line_words": 0}
SCHEMA = ", ".join([*(f"{n} long" for n in BASE), *(f"{n} double" for n in FEATURES)])


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """How many words lie in a window of so many words that occurs twice or more."""
    n = len(ids)
    if n <= width:
        return 0
    scale = int(ids.max()) + 1
    _, of, count = np.unique(ids[:-1] * scale + ids[1:], return_inverse=True, return_counts=True)
    twice = count[of] >= 2  # a repeated window consists of repeated pairs
    windows = n - width + 1
    may = np.logical_and.reduce([twice[k : k + windows] for k in range(width - 1)])
    at = np.flatnonzero(may)
    if len(at) < 2:
        return 0
    _, of, count = np.unique(np.stack([ids[at + k] for k in range(width)], 1), axis=0, return_inverse=True, return_counts=True)
    at = at[count[of.ravel()] >= 2]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The base counts, then the features."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeat = repeated_words(ids)
    some, size = max(n, 1), max(chars, 1)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    return (
        n, chars, symbols, dup, repeat,
        math.log1p(n), chars / some, symbols / size, dup / max(lines, 1), repeat / some, upper / size,
        len(number) / some ** 0.8, text.count("!") / some, digits / size, n / max(lines, 1),
    )


def statistics_of(text) -> F.Column:
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])

    return F.pandas_udf(of, SCHEMA)(text)


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child, so that every row takes `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: int = 20) -> Trees:
    """Boosted trees for y in [0, 1] under logistic loss, by histograms.

    A split on a constrained feature needs leaf values in that feature's order, and both sides
    inherit the middle of the two values as a bound.
    """
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], 1)
    mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    base = math.log(mean / (1 - mean))
    nodes: list[list[float]] = []
    roots, raw = [], np.full(n, base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        nodes.append([0, math.inf, me, me, rate * min(max(-g[rows].sum() / (h[rows].sum() + l2), low), high)])
        raw_value = nodes[me][4]
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j in range(k):
                if not len(cuts[j]):
                    continue
                b, width = binned[rows, j], len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(b, g[rows], width))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], width))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=width))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain = -(gl * vl + (hl + l2) * vl**2 / 2 + gr * vr + (hr + l2) * vr**2 / 2)
                whole = min(max(-total_g / (total_h + l2), low), high)
                gain += total_g * whole + (total_h + l2) * whole**2 / 2
                ok = (nl >= least) & (len(rows) - nl >= least)
                if monotone[j]:
                    ok &= monotone[j] * (vr - vl) >= 0
                gain = np.where(ok, gain, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (j, at, vl[at], vr[at]))
        if best[1]:
            j, at, vl, vr = best[1]
            left = binned[rows, j] <= at
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
            nodes[me][:4] = [j, float(cuts[j][at]), grow(rows[left], g, h, level + 1, *bounds[0]), grow(rows[~left], g, h, level + 1, *bounds[1])]
        else:
            raw[rows] += raw_value
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), depth, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label, text) of at most about `most` labelled documents, taken by hash over all labels.

    The chosen ids are at most 2 * most rows (the expected number is most), so they are broadcast.
    Of documents that share a chosen doc_id one is taken, that of the least hash of its text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("label"))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(n, 1)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.where(share).limit(2 * most)), "doc_id")
    return chosen.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", "label", "one.text")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000) -> Trees | None:
    """Trees for the chance that quality is 1; None if the labels are all alike."""
    found = labelled_sample(docs, labels, "quality", most_labelled).select("label", statistics_of("text").alias("s")).select("label", "s.*").toPandas()
    y = found["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    found = found.sort_values([*BASE, *FEATURES, "label"])  # the same trees whatever order the rows came in
    return fit_trees(found[list(FEATURES)].to_numpy(float), found["label"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees | None, keep_from: float = 0.3) -> DataFrame:
    """docs with a column voxloom_quality: a struct of the base counts, base_failed, score and kept."""

    @F.pandas_udf(", ".join([*(f"{n} long" for n in BASE), "base_failed boolean", "score double", "kept boolean"]))
    def verdict(texts: pd.Series) -> pd.DataFrame:
        s = pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])
        score = model.score(s[list(FEATURES)].to_numpy(float)) if model else np.ones(len(s))
        failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        return s[list(BASE)].assign(base_failed=failed, score=score, kept=~failed & (score >= keep_from))

    return docs.withColumn("voxloom_quality", verdict("text"))
