"""Toxicity by a classifier that is regularised with counterfactuals.

A logistic model over the presence of hashed words, fitted on a bounded sample of labelled
documents (`most_labelled`, by hash over all labels). Each of these texts has a counterfactual:
every identity term in it is swapped for another of its group, or, where it mentions none, one
is put in. The squared difference of the two scores is penalised beside the usual loss, so that
a mere mention of a group moves no score. Documents are scored in one pass over whole texts.

Defined results: a null or empty text has no words and gets the score of the intercept; a null
doc_id is not held out; repeated rows score alike; labels that disagree about a doc_id count as
their mean; without labels every score is 0; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.quality import labelled_sample

#: Neutral mentions of groups, by group; terms of one line are swapped for each other.
IDENTITY_GROUPS = (
    "women men woman man girls boys female male transgender nonbinary",
    "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist",
    "gay lesbian straight bisexual queer heterosexual homosexual",
    "black white asian african european latino hispanic arab indigenous",
    "immigrants refugees citizens foreigners natives immigrant refugee citizen foreigner native",
    "old young elderly disabled blind deaf",
    "frauen männer muslime christen juden schwule lesben ausländer flüchtlinge behinderte",
    "femmes hommes musulmans chrétiens juifs gays lesbiennes étrangers réfugiés handicapés",
    "mujeres hombres musulmanes cristianos judíos gais lesbianas extranjeros refugiados discapacitados",
)
WORDS = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def words_of(text: str | None) -> list[str]:
    return sorted(set(WORDS.findall((text or "").lower())))


def counterfactual(words: list[str], groups: tuple[str, ...], seed: int) -> list[str]:
    """The words with each identity term swapped within its group, or with a term put in."""
    terms = {t: g.split() for g in groups for t in g.split()}
    if not terms:
        return words
    if not any(w in terms for w in words):
        names = sorted(terms)
        return [*words, names[seed % len(names)]]

    def swapped(w: str) -> str:
        others = [t for t in terms[w] if t != w]
        return others[(seed + zlib.crc32(w.encode())) % len(others)] if others else w

    return sorted({swapped(w) if w in terms else w for w in words})


@dataclass
class Model:
    weights: np.ndarray  # of the buckets in `known`
    known: np.ndarray
    intercept: float

    def lookup(self) -> dict[int, float]:
        return dict(zip(self.known.tolist(), self.weights.tolist(), strict=True))


def fit(rows: list[np.ndarray], others: list[np.ndarray], y: np.ndarray, swap: float = 1.0, l1: float = 2e-4, l2: float = 1e-5, least: int = 5, steps: int = 400) -> Model:
    """Accelerated proximal gradient; columns that fewer than `least` texts have are left out. Without any column only the intercept is left."""
    seen, times = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True)
    extra = np.unique(np.concatenate([np.setdiff1d(o, r) for r, o in zip(rows, others, strict=True)] or [np.empty(0, int)]))
    known = np.union1d(seen[times >= least], extra)
    n, k = len(rows), len(known)
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    w, b = np.zeros(k), float(np.log(mean / (1 - mean)))
    if k == 0:
        return Model(w, known.astype(np.int64), b)

    def matrix(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate(lists)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in lists])
        place = np.minimum(np.searchsorted(known, at), k - 1)
        ok = known[place] == at
        return row[ok], place[ok].astype(np.int32)

    (r1, c1), (r2, c2) = matrix(rows), matrix(others)
    # each column has its own step: the curvature is at most a quarter of the column's share, times the row's length
    width = np.bincount(r1, minlength=n).astype(float) + 1
    wide2 = width + np.bincount(r2, minlength=n)
    bound = (np.bincount(c1, width[r1], k) / 4 + 2 * swap * (np.bincount(c1, wide2[r1], k) + np.bincount(c2, wide2[r2], k))) / n + l2 + 1e-9
    bound = np.maximum(bound / 4, 1e-6)
    v, last, t = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(r1, v[c1], n)
        p = 1 / (1 + np.exp(-np.clip(z + b, -40, 40)))
        change = z - np.bincount(r2, v[c2], n)
        g1 = (p - y + 2 * swap * change) / n
        grad = np.bincount(c1, g1[r1], k) - np.bincount(c2, (2 * swap * change / n)[r2], k) + l2 * v
        w = v - grad / bound
        w = np.sign(w) * np.maximum(np.abs(w) - l1 / bound, 0)
        b -= 4 * float((p - y).mean()) * 0.5
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((v - w) * (w - last)).sum() > 0:  # restart
            t_next, v = 1.0, w.copy()
        else:
            v = w + (t - 1) / t_next * (w - last)
        last, t = w, t_next
    keep = w != 0
    return Model(w[keep], known[keep], b)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000, groups: tuple[str, ...] = IDENTITY_GROUPS) -> Model | None:
    """From labelled rows whose crc32(doc_id) mod 5 is not 0."""
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)

    def hashed(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        words = [words_of(t) for t in texts]
        return pd.DataFrame({
            "own": [sorted({bucket(w) for w in ws}) for ws in words],
            "other": [sorted({bucket(w) for w in counterfactual(ws, groups, int(d))}) for ws, d in zip(words, ids, strict=True)],
        })

    rows = labelled_sample(docs, learn, "toxic", most_labelled)
    rows = rows.select("doc_id", "label", F.pandas_udf(hashed, "own array<int>, other array<int>")("doc_id", "text").alias("h")).select("doc_id", "label", "h.*").toPandas()
    y = rows["label"].to_numpy(float)
    if len(y) == 0 or y.max() == 0:
        return None
    rows = rows.assign(key=[zlib.crc32(np.asarray(r, np.int32).tobytes()) for r in rows["own"]]).sort_values(["doc_id", "key"])
    own, other, y = [np.asarray(r, np.int32) for r in rows["own"]], [np.asarray(r, np.int32) for r in rows["other"]], rows["label"].to_numpy(float)
    del rows
    return fit(own, other, y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""

    def of(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        weight = model.lookup()
        known: dict[str, float] = {}
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            z = model.intercept
            for w in words_of(text):
                x = known.get(w)
                if x is None:
                    x = known[w] = weight.get(bucket(w), 0.0)
                z += x
            out[k] = 1 / (1 + np.exp(-min(max(z, -40.0), 40.0)))
        return pd.Series(out)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), F.pandas_udf(of, "double")("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
