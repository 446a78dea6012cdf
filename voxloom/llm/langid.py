"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary, fitted by
expectation maximisation on a bounded sample of labelled documents (`per_language` of each
language, fewer where the languages are so many that this would be more than `most_sampled`,
taken by hash over all of them; equal texts of a language count once). A text's words are scored
under every language by the forward algorithm, which sums over all segmentations; words don't
share pieces, so a text's log-likelihood is the sum over its words. Distinct words are scored
once for each task and kept up to a bound in numbers, whatever the number of languages; more
than `BLOCK` languages are scored in blocks. The driver and each worker hold one number for each
piece and language. Texts are not shuffled, but for the sample.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text
if no language could be learned; equal scores go to the first language by name; a null doc_id
counts as no number, is never learned from and is not held out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.pieces import MARK, PieceTrie, as_codes, blocks, forward, load_pieces, DEFAULT_MODEL, LONG

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Languages that are scored at once.
BLOCK = 32


def words_of(text: str | None) -> list[str]:
    return [MARK + w for w in LETTERS.findall((text or "").lower())]


def remainder(doc_id, n: int) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


@dataclass
class Languages:
    names: list[str]
    pieces: list[str]
    weights: np.ndarray  # [pieces, languages]
    unknown: np.ndarray


def expected_counts(words: list[str], counts: np.ndarray, trie: PieceTrie, weights: np.ndarray, unknown: float) -> np.ndarray:
    """How often each piece is expected over all segmentations of the words, weighted by counts."""
    found = np.zeros(len(trie.pieces))
    number = dict(zip(words, counts, strict=True))
    at_node = np.zeros(len(trie.piece_at))
    ends = trie.piece_at >= 0
    at_node[ends] = weights[trie.piece_at[ends]]
    boost = 20.0
    for some in blocks([w for w in words if len(w) <= LONG], 4 * trie.longest):
        codes = as_codes(some)
        n, width = codes.shape
        lengths = np.array([len(w) for w in some])
        node = np.full((width, trie.longest, n), -1, np.int64)  # [start, length - 1]
        p = np.zeros((width, trie.longest, n))
        for s in range(width):
            at = np.where(codes[:, s] > 0, 0, -1)
            for k in range(min(trie.longest, width - s)):
                at = trie.next(at, codes[:, s + k])
                if not (at >= 0).any():
                    break
                node[s, k] = at
                p[s, k] = np.where(at >= 0, at_node[np.maximum(at, 0)], 0) * boost ** (k + 1)
            lone = (codes[:, s] > 0) & ((node[s, 0] < 0) | ~ends[np.maximum(node[s, 0], 0)])
            p[s, 0][lone] = unknown * boost
            node[s, 0][lone] = -1
        alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        alpha[0] = 1
        beta[lengths, np.arange(n)] = 1
        for e in range(1, width + 1):
            for k in range(min(trie.longest, e)):
                alpha[e] += alpha[e - 1 - k] * p[e - 1 - k, k]
        for s in range(width - 1, -1, -1):
            for k in range(min(trie.longest, width - s)):
                beta[s] += p[s, k] * beta[s + 1 + k]
        scale = np.array([number[w] for w in some]) / np.maximum(beta[0], 1e-300)
        for s in range(width):
            for k in range(min(trie.longest, width - s)):
                live = np.flatnonzero(node[s, k] >= 0)
                live = live[trie.piece_at[node[s, k][live]] >= 0]
                if len(live):
                    np.add.at(found, trie.piece_at[node[s, k][live]], alpha[s, live] * p[s, k, live] * beta[s + 1 + k, live] * scale[live])
    for w in words:
        if len(w) > LONG:
            add_expected_of_one(w, number[w], found, trie, weights, unknown)
    return found


def add_expected_of_one(word: str, times: float, found: np.ndarray, trie: PieceTrie, weights: np.ndarray, unknown: float) -> None:
    """The same for one word of any length, by logarithms."""
    n = len(word)
    steps: list[list[tuple[int, int, float]]] = []  # from each place: length, piece or -1, log of the weight
    for s in range(n):
        here = [(k, piece, math.log(weights[piece])) for k in range(1, min(trie.longest, n - s) + 1) if (piece := trie.number.get(word[s : s + k])) is not None]
        steps.append(here if here and here[0][0] == 1 else [(1, -1, math.log(unknown)), *here])
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for s in range(n):
        for k, _, w in steps[s]:
            alpha[s + k] = np.logaddexp(alpha[s + k], alpha[s] + w)
    for s in range(n - 1, -1, -1):
        for k, _, w in steps[s]:
            beta[s] = np.logaddexp(beta[s], beta[s + k] + w)
    for s in range(n):
        for k, piece, w in steps[s]:
            if piece >= 0:
                found[piece] += times * math.exp(alpha[s] + w + beta[s + k] - alpha[n])


def fit(texts: dict[str, list[str]], pieces: list[str], rounds: int = 3, floor: float = 0.02) -> Languages:
    """Piece probabilities for each language, smoothed by `floor` occurrences of every piece."""
    trie = PieceTrie(pieces)
    names = sorted(texts)
    weights = np.empty((len(pieces), len(names)), np.float32)
    unknown = np.empty(len(names))
    start = np.array([0.1 ** max(0, 6 - len(p)) for p in pieces]) + 1e-6
    for k, name in enumerate(names):
        counts = Counter(w for t in texts[name] for w in words_of(t))
        words = sorted(counts)
        p, lone = start / start.sum(), 1e-8
        for _ in range(rounds):
            if words:
                found = expected_counts(words, np.array([counts[w] for w in words], float), trie, p, lone) + floor
                p = found / found.sum()
                lone = floor / found.sum() / 10
        weights[:, k], unknown[k] = p, lone
    return Languages(names, pieces, weights, unknown)


def train(docs: DataFrame, per_language: int = 400, model_path: str = DEFAULT_MODEL, most_sampled: int = 40_000) -> Languages:
    """From documents with a language whose crc32(doc_id) mod 4 is not 2; at least one of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2)).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("voxloom_n"))
    languages = sizes.count()
    if not languages:
        return Languages([], [], np.empty((0, 0)), np.empty(0))
    each = max(1, min(per_language, most_sampled // languages))
    # Twice as many texts as are wanted come by hash; of these the first by another hash are taken.
    ticket = F.pmod(F.xxhash64("h", F.lit("lang")), F.lit(1 << 30)) < F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(2.0 * each + 20) / F.col("voxloom_n"))
    some = known.join(F.broadcast(sizes), "lang").where(ticket).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")
    rows = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("lang", "text").toPandas().sort_values(["lang", "text"])
    return fit({name: some.tolist() for name, some in rows.groupby("lang")["text"]}, load_pieces(model_path))


def identify(docs: DataFrame, model: Languages, most_cached: int = 1_200_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row. most_cached: numbers, one for each known word and language."""
    many = len(model.names)
    kept = max(512, most_cached // max(many, 1))  # words
    run = min(kept // 2, 1 << 15)  # distinct words of texts that are scored together

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = PieceTrie(model.pieces) if many else None
        place: dict[str, int] = {}
        scores = np.empty((kept, many))

        def add(part: list[tuple[int, list[tuple[str, int]]]], total: np.ndarray) -> None:
            """Add to each row of total what some of its text's words say."""
            new = list(dict.fromkeys(w for _, items in part for w, _ in items if w not in place))
            if len(place) + len(new) > kept:
                place.clear()
                new = list(dict.fromkeys(w for _, items in part for w, _ in items))
            if new:
                for k in range(0, many, BLOCK):
                    scores[len(place) : len(place) + len(new), k : k + BLOCK] = forward(new, trie, model.weights[:, k : k + BLOCK], model.unknown[k : k + BLOCK])
                place.update({w: len(place) + k for k, w in enumerate(new)})
            for row, items in part:
                total[row] += np.array([n for _, n in items], float) @ scores[[place[w] for w, _ in items]]

        for texts in batches:
            total, some = np.zeros((len(texts), many)), np.zeros(len(texts), bool)
            part, size = [], 0
            for row, text in enumerate(texts):
                items = list(Counter(words_of(text)).items()) if trie else []
                some[row] = bool(items)
                for at in range(0, len(items), run):
                    part.append((row, items[at : at + run]))
                    size += len(part[-1][1])
                    if size >= run:
                        add(part, total)
                        part, size = [], 0
            if part:
                add(part, total)
            top = total.argmax(1) if many else np.zeros(len(texts), int)
            best = total[np.arange(len(texts)), top] if many else np.zeros(len(texts))
            sure = 1 / np.exp(np.clip(total - best[:, None], -700, 0)).sum(1) if many else best
            yield pd.DataFrame({"lang_pred": [model.names[t] if s else "und" for t, s in zip(top, some, strict=True)], "score": np.where(some, sure, 0.0)})

    guess = F.pandas_udf(predict, "lang_pred string, score double")
    return docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), guess("text").alias("g")).select("doc_id", "held_out", "g.*")
