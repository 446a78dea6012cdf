"""Token counts of whole texts under a fixed unigram model, by a program over the trie of pre-tokens.

Pre-tokens are the words with a leading mark, as in the vocabulary. The distinct pre-tokens of a
batch are sorted into a trie of their own; the best score of each prefix is computed once for
all pre-tokens that share it, and each terminal node stores its count. Counts are kept for the
task, up to `most_cached` pre-tokens. Nothing is shuffled; whole texts are read.

The vocabulary is public and fixed. Its pieces come in the order in which they were merged, and
the unigram scores follow from that rank alone: -log(rank + 2). Nothing is trained.

Defined results: a null or empty text has no tokens; a null doc_id stays a row; repeated rows
are counted alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.pieces import DEFAULT_MODEL, MARK, PieceTrie, best_counts, load_pieces


def rank_scores(n: int) -> tuple[np.ndarray, float]:
    """Scores of n pieces by rank, and of a byte."""
    return -np.log(np.arange(n) + 2.0), float(-np.log(n + 2.0))


def count_tokens(docs: DataFrame, model_path: str = DEFAULT_MODEL, most_cached: int = 400_000) -> DataFrame:
    """doc_id, n_words and n_tokens for each row."""
    pieces = load_pieces(model_path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = PieceTrie(pieces)
        scores, byte_score = rank_scores(len(pieces))
        known: dict[bytes, int] = {}
        for texts in batches:
            counted = [Counter((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
            if len(known) > most_cached:
                known = {}
            new = list({w for c in counted for w in c if w not in known})
            if new:
                terminal = best_counts([MARK + w.decode("utf-8", "surrogatepass") for w in new], trie, scores, byte_score)
                known |= dict(zip(new, terminal.tolist(), strict=True))
            yield pd.DataFrame({"n_words": [c.total() for c in counted], "n_tokens": [sum(n * known[w] for w, n in c.items()) for c in counted]})

    return docs.select("doc_id", F.pandas_udf(count, "n_words long, n_tokens long")("text").alias("t")).select("doc_id", "t.*")
