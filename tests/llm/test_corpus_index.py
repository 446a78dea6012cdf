"""Repeated passages, ranked search and the manifest against brute force, and their queries against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_oracles import rows as comparable

from voxloom.llm import manifest, passages, queries, search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "chunk spans s_id bucket segment query rank group place digest proof leaf text_hash".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert comparable(got) == comparable(want)


def corpus(seed: int, n: int = 120, words: int = 8) -> list[tuple]:
    """Texts of few different words, some taken over from others, with nulls, repeated rows and one long text."""
    r = random.Random(seed)
    texts: list[str | None] = []
    for _ in range(n):
        some = r.choices([f"w{k}" for k in range(words)] + ["é", "W1", "日本"], k=r.randint(0, 40))
        if texts and r.random() < 0.5 and (other := r.choice(texts)):
            at = r.randint(0, len(some))
            some[at:at] = other.split()[: r.randint(0, 30)]
        texts.append(r.choice((" ", "  ", "\n", "\t \v")).join(some))
    texts += [None, "", " \n ", "w1 " * 40_000, "x" * 300_000 + " w1 w2", texts[3], texts[3]]
    out = [(r.choice((None, *range(90))) if k % 7 else k + 100, t, r.choice(("en", "de", None)), "s", k) for k, t in enumerate(texts)]
    return out + [out[5], out[5]]


def table(spark, some, kind):
    docs = spark.createDataFrame([] if kind == "empty" else some, SCHEMA).repartition(3)
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)]) if kind == "clashing" else docs


def plain_repeats(some, width):
    least: dict[tuple, int] = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in some]
    for d, w in split:
        for k in range(len(w) - width + 1) if d is not None else ():
            least[tuple(w[k : k + width])] = min(d, least.get(tuple(w[k : k + width]), d))
    out = []
    for d, w in split:
        gone = {k + j for k in range(len(w) - width + 1) if d is not None and least[tuple(w[k : k + width])] < d for j in range(width)}
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("kind", "width", "chunk", "broadcast"), [("plain", 3, 300, 1 << 20), ("clashing", 5, 1 << 20, 0), ("plain", 1, 2000, 0), ("empty", 13, 1 << 20, 0)])
def test_repeats_against_brute_force(spark, kind, width, chunk, broadcast):
    some = corpus(width)
    got = passages.without_repeats(table(spark, some, kind), width, chunk, broadcast).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == ([] if kind == "empty" else plain_repeats(some, width))
    for r in got:  # intervals are maximal: none touches the next
        assert sum(s.end - s.start for s in r.spans or ()) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans or (), (r.spans or ())[1:], strict=False))


def test_a_passage_of_all_documents(spark):
    """One window in every document: each chunk sends it once, and only the least document keeps it."""
    shared = " ".join(f"common{k}" for k in range(20))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), "id", F.lit(f" {shared} end"), "id").alias("text")).repartition(6)
    got = passages.without_repeats(docs, 13, 20_000).groupBy("n_removed").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).collect()
    assert {(r.n_removed, r.n, r.first) for r in got} == {(0, 1, 0), (20, 2999, 1)}


def test_rolling_hashes():
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["ab", "ba", "a", "bb", "x" * 3000], 400)).encode() for _ in range(5)]
    size, passages.SLICE = passages.SLICE, 5000
    try:
        data, start, end, _ = passages.words_in(texts)
        got = passages.word_hashes(data, start, end)
    finally:
        passages.SLICE = size
        passages.small_power_table.cache_clear()
    by = {}
    for h, a, b in zip(got.tolist(), start, end, strict=True):
        by.setdefault(bytes(data[a:b]), set()).add(h)
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by) == 5  # the same wherever a word stands
    for values in (np.array([], np.uint64), r.integers(0, 1 << 64, 1000, dtype=np.uint64)):
        assert (passages.unpacked(passages.packed(values), len(values)) == values).all()
        assert (passages.unpacked(passages.packed(np.sort(values), True), len(values), True) == np.sort(values)).all()


def plain_search(docs, items, k):
    terms = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    split = [(d, terms(t)) for d, t, *_ in docs]
    split = [(d, Counter(w), len(w)) for d, w in split if w]
    n, total = len(split), sum(x[2] for x in split)
    df = Counter(w for _, c, _ in split for w in c)
    out = []
    for item, text in items:
        hits = []
        for d, c, length in split:
            m = 10 + 90 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            hits += [(-score, d is None, d)] * (score > 0)
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("kind", "documents", "postings", "block"), [("plain", 4096, 1 << 20, 1 << 20), ("clashing", 7, 1 << 20, 9000), ("plain", 300, 20, 1 << 20), ("empty", 9, 9, 1 << 20)])
def test_search_against_brute_force(spark, kind, documents, postings, block):
    """Few words make many ties, also across segments and at the last rank."""
    some = corpus(documents, 400, 30)
    items = [(1, "w1 W3 w3 nowhere"), (2, None), (3, ""), (4, "日本-é w29 w28"), (4, "日本-é w29 w28"), (None, "w5 w6 w7 w8"), (5, "..."), (6, "w1 " * 5000)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(table(spark, some, kind), asked, 10, block, documents, postings).collect()
    assert sorted((tuple(r) for r in got), key=str) == ([] if kind == "empty" else plain_search(some, items, 10))
    assert search.search(table(spark, some, kind), asked.limit(0)).collect() == []


def test_a_tree_opens_only_what_can_win():
    """Of 4096 documents one has both rare terms; the search finds it without reading most ranges."""
    n = 4096
    terms = np.concatenate([np.zeros(n, np.int64), [1]])
    docs = np.concatenate([np.arange(n), [1234]])
    row = {"segment": 0, "ids": np.arange(n), "named": np.ones(n, bool), "lengths": np.full(n, 50), "terms": [0, 1], "ends": [n, n + 1], "docs": docs, "counts": np.ones(len(terms), np.int64)}
    tree = search.Segment(row, np.array([100, 5000]), (n, 50 * n))
    opened = []
    below = tree.below
    tree.below = lambda level, node, q: opened.append((level, node)) or below(level, node, q)
    assert tree.best(np.array([0, 1]), 1, 1)[0][2] == 1234 and len(opened) <= 5
    opened.clear()
    assert [d for _, _, d in tree.best(np.array([0]), 10, 1)] == list(range(10))  # all documents tie: ids decide
    assert len(opened) > n // 16


def plain_manifest(some):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: h(*map(field, (d, s, lang, n, t)))
    leaves = [leaf(*r) for r in some]
    langs = sorted({r[2] for r in some}, key=lambda x: (x is not None, (x or "").encode()))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    def path(levels, k):
        return [(k >> i & 1, level[(k >> i) ^ 1] if (k >> i) ^ 1 < len(level) else "") for i, level in enumerate(levels[:-1])]

    own = {x: sorted((k for k, r in enumerate(some) if r[2] == x), key=lambda k: (some[k][0] is not None, some[k][0] or 0, leaves[k])) for x in langs}
    trees = {x: tree([leaves[k] for k in ks]) for x, ks in own.items()}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for g, lang in enumerate(langs):
        for place, k in enumerate(own[lang]):
            d, t, _, s, n = some[k]
            proof = path(trees[lang], place) + path(top, g)
            bad = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
            node = leaf(d, t, lang, s, n + 1) if bad else leaves[k]
            for odd, other in proof:
                node = h(other, node) if odd else h(node, other)
            out.append((d, leaves[k], trees[lang][-1][0], top[-1][0], h(*[x for _, x in proof]), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["plain", "clashing", "empty", "sizes", "one"])
def test_manifest_against_brute_force(spark, kind):
    r = random.Random(7)
    some = corpus(2)
    if kind == "sizes":  # groups about the height of a band, and a hot one
        sizes = {None: 1, "a": 2, "b": 1023, "c": 1024, "d": 1025, "é": 5000, "B": 3}
        some = [(r.randrange(10**17), f"t{k}", lang, None if k % 5 else "s", k) for lang, n in sizes.items() for k in range(n)]
        r.shuffle(some)
    some = [(7, "only", "x", None, None)] if kind == "one" else some
    got = manifest.manifest(table(spark, some, kind), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    got = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(x) for x in got), key=str) == ([] if kind == "empty" else plain_manifest(some))


def test_repeated_rows_of_a_manifest(spark):
    """A third of all rows are one row: each is a leaf of its own."""
    some = [(1, "same", "en", "s", 4)] * 700 + [(k, f"t{k}", "en", "s", k) for k in range(1400)]
    got = manifest.manifest(table(spark, some, "plain")).collect()
    assert len(got) == 2100 and all(x.verified for x in got) and len({x.place for x in got}) == 2100 and {x.root for x in got} == {x[3] for x in plain_manifest(some)}
