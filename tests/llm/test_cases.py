"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import htmltext, langid, media, mixing, packing, pii, quality, simhash, similar, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a" * 200_000 + " " + "word another thing " * 20_000 + " 1.2.3.4 " + "9" * 5_000 + "@" * 2_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "s1", 5),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "s1", 5),
    (2, None, "de", None, None), (3, "", None, "s2", 0), (None, "mail me at a.b@c.example.org or +1 (017) 555-7713", None, None, None),
    (None, None, None, None, None), (4, " \n\t ", "fr", "s1", 3), (5, LONG, "en", "s3", len(LONG)), (6, "𝒳 😀 ünï\u0000cödé 4111 1111 1111 1111", "xx", "s1", 9),
    (7, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "s2", 5),
]
EXTRA = "key fp node root label epoch weight row block h kept score voxloom_x shard".split()


def docs_of(spark, kind):
    if kind == "empty":
        return spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)]) if kind == "clashing" else docs


def labels_of(spark, kind):
    rows = [] if kind == "empty" else [(1, 1, 0), (1, 0, 0), (5, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


KINDS = ("plain", "clashing", "empty")
OPERATORS = {
    "pii": lambda s, d, l: pii.find(d), "redact": lambda s, d, l: pii.redact(d), "langid": lambda s, d, l: langid.identify(d, langid.train(d)), "simhash": lambda s, d, l: simhash.near_duplicates(d),
    "keep_one": lambda s, d, l: simhash.keep_one(d), "similar": lambda s, d, l: similar.keep_one(d), "mixing": lambda s, d, l: mixing.mix_sources(d, mixing.Plan(max_repeats=3.0, budget="cover")), "quality": lambda s, d, l: quality.judge(d, quality.train(d, l)),
    "tokens": lambda s, d, l: tokens.count_tokens(d), "toxicity": lambda s, d, l: toxicity.score(d, toxicity.train(d, l)), "packing": lambda s, d, l: packing.pack_documents(d),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name, kind):
    docs = docs_of(spark, kind)
    got = OPERATORS[name](spark, docs, labels_of(spark, kind)).collect()
    n = 0 if kind == "empty" else len(ROWS)
    if name in ("pii", "redact", "langid", "simhash", "quality", "tokens", "toxicity"):
        assert len(got) == n  # every row gets a result
    if kind == "empty":
        assert got == []
    elif name in ("keep_one", "similar"):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]  # 7 is a copy of 1; 3, 4 and the nameless null are empty like 2
    elif name == "packing":
        assert sorted((d is None, d or 0) for r in got for d in set(r.doc_ids)).count((False, 1)) >= 1
        assert sum(sum(r.lengths) for r in got) == sum(len((t or "").split()) for _, t, *_ in ROWS)
        assert sum(len(r.doc_ids) for r in got) >= n
    elif name == "mixing":
        assert len({(r.doc_id, r.text) for r in got}) == len({(r[0], r[1]) for r in ROWS})  # cover drops nothing
    elif name == "langid":
        assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4) or (r.doc_id is None and r.score == 0)) for r in got)


@pytest.mark.parametrize("kind", KINDS)
def test_stages(spark, tmp_path, kind):
    labels_of(spark, kind).write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs_of(spark, kind)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            docs = spark.read.parquet(str(tmp_path / str(k)))
    assert (spark.read.parquet(str(tmp_path / str(k))).count() == 0) == (kind == "empty")


@pytest.mark.parametrize("kind", KINDS)
def test_pages(spark, kind):
    rows = [] if kind == "empty" else [(1, "u", "<article><p>One.</p></article>"), (1, "u", "<article><p>One.</p></article>"), (None, None, None), (2, "", ""), (3, "x", "<p" * 20_000), (4, "x", "<div>" * 5_000 + "&lt;a&amp;b" + "</div>" * 9), (5, "y", "<article>" + "<p>word &eacute; <b>x</b>\n y</p>" * 3_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("text", "n_chars")}) if kind == "clashing" else pages
    got = htmltext.extract(pages, htmltext.trained(300)).collect()
    assert len(got) == len(rows)
    if rows:
        by = {r.page_id: r for r in got}
        assert by[None].text == "" and by[2].text == "" and by[1].text == "One." and by[1].n_chars == 4
        assert by[5].text == "\n".join(["word é x y"] * 3_000)


@pytest.mark.parametrize("kind", KINDS)
def test_images(spark, kind):
    bad = [b"", b"P5 9 9 255\n", b"\x89PNG\r\n\x1a\n12", b"P5 64 64 255\n" + bytes(4096), b"P5 1"]
    rows = [] if kind == "empty" else [(1, bytearray(bad[0])), (2, bytearray(bad[1])), (3, bytearray(bad[2])), (4, bytearray(bad[3])), (5, bytearray(bad[3])), (5, None), (6, None), (None, bytearray(bad[4])), (None, None)]
    table = spark.createDataFrame(rows, "media_id long, image binary")
    table = table.withColumns({c: F.lit(1) for c in ("node", "corners", "k")}) if kind == "clashing" else table
    got = sorted(((r.media_id, r.class_id) for r in media.copies(table).collect()), key=str)
    assert got == ([] if kind == "empty" else sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 5), (6, 6), (None, None), (None, None)], key=str))
