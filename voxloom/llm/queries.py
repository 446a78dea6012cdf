"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import htmltext, langid, manifest, media, mixing, packing, passages, pii, quality, search, simhash, tokens, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = mixing.mix_sources(read(spark, sf_dir, "documents"), mixing.Plan(target_entropy=0.97, max_repeats=4.0))
    return seen.select("doc_id", "source", "weight", "epoch", "block_turn", "doc_turn")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "voxloom_quality.*")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no images: each vector of embeddings is drawn, some once more as an edited copy."""
    return media.copies(media.drawn(read(spark, sf_dir, "embeddings")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.manifest(read(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = (op1_pii, op2_langid, op3_simhash, op4_mixing, op5_quality, op6_tokens, op7_media, op8_toxicity, op9_packing, op10_html, op11_passages, op12_search, op13_manifest)

FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF = " || ".join(FIELD.format(n if n != "n_chars" else "({0})") for n in manifest.FIELDS)
#: The unsigned CRC-32 of a document's id: bit by bit, as DuckDB has no such function.
CRC_32 = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"

#: Plain self-joins over whole tables, for the oracle's small ones.
ORACLES = {
    "op11_passages": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN least USING (s) WHERE first < doc_id),
every AS (SELECT doc_id, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(k)),
kept AS (SELECT * FROM every ANTI JOIN gone USING (doc_id, k)),
again AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(again.text, '')) AS kept_sha256
FROM d LEFT JOIN again USING (doc_id)""",
    "op12_search": r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM folded WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
asked AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM asked),
p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY 1),
hit AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term), whole GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM hit WHERE score > 0 QUALIFY rank <= 10""",
    "op13_manifest": f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce(dense_rank() OVER (ORDER BY lang NULLS FIRST), 0) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size,
    sha256({LEAF.format('n_chars')}) AS leaf, CASE WHEN CRC32 % 7 = 0 THEN sha256({LEAF.format('n_chars + 1')}) ELSE sha256({LEAF.format('n_chars')}) END AS shown FROM (SELECT *, {CRC_32} AS CRC32 FROM documents)),
t AS (SELECT 0 AS level, g, pos, size, leaf AS h FROM leaves
    UNION ALL SELECT level + 1, g, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE size > 1 GROUP BY level, g, pos // 2, size),
subroots AS (SELECT g, h AS subroot, level AS height FROM t WHERE size = 1),
u AS (SELECT 0 AS level, g AS pos, (SELECT count(*) FROM subroots) AS size, subroot AS h FROM subroots
    UNION ALL SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE size > 1 GROUP BY level, pos // 2, size),
steps AS (SELECT l.g, l.pos, t.level AS step, (l.pos >> t.level) & 1 AS odd, o.h FROM leaves l JOIN t ON t.g = l.g AND t.pos = l.pos >> t.level AND t.size > 1 LEFT JOIN t o ON o.level = t.level AND o.g = t.g AND o.pos = xor(t.pos, 1)
    UNION ALL SELECT l.g, l.pos, s.height + u.level, (l.g >> u.level) & 1, o.h FROM leaves l JOIN subroots s USING (g) JOIN u ON u.pos = l.g >> u.level AND u.size > 1 LEFT JOIN u o ON o.level = u.level AND o.pos = xor(u.pos, 1)),
paths AS (SELECT g, pos, list(h ORDER BY step) AS hs, list(odd ORDER BY step) AS odds, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY 1, 2),
fold AS (SELECT l.g, l.pos, 0 AS step, shown AS h, hs, odds FROM leaves l LEFT JOIN paths USING (g, pos)
    UNION ALL SELECT g, pos, step + 1, sha256(CASE WHEN hs[step + 1] IS NULL THEN h WHEN odds[step + 1] = 1 THEN hs[step + 1] || h ELSE h || hs[step + 1] END), hs, odds FROM fold WHERE step < coalesce(len(hs), 0))
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE size = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = (SELECT h FROM u WHERE size = 1) AS verified
FROM leaves JOIN subroots USING (g) LEFT JOIN paths USING (g, pos) JOIN fold ON fold.g = leaves.g AND fold.pos = leaves.pos AND step = coalesce(len(fold.hs), 0)""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
