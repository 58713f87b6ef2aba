"""The registered query of each operator: production parameters, whole tables, the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adscan, alignment, fingerprints, jaccard, langid, licenses, mixing, mtree, packing, quality, substrings, variants, warc
from .common import crc_mod, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify_language(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, 20, ["doc_id"]).drop("kept")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, licenses.train(docs))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(*warc.write_archives(table(spark, sf_dir, "pages")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, mixing.tempered(docs)).select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"), "block", "slot", "block_offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, forest, 0.3, ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), 4, 85, 100)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.score_links(docs, tokenizer(), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.vocabulary(table(spark, sf_dir, "documents")))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adscan.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_language_id, op3_substrings, op4_top_k, op5_licenses, op6_warc, op7_mixing, op8_quality, op9_packing, op10_jaccard, op11_alignment, op12_variants, op13_neighbours)}
_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What SQL can express of the contracts, in DuckDB's dialect; ids are taken to be unique, as in the tables.
ORACLE_SQL: dict[str, str] = {
    "op3_substrings": f"""WITH d AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
kept AS (SELECT d.doc_id, u.p, w[u.p] AS word FROM d, (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM d) u WHERE d.doc_id = u.doc_id),
left_over AS (SELECT k.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k.p) AS t FROM kept k LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.p = k.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256 FROM d LEFT JOIN left_over l USING (doc_id)""",
    "op4_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) SELECT query_id, CAST(rn AS INT) AS rank, vec_id, score FROM r WHERE rn <= 10""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m""",
    "op10_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(x=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
half AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)), links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
}
