"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import knn, lines, mixing, pieces, quality_rules, quality_sql, simhash, site_quality, text, tokens, toxicity, warc
from tessera.session import fresh_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.n_words("text").alias("n"))
    mixed = mixing.mix(docs, F.col("n"), weights=(5, 2, 1), share=1.5, cap=2.0)
    taken = (F.col("size") * F.col("copies")).cast("bigint")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.reject_outliers(table(spark, sf_dir, "documents"))


def op3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = tokens.write_tokens(docs, fresh_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return tokens.read_digests(manifest)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"), min_bytes=100)
    captures = warc.assemble(warc.read_warc(written, with_payload=False))
    field = lambda name: F.col("metadata.fields")[name].try_cast("bigint")
    return captures.select(
        field("pageId").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payloadLength")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        field("refersToPage").alias("refers_to"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels, teaches=~held_out))
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.encode_and_decode(docs, model, key="doc_id", alpha=1.0, seed=11)
    return back.select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10, min_docs=2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdict.select("doc_id", "evidence", "site_rate", "quality", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), k=3, words=1, radius=2, blocks=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_quality_rules, op3_knn, op4_tokens, op5_warc, op6_toxicity, op7_pieces, op8_lines, op9_site_quality, op10_simhash)
}

#: The mix in SQL: sizes, the level of the targets, cells of (source, octave of sizes, slice), and each document's place.
_OP1 = """WITH d AS (SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS u, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
x AS (SELECT *, length(bin(size)) AS oct, ('0x' || md5('17:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % (SELECT least(4096, greatest(64, count(*) // 2000)) FROM documents) AS slice FROM d),
z AS (SELECT u, s, sum(size)::BIGINT AS source_size FROM x GROUP BY 1, 2),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY u, s) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w FROM z),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
  - coalesce(sum(cap) OVER (ORDER BY cap / w, u, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, u, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT u, s, source_size, least(cap, (max(level) OVER ()) * w) AS target,
  ('0x' || md5('17:' || u || ':' || s)[1:8])::BIGINT % 1048576 / 1048576.0::DOUBLE AS o FROM l),
p AS (SELECT x.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, o,
  row_number() OVER (PARTITION BY x.u, x.s ORDER BY oct, slice, size, doc_id) AS place FROM x JOIN t ON x.u = t.u AND x.s = t.s)
SELECT doc_id, size, source_size, target, size * least(floor(rate * place + o) - floor(rate * (place - 1) + o), ceil(rate))::BIGINT AS taken FROM p"""

_OP3 = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

_OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, strlen(b) AS payload_bytes, d AS payload_digest, CASE WHEN strlen(b) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(b) >= 100 AND page_id > first THEN first END AS refers_to FROM f"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP8 = f"""WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM a),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, s.key IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": _OP1, "op2_quality_rules": quality_sql.sql(), "op3_knn": _OP3, "op5_warc": _OP5, "op8_lines": _OP8}
