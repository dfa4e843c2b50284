"""Queries over JSON documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.operators import cells, documents, vectors
from tessera.operators.documents import And, Eq, Index, Or, Prefix, Range
from tessera.plans.registry import query
from tessera.plans.views import HOUR_US, T_US, VECTOR_SQL, part_docs, vector_rows
from tessera.session import ship, table

INDEXES = [Index("size", "size", "numeric"), Index("brand", "maker.brand", "tag"), Index("name", "name", "text")]


@query("SELECT 'part:' || p_partkey AS doc_id, p_brand AS brand, p_brand AS second_tag, p_size::VARCHAR AS size, NULL::VARCHAR AS missing FROM part")
def json_get_path(spark, sf_dir):
    get = lambda p: jsonpath.get_column("doc", p)
    return part_docs(spark, sf_dir).select("doc_id", get("maker.brand").alias("brand"), get("tags[1]").alias("second_tag"), get('["size"]').alias("size"), get("maker.none").alias("missing"))


@query("SELECT 'part:' || p_partkey AS doc_id FROM part WHERE lower(p_brand) = 'brand#2'")
def json_index_eq(spark, sf_dir):
    return documents.search(part_docs(spark, sf_dir), INDEXES, Eq("maker.brand", "BRAND#2"), limit=None).select("doc_id")


@query("SELECT 'part:' || p_partkey AS doc_id FROM part WHERE p_size > 10 AND p_size <= 20")
def json_index_range(spark, sf_dir):
    return documents.search(part_docs(spark, sf_dir), INDEXES, Range("size", 10, 20, low_in=False), limit=None).select("doc_id")


@query("SELECT 'part:' || p_partkey AS doc_id FROM part WHERE starts_with(lower(p_name), 'red')")
def json_index_prefix(spark, sf_dir):
    return documents.search(part_docs(spark, sf_dir), INDEXES, Prefix("name", "Red"), limit=None).select("doc_id")


@query("SELECT 'part:' || p_partkey AS doc_id FROM part WHERE (p_size < 5 OR starts_with(lower(p_name), 'blue')) AND p_size >= 2")
def json_filter_and_or(spark, sf_dir):
    flt = And((Or((Range("size", high=5, high_in=False), Prefix("name", "blue"))), Range("size", low=2)))
    return documents.search(part_docs(spark, sf_dir), INDEXES, flt, limit=None).select("doc_id")


@query("SELECT 'part:' || p_partkey AS doc_id, p_size::DOUBLE AS size, 1.0::DOUBLE AS score FROM part ORDER BY p_size DESC, doc_id DESC LIMIT 15")
def json_sort_by(spark, sf_dir):
    rows = documents.search(part_docs(spark, sf_dir), INDEXES, sort="size", descending=True, limit=15)
    return rows.select("doc_id", F.col("ix_size").alias("size"), "score")


@query("""SELECT 'part:' || p_partkey AS doc_id, p_brand || '!' AS brand, NULL::VARCHAR AS name, '7' AS extra FROM part""")
def json_merge_patch(spark, sf_dir):
    ship(spark)
    docs = part_docs(spark, sf_dir)
    brand = jsonpath.get_column("doc", "maker.brand")
    patch = F.concat(F.lit('{"name":null,"extra":7,"maker":{"brand":"'), brand, F.lit('!"}}'))
    merged = jsonpath.merge_patch_column(F.col("doc"), patch)
    out = docs.select("doc_id", merged.alias("m"))
    return out.select("doc_id", *(jsonpath.get_column("m.doc", p).alias(a) for p, a in (("maker.brand", "brand"), ("name", "name"), ("extra", "extra"))))


@query("""SELECT 'part:' || p_partkey AS doc_id, p_partkey::VARCHAR AS made, NULL::VARCHAR AS error, 'an index beyond the end of an array' AS error2 FROM part""")
def json_set_path(spark, sf_dir):
    ship(spark)
    docs = part_docs(spark, sf_dir)
    number = F.substring_index("doc_id", ":", -1)
    ok = jsonpath.set_column(F.col("doc"), F.lit("stock.sites[0].code"), number)
    bad = jsonpath.set_column(F.col("doc"), F.lit("tags[9]"), F.lit("1"))
    out = docs.select("doc_id", ok.alias("a"), bad.alias("b"))
    return out.select("doc_id", jsonpath.get_column("a.doc", "stock.sites[0].code").alias("made"), F.col("a.error").alias("error"), F.col("b.error").alias("error2"))


@query("""SELECT 'part:' || p_partkey AS doc_id, '["' || p_brand || '"]' AS tags, NULL::VARCHAR AS name FROM part""")
def json_delete_path(spark, sf_dir):
    ship(spark)
    first = part_docs(spark, sf_dir).select("doc_id", jsonpath.delete_column(F.col("doc"), F.lit("tags[0]")).alias("d"))
    both = first.select("doc_id", jsonpath.delete_column(F.col("d.doc"), F.lit("name")).alias("d"))
    return both.select("doc_id", jsonpath.get_column("d.doc", "tags").alias("tags"), jsonpath.get_column("d.doc", "name").alias("name"))


@query("""WITH p AS (SELECT 'part:' || p_partkey AS key, * FROM part)
SELECT key, 'name' AS path, p_name AS value FROM p UNION ALL SELECT key, 'maker.brand', p_brand FROM p UNION ALL SELECT key, 'maker.kind', p_type FROM p
UNION ALL SELECT key, 'size', p_size::VARCHAR FROM p UNION ALL SELECT key, 'tags', '["' || p_type || '","' || p_brand || '"]' FROM p""")
def json_flatten_export(spark, sf_dir):
    return documents.flatten_export(part_docs(spark, sf_dir))


@query("""WITH k AS (SELECT 'part:' || p_partkey AS doc_id FROM part)
SELECT doc_id, (SELECT count(*) FROM k WHERE doc_id > 'part:10') > 5 AS has_more FROM k WHERE doc_id > 'part:10' AND EXISTS (SELECT 1 FROM k WHERE doc_id = 'part:10') ORDER BY doc_id LIMIT 5""")
def json_page_after(spark, sf_dir):
    keys = part_docs(spark, sf_dir).select(F.col("doc_id").alias("key"))
    return cells.page_after_member(keys, 5, "part:10").select(F.col("key").alias("doc_id"), "has_more")


V = f"WITH {VECTOR_SQL}"


def _probe(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _knn(spark, sf_dir, k, **how):
    best = vectors.nearest(vector_rows(spark, sf_dir), _probe(spark, sf_dir), k, **how)
    return best.select("vec_key", F.round("score", 6).alias("score"))


@query(f"{V} SELECT vec_key, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE deleted_us IS NULL ORDER BY list_cosine_similarity(e, q) DESC, vec_key LIMIT 10")
def vector_knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, 10)


@query(f"{V} SELECT vec_key, round(1 / (1 + list_distance(e, q)), 6) AS score FROM v, q WHERE deleted_us IS NULL ORDER BY list_distance(e, q), vec_key LIMIT 10")
def vector_knn_euclidean(spark, sf_dir):
    return _knn(spark, sf_dir, 10, metric="l2")


@query(f"{V} SELECT vec_key, round(list_dot_product(e, q), 6) AS score FROM v, q WHERE deleted_us IS NULL ORDER BY list_dot_product(e, q) DESC, vec_key LIMIT 10")
def vector_knn_dot(spark, sf_dir):
    return _knn(spark, sf_dir, 10, metric="inner_product")


@query(f"""{V} SELECT vec_key, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE deleted_us IS NULL AND label >= 3 AND label NOT IN (5) AND ('v' || vec_key) LIKE '%1%'
ORDER BY list_cosine_similarity(e, q) DESC, vec_key LIMIT 10""")
def vector_knn_filtered(spark, sf_dir):
    return _knn(spark, sf_dir, 10, filters=[("label", "gte", 3), ("label", "ne", 5), ("name", "contains", "1")])


@query(f"""{V} SELECT vec_key, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE created_us <= {T_US + 100 * HOUR_US} AND (deleted_us IS NULL OR deleted_us > {T_US + 100 * HOUR_US})
ORDER BY list_cosine_similarity(e, q) DESC, vec_key LIMIT 10""")
def vector_knn_as_of(spark, sf_dir):
    return _knn(spark, sf_dir, 10, as_of_us=T_US + 100 * HOUR_US)


@query(f"""{V} SELECT vec_key, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE deleted_us IS NULL AND created_us BETWEEN {T_US + 20 * HOUR_US} AND {T_US + 80 * HOUR_US}
ORDER BY list_cosine_similarity(e, q) DESC, vec_key LIMIT 10""")
def vector_knn_in_range(spark, sf_dir):
    return _knn(spark, sf_dir, 10, between_us=(T_US + 20 * HOUR_US, T_US + 80 * HOUR_US))


@query(f"{V} SELECT 'c' || label AS collection, count(*) AS n, 64 AS dimension, count(*) * 256 AS bytes FROM v WHERE deleted_us IS NULL GROUP BY 1")
def vector_collection_stats(spark, sf_dir):
    return vectors.collection_stats(vector_rows(spark, sf_dir))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (SELECT i, min(x) AS lo, (max(x) - min(x)) / 255 AS st FROM x GROUP BY i)
SELECT vec_id AS vec_key, sum(greatest(0, least(255, round((x - lo) / st)::BIGINT)))::BIGINT AS code_sum FROM x JOIN b USING (i) GROUP BY 1""")
def vector_sq8(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    coded = vectors.sq8(rows, *vectors.sq8_bounds(rows, 64))
    return coded.select("vec_key", F.aggregate("code", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("code_sum"))


@query(f"""{V} SELECT vec_key, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE deleted_us IS NULL AND label IN (1, 3, 4) AND label < 4
ORDER BY list_cosine_similarity(e, q) DESC, vec_key LIMIT 10""")
def vector_knn_in_list(spark, sf_dir):
    return _knn(spark, sf_dir, 10, filters=[("label", "in", [1, 3, 4]), ("label", "lt", 4)])


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (SELECT i, min(x) AS lo, (max(x) - min(x)) / 255 AS st FROM x GROUP BY i)
SELECT vec_id AS vec_key, round(max(abs(lo + st * greatest(0, least(255, round((x - lo) / st)::BIGINT)) - x)), 6) AS worst FROM x JOIN b USING (i) GROUP BY 1""")
def vector_sq8_decode(spark, sf_dir):
    """How far the worst component comes back from its code."""
    rows = vector_rows(spark, sf_dir)
    low, high = vectors.sq8_bounds(rows, 64)
    back = vectors.sq8_decode("code", low, high)
    gaps = F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double")))
    return vectors.sq8(rows, low, high).select("vec_key", F.round(F.array_max(gaps), 6).alias("worst"))


@query("""SELECT vec_id AS vec_key, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings""")
def vector_binary_code(spark, sf_dir):
    return vectors.binary_code(vector_rows(spark, sf_dir), [0.0] * 64).select("vec_key", "bits")
