"""Queries of import and export, and of the relational forms that the operators are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import documents
from tessera.plans.registry import query
from tessera.plans.views import part_docs
from tessera.session import fresh_path, table
from tessera.sources import interchange


@query("""SELECT 'P' || p_partkey AS key, p_name AS value FROM part""")
def import_kv_infer(spark, sf_dir):
    two = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"))
    return interchange.to_kv(two).select("key", "value")


@query("""SELECT c_custkey::VARCHAR AS key, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS value FROM customer WHERE c_custkey % 2 = 0""")
def import_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return interchange.to_documents(rows).select("key", F.col("doc").alias("value"))


@query("""SELECT vec_id::VARCHAR AS vec_key, 64 AS dimension, '{"label":' || label || '}' AS metadata FROM embeddings""")
def import_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return interchange.to_vectors(rows).select("vec_key", F.size("embedding").alias("dimension"), "metadata")


@query("SELECT s_suppkey::VARCHAR AS key, s_name AS name, s_nationkey AS nation FROM supplier")
def export_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    path = fresh_path(spark, "export") + ".parquet"
    interchange.write(rows, path)
    return interchange.read(spark, path).select("key", "name", "nation")


@query("""SELECT c_custkey::VARCHAR AS key, 'said "' || c_name || '",' || chr(10) || 'twice' AS value FROM customer""")
def export_csv_round_trip(spark, sf_dir):
    """Values with quotes, commas and line feeds, through CSV."""
    value = F.concat(F.lit('said "'), F.col("c_name"), F.lit('",\ntwice')).alias("value")
    path = fresh_path(spark, "export") + ".csv"
    interchange.write(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), value), path)
    return interchange.to_kv(interchange.read(spark, path)).select("key", "value")


@query("""SELECT 'part:' || p_partkey AS key, p_brand AS brand, p_type AS kind, p_name AS name, p_size::VARCHAR AS size FROM part""")
def export_kv_table(spark, sf_dir):
    leaves = documents.flatten_export(part_docs(spark, sf_dir)).where("path <> 'tags'")
    return interchange.kv_table(leaves, ["maker.brand", "maker.kind", "name", "size"]).toDF("key", "brand", "kind", "name", "size")


@query("SELECT count(*) AS rows_skipped FROM customer WHERE c_custkey % 2 <> 0")
def import_rows_skipped(spark, sf_dir):
    return interchange.skipped(table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("key")))


@query("""SELECT n_name, r_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def relational_join_aggregate(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def relational_hash_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def relational_anti_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
