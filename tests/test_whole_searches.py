"""Searches of documents without a limit give all matches."""

import pytest

from tessera.operators import documents
from tessera.operators.documents import Index, Range
from tessera.plans.registry import QUERIES


def test_no_limit(spark):
    docs = spark.range(40).selectExpr("concat('d', id) AS doc_id", "concat('{\"size\":', id, '}') AS doc")
    size = [Index("size", "size", "numeric")]
    found = documents.search(docs, size, Range("size", 5), sort="size", limit=None)
    assert [r["doc_id"] for r in found.collect()] == [f"d{i}" for i in range(5, 40)]
    assert documents.search(docs, size).count() == 10


@pytest.mark.parametrize("name", ["json_index_eq", "json_index_range", "json_index_prefix", "json_filter_and_or"])
def test_queries_have_no_limit(spark, tmp_path, name):
    part = "id AS p_partkey, 'red x' AS p_name, 'Brand#2' AS p_brand, 'T' AS p_type, cast(id AS int) AS p_size"
    spark.range(30).selectExpr(*part.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
