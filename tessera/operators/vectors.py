"""Vector collections: scores, exact nearest neighbours, metadata filters, time travel, quantisation.

Collections have vec_key, embedding (array of floats), metadata (JSON object or null), created_us, deleted_us.
Scores grow with nearness: cosine (0 for a zero vector), 1 / (1 + distance), or the inner product.
Filters hold before the best are taken, so k rows come whenever k match.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonpath

METRICS = {
    "cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot_product": "dot", "dot": "dot", "inner_product": "dot",
}


class DimensionMismatch(ValueError):
    """A vector has another length than its collection."""


def check(vector: list[float], dim: int) -> list[float]:
    if len(vector) != dim:
        raise DimensionMismatch(f"{len(vector)} components where the collection has {dim}")
    if not all(map(math.isfinite, vector)):
        raise ValueError("a component is not finite")
    return [float(x) for x in vector]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(embedding: Column | str, query: Column | list[float], metric: str) -> Column:
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    q = F.array(*(F.lit(float(x)) for x in query)) if isinstance(query, list) else query
    kind = METRICS[metric]
    if kind == "dot":
        return _dot(e, q)
    if kind == "euclidean":
        d2 = F.aggregate(F.zip_with(e, q, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        return 1 / (1 + F.sqrt(d2))
    norms = _dot(e, e) * _dot(q, q)
    return F.when(norms > 0, _dot(e, q) / F.sqrt(norms)).otherwise(0.0)


def condition(field: str, op: str, value) -> Column:
    """A metadata condition: eq ne gt gte lt lte in contains. It fails where the field is missing, ne too.

    Values are equal if their types are; numbers are compared with numbers only; contains is a substring.
    """
    got = F.try_variant_get(F.try_parse_json("metadata"), jsonpath.spark_path(field) if field else "$", "variant")
    kind = F.schema_of_variant(got)
    text = F.to_json(got)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(F.try_parse_json("metadata"), jsonpath.spark_path(field), "double"))
    string = F.when(kind == "STRING", F.try_variant_get(F.try_parse_json("metadata"), jsonpath.spark_path(field), "string"))

    def equal(v) -> Column:
        if isinstance(v, str):
            return string == v
        if isinstance(v, bool) or v is None:
            return text == jsonpath.canonical(v)
        whole = kind == "BIGINT" if isinstance(v, int) else ~kind.isin("BIGINT")
        return (number == float(v)) & whole

    if op == "in":
        found = reduce(lambda a, b: a | b, (F.coalesce(equal(v), F.lit(False)) for v in value), F.lit(False))
    elif op == "contains":
        found = string.contains(value)
    elif op in ("eq", "ne"):
        found = F.coalesce(equal(value), F.lit(False))
        found = found if op == "eq" else ~found & got.isNotNull()
    else:
        found = {"gt": number > value, "gte": number >= value, "lt": number < value, "lte": number <= value}[op]
    return F.coalesce(found, F.lit(False))


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", filters: list[tuple] = (), as_of_us: int | None = None, between_us: tuple[int, int] | None = None) -> DataFrame:
    """The k best rows with their score; ties to the smaller key.

    as_of_us: of the vectors alive then. between_us: of those created within the two times and not deleted since.
    """
    rows = vectors
    if as_of_us is not None:
        rows = rows.where((F.col("created_us") <= as_of_us) & (F.col("deleted_us").isNull() | (F.col("deleted_us") > as_of_us)))
    else:
        rows = rows.where("deleted_us IS NULL")
    if between_us is not None:
        rows = rows.where(F.col("created_us").between(*between_us))
    for f in filters:
        rows = rows.where(condition(*f))
    return rows.withColumn("score", score("embedding", query, metric)).orderBy(F.desc("score"), "vec_key").limit(k)


def collection_stats(vectors: DataFrame, by: str = "collection") -> DataFrame:
    """Live vectors, their dimension and bytes, by collection; names that begin with _ are internal."""
    live = vectors.where("deleted_us IS NULL").where(~F.col(by).startswith("_"))
    return live.groupBy(by).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension"), F.sum(4 * F.size("embedding")).cast("bigint").alias("bytes"))


def sq8_bounds(vectors: DataFrame, dim: int) -> tuple[list[float], list[float]]:
    """Least and greatest value of each component."""
    aggs = [f(F.get("embedding", F.lit(i)).cast("double")).alias(f"{n}{i}") for i in range(dim) for n, f in (("a", F.min), ("b", F.max))]
    row = vectors.agg(*aggs).first()
    return [row[f"a{i}"] for i in range(dim)], [row[f"b{i}"] for i in range(dim)]


def sq8(vectors: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Adds code: each component as round((x - low) / scale) in 0..255, scale a 255th of the component's range."""
    scales = [(b - a) / 255 if b > a else 1.0 for a, b in zip(low, high)]
    lows, steps = (F.array(*(F.lit(float(x)) for x in v)) for v in (low, scales))
    code = F.transform("embedding", lambda x, i: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x.cast("double") - F.get(lows, i)) / F.get(steps, i)).cast("int"))))
    return vectors.withColumn("code", code)


def sq8_decode(code: Column | str, low: list[float], high: list[float]) -> Column:
    scales = [(b - a) / 255 if b > a else 1.0 for a, b in zip(low, high)]
    lows, steps = (F.array(*(F.lit(float(x)) for x in v)) for v in (low, scales))
    return F.transform(code, lambda c, i: F.get(lows, i) + c * F.get(steps, i))


def binary_code(vectors: DataFrame, centre: list[float]) -> DataFrame:
    """Adds bits: a text of 0 and 1, the sign of each component about the centre, the first one first."""
    c = F.array(*(F.lit(float(x)) for x in centre))
    bits = F.transform("embedding", lambda x, i: F.when(x.cast("double") >= F.get(c, i), "1").otherwise("0"))
    return vectors.withColumn("bits", F.array_join(bits, ""))
