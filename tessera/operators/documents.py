"""JSON documents: secondary indexes, filters over them, ordered search, flattening."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.session import ship

TEXT_BYTES = 128


class NotIndexed(ValueError):
    """A filter or an order names a field that has no index."""


@dataclass(frozen=True)
class Index:
    """An index of documents by what stands at a path: numeric, tag (whole string) or text (its first 128 bytes)."""

    name: str
    path: str
    kind: str

    def value(self, doc: Column | str = "doc") -> Column:
        """The indexed value, null where the document is not indexed: numbers only, or strings only, in lower case."""
        raw = F.try_variant_get(F.try_parse_json(doc), jsonpath.spark_path(self.path), "variant")
        kind = F.schema_of_variant(raw)
        if self.kind == "numeric":
            return F.when(kind.rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(F.try_parse_json(doc), jsonpath.spark_path(self.path), "double"))
        text = F.lower(F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(doc), jsonpath.spark_path(self.path), "string")))
        return text if self.kind == "tag" else _cut_bytes(text, TEXT_BYTES)


def _cut_bytes(text: Column, n: int) -> Column:
    """The longest beginning of at most n bytes that ends at a character."""
    raw = F.substring(text.cast("binary"), 1, n)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "�+$", ""))


@dataclass(frozen=True)
class Eq:
    field: str
    value: object


@dataclass(frozen=True)
class Range:
    field: str
    low: object = None
    high: object = None
    low_in: bool = True
    high_in: bool = True


@dataclass(frozen=True)
class Prefix:
    field: str
    text: str


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


def with_indexes(docs: DataFrame, indexes: list[Index]) -> DataFrame:
    """Adds a column ix_<name> for each index."""
    return docs.select("*", *(i.value().alias(f"ix_{i.name}") for i in indexes))


def _find(indexes: list[Index], path: str) -> Index:
    for i in indexes:
        if i.path == path:
            return i
    raise NotIndexed(f"{path} has no index")


def predicate(flt, indexes: list[Index]) -> Column:
    """The filter as a condition on the index columns. And of nothing holds for no document, as does Or."""
    if isinstance(flt, And | Or):
        parts = [predicate(p, indexes) for p in flt.parts]
        if not parts:
            return F.lit(False)
        return reduce(lambda a, b: a & b if isinstance(flt, And) else a | b, parts)
    ix = _find(indexes, flt.field)
    col = F.col(f"ix_{ix.name}")
    fold = (lambda v: v) if ix.kind == "numeric" else (lambda v: v.lower())
    if isinstance(flt, Eq):
        return F.coalesce(col == F.lit(fold(flt.value)), F.lit(False))
    if isinstance(flt, Prefix):
        return F.coalesce(col.startswith(fold(flt.text)), F.lit(False))
    cond = col.isNotNull()
    if flt.low is not None:
        cond = cond & (col >= F.lit(fold(flt.low)) if flt.low_in else col > F.lit(fold(flt.low)))
    if flt.high is not None:
        cond = cond & (col <= F.lit(fold(flt.high)) if flt.high_in else col < F.lit(fold(flt.high)))
    return cond


def search(docs: DataFrame, indexes: list[Index], flt=None, sort: str | None = None, descending: bool = False, limit: int | None = 10) -> DataFrame:
    """Documents by filter and order, score 1.0. Without an order by doc_id; descending reverses the ties too. limit None: all."""
    rows = with_indexes(docs, indexes)
    rows = rows if flt is None else rows.where(predicate(flt, indexes))
    order = [F.col("doc_id")]
    if sort is not None:
        col = F.col(f"ix_{_find(indexes, sort).name}")
        rows, order = rows.where(col.isNotNull()), [col, F.col("doc_id")]
    order = [c.desc() if descending else c.asc() for c in order]
    rows = rows.orderBy(*order)
    return (rows if limit is None else rows.limit(limit)).withColumn("score", F.lit(1.0))


def flatten_export(docs: DataFrame) -> DataFrame:
    """(key, path, value): the leaves of each document by dotted path, as export columns hold them."""
    ship(docs.sparkSession)

    def text(v) -> str | None:
        if v is None:
            return None
        if isinstance(v, str):
            return v
        return jsonpath.canonical(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            rows = [(k, p, text(v)) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p, v in jsonpath.flatten(json.loads(d) if d is not None else None).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["key", "path", "value"])

    return docs.select("doc_id", "doc").mapInArrow(run, "key string, path string, value string")
