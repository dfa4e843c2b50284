"""Import and export of tables: formats, key and value columns, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that are taken, in this order, where none is given.
KEYS = ("key", "_id", "id")
DOCUMENTS = ("document", "value", "doc", "body")
VECTORS = ("embedding", "vector", "embeddings", "emb")
FORMATS = {"parquet": "parquet", "csv": "csv", "jsonl": "json", "json": "json"}


class ImportError_(ValueError):
    """A file or table that cannot be imported."""


def format_of(path: str, given: str | None = None) -> str:
    """The format of a path by its ending, or the one given."""
    kind = given or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ImportError_(f"{path}: no format is known for {kind!r}")
    return kind


def read(spark: SparkSession, path: str, given: str | None = None) -> DataFrame:
    """A Parquet, CSV (with header) or JSON-lines file or folder; a .json file may hold one array."""
    kind = format_of(path, given)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("samplingRatio", 0.1).csv(path, header=True, inferSchema=True, escape='"', multiLine=True)
    return spark.read.option("multiLine", kind == "json").json(path)


def write(rows: DataFrame, path: str, given: str | None = None) -> None:
    kind = format_of(path, given)
    if kind == "parquet":
        rows.write.option("compression", "snappy").parquet(path)
    elif kind == "csv":
        rows.write.csv(path, header=True, escape='"', emptyValue="")
    else:
        rows.write.json(path)


def key_column(rows: DataFrame, given: str | None = None) -> str:
    for name in [given] if given else KEYS:
        if name in rows.columns:
            return name
    raise ImportError_(f"none of the key columns {given or ', '.join(KEYS)} is there")


def _rest(rows: DataFrame, key: str) -> Column:
    return F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != key)))


def to_kv(rows: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """(key, value): the given or so named value column, the only other column, or the others as JSON. Null keys are skipped."""
    k = key_column(rows, key)
    others = [c for c in rows.columns if c != k]
    name = value or ("value" if "value" in others else others[0] if len(others) == 1 else None)
    if name is not None and name not in others:
        raise ImportError_(f"there is no column {name}")
    v = _rest(rows, k) if name is None else F.col(name) if not isinstance(rows.schema[name].dataType, T.StructType | T.ArrayType | T.MapType) else F.to_json(name)
    return rows.where(F.col(k).isNotNull()).select(F.col(k).cast("string").alias("key"), v.alias("value"))


def to_documents(rows: DataFrame, key: str | None = None, document: str | None = None) -> DataFrame:
    """(key, doc): the document column if there is one, else the others as one object. Null keys are skipped."""
    k = key_column(rows, key)
    name = document or next((c for c in DOCUMENTS if c in rows.columns and c != k), None)
    doc = _rest(rows, k) if name is None else F.col(name) if isinstance(rows.schema[name].dataType, T.StringType) else F.to_json(name)
    return rows.where(F.col(k).isNotNull()).select(F.col(k).cast("string").alias("key"), doc.alias("doc"))


def to_vectors(rows: DataFrame, key: str | None = None, vector: str | None = None) -> DataFrame:
    """(vec_key, embedding, metadata): the other columns are the metadata. Null keys and vectors are skipped."""
    k = key_column(rows, key)
    name = vector or next((c for c in VECTORS if c in rows.columns), None)
    kind = rows.schema[name].dataType if name in rows.columns else None
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.FloatType | T.DoubleType):
        raise ImportError_("there is no column with lists of floats")
    others = [c for c in rows.columns if c not in (k, name)]
    meta = F.to_json(F.struct(*others)) if others else F.lit(None).cast("string")
    good = rows.where(F.col(k).isNotNull() & F.col(name).isNotNull())
    return good.select(F.col(k).cast("string").alias("vec_key"), F.col(name).cast("array<float>").alias("embedding"), meta.alias("metadata"))


def skipped(rows: DataFrame, key: str | None = None) -> DataFrame:
    """(rows_skipped): rows without key."""
    return rows.agg(F.count_if(F.col(key_column(rows, key)).isNull()).alias("rows_skipped"))


def kv_table(leaves: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """The export table of (key, path, value) leaves: key, then a column for each path in order.

    paths: the columns, if they are known; else they are found first, in one pass.
    """
    if paths is None:
        paths = sorted(r["path"] for r in leaves.select("path").distinct().collect())
    wide = leaves.groupBy("key").pivot("path", paths).agg(F.first("value")) if paths else leaves.select("key").distinct()
    return wide.select("key", *(F.col(f"`{p}`") for p in paths))
