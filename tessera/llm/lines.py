"""Line dedup: lines that several documents share stay in one of them only.

A text is split at \\n; null and empty texts are one empty line. A line's key is the line without
the white space at its ends, A-Z lower-cased. Keys of at least `min_chars` code points that
`min_docs` documents or more hold lose all their lines, but for those of the smallest doc_id that
holds the key. The other lines stay in their order, joined by \\n.

Keys travel as two 64-bit hashes. The documents of a key are counted with map-side combination,
so that a line of a third of all documents is one partial row a task. The way back joins the
lines to the few shared keys, a plain equi-join that Spark splits where a key is hot, and gathers
line numbers by document, at most as many as the document has lines.

Rows without doc_id hold no key and keep their lines. Rows that share a doc_id are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import SPACES, filled, lower_ascii
from tessera.session import cut


def _lines(text: str = "text") -> Column:
    return F.split(filled(text), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of `docs`, text without the shared lines, and n_lines (before) and n_dropped."""
    key = lower_ascii(F.btrim(F.col("line"), F.lit(SPACES)))
    rows = (
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(_lines()).alias("pos", "line"))
        .withColumn("key", key)
        .where(F.length("key") >= min_chars)
        .select("doc_id", "body", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    )
    rows = cut(rows)
    if min_docs == 2:
        shared = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        shared = shared.where("first < last").drop("last")
    else:
        by_doc = rows.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one"))
        shared = by_doc.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        shared = shared.where(F.col("n") >= min_docs).drop("n")
    shared = cut(shared)  # both sides of the join are then shuffled for it, and a hot line's partition can be split
    dropped = (
        rows.join(shared, ["h", "g"])
        .where("doc_id <> first")
        .groupBy("doc_id", "body")
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    numbered = docs.withColumn("__body", F.xxhash64("text"))
    joined = numbered.join(
        dropped.select(F.col("doc_id").alias("__id"), F.col("body").alias("__of"), "__dropped"),
        (F.col("doc_id") == F.col("__id")) & (F.col("__body") == F.col("__of")),
        "left",
    ).withColumn("__lines", _lines())
    last = F.size("__lines") - 1
    stay = F.array_except(F.sequence(F.lit(0), last), "__dropped")
    text = F.when(F.col("__dropped").isNull(), filled("text")).otherwise(
        F.array_join(F.transform(stay, lambda p: F.get("__lines", p)), "\n")
    )
    n_dropped = F.coalesce(F.size("__dropped"), F.lit(0)).cast("bigint")
    n_dropped = F.when(F.col("__dropped").isNull(), F.lit(0).cast("bigint")).otherwise(n_dropped)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in kept),
        F.size("__lines").cast("bigint").alias("n_lines"),
        n_dropped.alias("n_dropped"),
    )
