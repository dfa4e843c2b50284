"""The corpus pipeline: five stages, each over all that the one before it kept.

  quality   documents that the quality classifier rejects go
  lines     lines that several documents share stay in one of them
  simhash   of near-duplicates, by SimHash over shingles of five words, one document stays
  mixing    sources are mixed to target weights; a document is there as often as the mix has it
  pieces    texts are segmented by sampled SentencePiece pieces and decoded again

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Null texts, languages and sources, empty and very long texts, repeated rows and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lines, mixing, pieces, simhash, site_quality, text
from tessera.session import fresh_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return site_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(docs, min_chars=10, min_docs=2)
    n_chars = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")).alias("n_chars")
    return kept.select(*(n_chars if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs, k=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix = mixing.mix(docs, text.n_words("text"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixing.emit(mix, docs.columns)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), model)
    return back.select("doc_id", "lang", "source", F.size("pieces").cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "text")


STAGES = [
    ("quality", quality),
    ("lines", shared_lines),
    ("simhash", near_duplicates),
    ("mixing", mixed),
    ("pieces", segmented),
]

#: The classifier is fitted and the segmentations are sampled, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
