"""The event log as a stream: ingestion, statistics by type, resumable reading. Windows are an extension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tessera.operators import events
from tessera.session import ship

SCHEMA = "seq bigint, event_type string, payload string, ts timestamp"


def source(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New files of events under a folder, as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def valid(stream: DataFrame) -> DataFrame:
    return events.entry_errors(stream).where("error IS NULL").drop("error")


def stats_by_type(stream: DataFrame) -> DataFrame:
    """Count, first and last sequence and time by type: the state is a row a type."""
    return stream.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type and event-time window, closed when the watermark passes (an extension)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream's valid events to a log, each file once; reads what is there, and ends."""
    return valid(stream).writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHAIN = "space string, seq bigint, event_type string, payload string, ts_us bigint, prev_hash string, hash string"


def chain(stream: DataFrame) -> DataFrame:
    """Entries (space, event_type, payload, ts_us) as events of one hash chain a space: the state of a space is its
    last sequence and hash. Entries of a micro-batch are taken in order of time, type and payload."""
    ship(stream.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, prev = state.get if state.exists else (-1, events.GENESIS)
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_type", "payload"], kind="stable")
        out = []
        for r in rows.itertuples():
            seq += 1
            parts = [str(seq), r.event_type, str(r.ts_us), r.payload, prev]
            h = hashlib.sha256("|".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()
            out.append((key[0], seq, r.event_type, r.payload, r.ts_us, prev, h))
            prev = h
        state.update((seq, prev))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAIN.split(", ")])

    return stream.groupBy("space").applyInPandasWithState(run, CHAIN, "seq bigint, hash string", "append", "NoTimeout")


def follow(log: DataFrame, after: int) -> DataFrame:
    """What a follower with a cursor has not seen."""
    return log.where(F.col("seq") > after)


def embed_batches(stream: DataFrame, embed, sink, checkpoint: str) -> StreamingQuery:
    """Embeds each micro-batch (embed: DataFrame to DataFrame) and gives it to sink(batch, id)."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(embed(df), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
