"""The event log: dense sequences with a hash chain, ranges, types, statistics.

Columns: branch, space, seq, event_type, payload (JSON object), ts_us, prev_hash, hash (lower-case hex).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship

#: What stands before the first event.
GENESIS = "0" * 64


def _ordered(rows: DataFrame, reverse: bool, limit: int | None) -> DataFrame:
    rows = rows.orderBy(F.desc("seq") if reverse else F.asc("seq"))
    return rows if limit is None else rows.limit(limit)


def by_range(events: DataFrame, start: int, end: int | None = None, event_type: str | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Events of start <= seq < end, in order of sequence."""
    rows = events.where(F.col("seq") >= start)
    rows = rows if end is None else rows.where(F.col("seq") < end)
    rows = rows if event_type is None else rows.where(F.col("event_type") == event_type)
    return _ordered(rows, reverse, limit)


def by_time(events: DataFrame, start_us: int, end_us: int | None = None, event_type: str | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Events of start <= ts <= end, both included, in order of sequence, not of time."""
    rows = events.where(F.col("ts_us") >= start_us)
    rows = rows if end_us is None else rows.where(F.col("ts_us") <= end_us)
    rows = rows if event_type is None else rows.where(F.col("event_type") == event_type)
    return _ordered(rows, reverse, limit)


def by_type(events: DataFrame, event_type: str, after: int | None = None, limit: int | None = None, as_of_us: int | None = None) -> DataFrame:
    rows = events.where(F.col("event_type") == event_type)
    rows = rows if after is None else rows.where(F.col("seq") > after)
    rows = rows if as_of_us is None else rows.where(F.col("ts_us") <= as_of_us)
    return _ordered(rows, False, limit)


def length(events: DataFrame, as_of_us: int | None = None) -> DataFrame:
    rows = events if as_of_us is None else events.where(F.col("ts_us") <= as_of_us)
    return rows.agg(F.count("*").alias("n"))


def types(events: DataFrame, as_of_us: int | None = None) -> DataFrame:
    rows = events if as_of_us is None else events.where(F.col("ts_us") <= as_of_us)
    return rows.select("event_type").distinct()


def stream_stats(events: DataFrame) -> DataFrame:
    """Count, and first and last sequence and time, by type."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min_by("ts_us", "seq").alias("first_us"), F.max_by("ts_us", "seq").alias("last_us"),
    )


def content(event_type: Column, payload: Column, ts_us: Column, seq: Column, prev_hash: Column) -> Column:
    """The text that an event's hash is of: each part with its length, so that no two events share one."""
    parts = [seq.cast("string"), event_type, ts_us.cast("string"), payload, prev_hash]
    return F.concat_ws("|", *(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))


def append(log_tail: tuple[int, str], entries: DataFrame) -> DataFrame:
    """Entries (position, event_type, payload, ts_us) as events that follow (last sequence, last hash).

    A chain is one fold by nature: the entries of the batch, not the log, go through one task in order.
    """
    one = entries.select(F.lit("").alias("branch"), F.lit("").alias("space"), "position", "event_type", "payload", "ts_us")
    return _fold(one.repartition(1), log_tail).drop("branch", "space")


def chains(entries: DataFrame) -> DataFrame:
    """Entries (branch, space, position, event_type, payload, ts_us) as new logs, one of each branch and space.

    The logs are folded beside each other, each in order of position, a batch at a time.
    """
    return _fold(entries.repartition("branch", "space"), (-1, GENESIS))


def _fold(entries: DataFrame, log_tail: tuple[int, str]) -> DataFrame:
    ship(entries.sparkSession)
    last_seq, last_hash = log_tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        seq, prev, at = last_seq, last_hash, None
        for b in batches:
            out = []
            for branch, space, kind, payload, ts in zip(*(b.column(c).to_pylist() for c in ("branch", "space", "event_type", "payload", "ts_us"))):
                if (branch, space) != at:
                    seq, prev, at = last_seq, last_hash, (branch, space)
                seq += 1
                parts = [str(seq), kind, str(ts), payload, prev]
                h = hashlib.sha256("|".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()
                out.append((branch, space, seq, kind, payload, ts, prev, h))
                prev = h
            names = ["branch", "space", "seq", "event_type", "payload", "ts_us", "prev_hash", "hash"]
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    ordered = entries.select("branch", "space", "position", "event_type", "payload", "ts_us").sortWithinPartitions("branch", "space", "position")
    return ordered.mapInArrow(run, "branch string, space string, seq bigint, event_type string, payload string, ts_us bigint, prev_hash string, hash string")


def verify_chain(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """checked, valid, first_invalid (null: none) and last_hash: sequences dense from 0, links equal, hashes recomputed.

    by: the columns that name a log, where there are several; a row for each.

    An event meets the one before it by an equi-join on the sequence, not by a window over the log.
    """
    before = events.select(*by, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_link"))
    own = F.sha2(content(F.col("event_type"), F.col("payload"), F.col("ts_us"), F.col("seq"), F.col("prev_hash")), 256)
    link = F.when(F.col("seq") == 0, F.lit(GENESIS)).otherwise(F.col("_link"))
    bad = ~F.coalesce((F.col("hash") == own) & (F.col("prev_hash") == link), F.lit(False))
    checked = events.join(before, [*by, "seq"], "left").withColumn("_bad", bad)
    first = F.min(F.when(F.col("_bad"), F.col("seq"))).alias("first_invalid")
    out = checked.groupBy(*by).agg(F.count("*").alias("checked"), first, F.max_by("hash", "seq").alias("last_hash"))
    return out.select(*by, "checked", F.col("first_invalid").isNull().alias("valid"), "first_invalid", "last_hash")


def entry_errors(entries: DataFrame) -> DataFrame:
    """Adds error: why an entry cannot be appended, or null."""
    kind = F.trim("event_type")
    bad_number = F.col("payload").rlike(r'(?i)(?<=[:\[, ])-?(nan|infinity|inf)\b')
    return entries.withColumn(
        "error",
        F.when(F.coalesce(kind, F.lit("")) == "", F.lit("the event type is empty"))
        .when(F.octet_length("event_type") > 256, F.lit("the event type is longer than 256 bytes"))
        .when(F.coalesce(F.try_parse_json("payload").isNull(), F.lit(True)) | ~F.coalesce(F.ltrim("payload").startswith("{"), F.lit(False)) | bad_number, F.lit("the payload is no JSON object of finite numbers")),
    )


def diverged(source: DataFrame, target: DataFrame, fork_length: int) -> bool:
    """Whether both logs grew since the fork; such logs cannot be merged."""
    ends = [x.agg(F.max("seq")).first()[0] for x in (source, target)]
    return all(e is not None and e >= fork_length for e in ends)


def with_next_gap(events: DataFrame) -> DataFrame:
    """Adds gap_us to the event before it of the same type."""
    w = Window.partitionBy("event_type").orderBy("seq")
    return events.withColumn("gap_us", F.col("ts_us") - F.lag("ts_us").over(w))
