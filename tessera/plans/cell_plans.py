"""Queries over the cell log and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cells, events
from tessera.plans.registry import query
from tessera.plans.views import EVENT_SQL, KV_SQL, LATEST_SQL, T_US, event_log, kv_cells, share_of_events, share_sql
from tessera.session import fresh_path
from tessera.streaming import event_stream

W = f"WITH {KV_SQL}"
S = f"{W}, {LATEST_SQL}"


@query(f"{S} SELECT key, version, value FROM s")
def kv_latest(spark, sf_dir):
    return cells.snapshot(kv_cells(spark, sf_dir)).select("key", "version", "value")


@query(f"{S} SELECT key, version, value FROM s WHERE key = 'user:7'")
def kv_get(spark, sf_dir):
    return cells.snapshot(kv_cells(spark, sf_dir).where("key = 'user:7'")).select("key", "version", "value")


@query(f"""{W} SELECT key, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM c WHERE version <= {share_sql(60)})
WHERE rn = 1 AND NOT is_tombstone""")
def kv_at_version(spark, sf_dir):
    return cells.snapshot(kv_cells(spark, sf_dir), version=share_of_events(spark, sf_dir, 60)).select("key", "version", "value")


_AS_OF = f"""{W}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM c WHERE ts_us <= {T_US})
WHERE rn = 1 AND NOT is_tombstone AND (ttl_ms IS NULL OR {T_US} - ts_us < ttl_ms * 1000))"""


@query(f"{_AS_OF} SELECT key, version, value FROM s")
def kv_as_of(spark, sf_dir):
    return cells.as_of(kv_cells(spark, sf_dir, T_US), T_US).select("key", "version", "value")


@query(f"{_AS_OF} SELECT count(*) AS n, count(ttl_ms) AS with_ttl FROM s")
def kv_ttl_as_of(spark, sf_dir):
    return cells.as_of(kv_cells(spark, sf_dir, T_US), T_US).agg(F.count("*").alias("n"), F.count("ttl_ms").alias("with_ttl"))


@query(f"{W} SELECT key, version, is_tombstone, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS age_rank FROM c")
def kv_history(spark, sf_dir):
    return cells.history(kv_cells(spark, sf_dir)).select("key", "version", "is_tombstone", "age_rank")


@query(f"{S} SELECT key, version, count(*) OVER () > 4 AS has_more FROM s WHERE key LIKE 'user:1%' AND key > 'user:10' ORDER BY key LIMIT 4")
def kv_prefix_page(spark, sf_dir):
    return cells.page(cells.snapshot(kv_cells(spark, sf_dir)), 4, "user:1", "user:10").select("key", "version", "has_more")


@query(f"{S} SELECT key, version, value FROM s WHERE key >= 'user:2' ORDER BY key LIMIT 10")
def kv_scan_limit(spark, sf_dir):
    return cells.range_scan(cells.snapshot(kv_cells(spark, sf_dir)), "user:2", 10).select("key", "version", "value")


@query(f"{S} SELECT count(*) AS n FROM s WHERE key LIKE 'user:1%'")
def kv_count_prefix(spark, sf_dir):
    return cells.count_prefix(cells.snapshot(kv_cells(spark, sf_dir)), "user:1")


@query(f"""{S}, r AS (SELECT key, version, row_number() OVER (ORDER BY key) - 1 AS rk, count(*) OVER () AS total FROM s)
SELECT key, version FROM r WHERE rk IN (SELECT floor(i * total / 5.0)::BIGINT FROM range(5) x(i), (SELECT max(total) AS total FROM r))""")
def kv_sample_even(spark, sf_dir):
    return cells.sample_even(cells.snapshot(kv_cells(spark, sf_dir)), 5).select("key", "version")


@query(f"""{S}, w(position, key) AS (VALUES (0, 'user:3'), (1, 'user:none'), (2, 'user:5'), (3, 'user:3'))
SELECT position, w.key AS key, version, s.key IS NOT NULL AS found FROM w LEFT JOIN s ON w.key = s.key""")
def kv_batch_get(spark, sf_dir):
    wanted = spark.createDataFrame([(0, "user:3"), (1, "user:none"), (2, "user:5"), (3, "user:3")], "position int, key string")
    return cells.batch_get(cells.snapshot(kv_cells(spark, sf_dir)), wanted).select("position", "key", "version", "found")


@query(f"{W} SELECT min(ts_us) AS oldest_us, max(ts_us) AS latest_us FROM c")
def time_range(spark, sf_dir):
    return cells.time_range(kv_cells(spark, sf_dir))


@query(f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS age, row_number() OVER (PARTITION BY key, version > {share_sql(50)} ORDER BY version DESC) AS below FROM c)
SELECT key, version FROM r WHERE (version > {share_sql(50)} OR (below = 1 AND NOT is_tombstone AND (ttl_ms IS NULL OR {T_US} - ts_us < ttl_ms * 1000))) AND age <= 5""")
def kv_prune(spark, sf_dir):
    return cells.prune(kv_cells(spark, sf_dir), floor=share_of_events(spark, sf_dir, 50), max_versions=5, now_us=T_US).select("key", "version")


@query(f"""{W}, n AS (SELECT key, max(version) AS v FROM c GROUP BY key), r AS (SELECT key, max(version) AS v FROM c WHERE version <= {share_sql(60)} GROUP BY key)
SELECT r.key AS key, r.v AS seen_version, n.v AS now_version FROM r JOIN n ON r.key = n.key WHERE r.v <> n.v""")
def occ_conflicts(spark, sf_dir):
    log = kv_cells(spark, sf_dir)
    read = cells.newest(log.where(F.col("version") <= share_of_events(spark, sf_dir, 60))).select(*cells.ID, F.col("version").alias("seen_version"))
    return cells.read_conflicts(read, log).select("key", "seen_version", "now_version")


@query(f"""{S} SELECT key, version FROM s WHERE key NOT IN ('user:1', 'user:2', 'user:zz')
UNION ALL SELECT 'user:1', 99999999 UNION ALL SELECT 'user:zz', 99999999""")
def txn_overlay(spark, sf_dir):
    visible = cells.snapshot(kv_cells(spark, sf_dir)).select(*cells.ID, "version")
    own = lambda keys: spark.createDataFrame([("main", "default", "kv", k, 99999999) for k in keys], "branch string, space string, type_tag string, key string, version bigint")
    return cells.overlay(visible, own(["user:1", "user:zz"]), own(["user:2"])).select("key", "version")


@query(f"""{S} SELECT 'main' AS branch, 'default' AS space, 'kv' AS type_tag, (SELECT count(*) FROM c) AS versions, (SELECT count(*) FROM s) AS live""")
def describe(spark, sf_dir):
    return cells.describe(kv_cells(spark, sf_dir))


@query(f"{_AS_OF} SELECT key, version, value FROM s WHERE key LIKE 'user:1%'")
def kv_prefix_as_of(spark, sf_dir):
    return cells.as_of(cells.prefix_scan(kv_cells(spark, sf_dir, T_US), "user:1"), T_US).select("key", "version", "value")


@query(f"{S} SELECT key, version, value FROM s")
def kv_merge_runs(spark, sf_dir):
    """Three runs of the log, of interleaved versions, as one."""
    log = kv_cells(spark, sf_dir)
    runs = [log.where(F.col("version") % 3 == i) for i in range(3)]
    return cells.snapshot(cells.merge_runs(*runs)).select("key", "version", "value")


@query(f"""{S}, r AS (SELECT key, CASE WHEN max(version) % 3 = 0 THEN 0 ELSE max(version) END AS v FROM c WHERE version <= {share_sql(60)} GROUP BY key)
SELECT r.key AS key, r.v AS expected_version, s.version AS now_version FROM r LEFT JOIN s ON r.key = s.key WHERE r.v <> coalesce(s.version, 0)""")
def cas_conflicts(spark, sf_dir):
    """Each key is expected at the version it had, a third of them not to exist."""
    log = kv_cells(spark, sf_dir)
    seen = cells.newest(log.where(F.col("version") <= share_of_events(spark, sf_dir, 60)))
    expected = seen.select(*cells.ID, F.when(F.col("version") % 3 == 0, 0).otherwise(F.col("version")).alias("expected_version"))
    return cells.cas_conflicts(expected, log).select("key", "expected_version", "now_version")


@query("SELECT event_type AS space FROM events UNION SELECT 'default'")
def kv_spaces(spark, sf_dir):
    return cells.spaces(event_log(spark, sf_dir).select(F.col("event_type").alias("space")))


E = f"WITH {EVENT_SQL}"


@query(f"{E} SELECT seq, event_type, payload, ts_us FROM e WHERE seq >= {share_sql(10)} AND seq < {share_sql(40)} AND event_type = 'click'")
def event_range(spark, sf_dir):
    return events.by_range(event_log(spark, sf_dir), share_of_events(spark, sf_dir, 10), share_of_events(spark, sf_dir, 40), "click").select("seq", "event_type", "payload", "ts_us")


@query(f"{E} SELECT seq, event_type FROM e WHERE seq >= 0 AND seq < {share_sql(50)} ORDER BY seq DESC LIMIT 25")
def event_range_reverse(spark, sf_dir):
    return events.by_range(event_log(spark, sf_dir), 0, share_of_events(spark, sf_dir, 50), reverse=True, limit=25).select("seq", "event_type")


@query(f"{E} SELECT seq, event_type, ts_us FROM e WHERE ts_us BETWEEN {T_US} AND {T_US + 172_800_000_000}")
def event_range_by_time(spark, sf_dir):
    return events.by_time(event_log(spark, sf_dir, T_US, T_US + 172_800_000_000), T_US, T_US + 172_800_000_000).select("seq", "event_type", "ts_us")


@query(f"{E} SELECT seq, payload FROM e WHERE event_type = 'purchase' AND seq > 50 ORDER BY seq LIMIT 20")
def event_by_type_after(spark, sf_dir):
    return events.by_type(event_log(spark, sf_dir), "purchase", after=50, limit=20).select("seq", "payload")


@query(f"{E} SELECT count(*) AS n FROM e WHERE ts_us <= {T_US}")
def event_len_as_of(spark, sf_dir):
    return events.length(event_log(spark, sf_dir, until_us=T_US), T_US)


@query(f"{E} SELECT DISTINCT event_type FROM e WHERE ts_us <= {T_US}")
def event_types_as_of(spark, sf_dir):
    return events.types(event_log(spark, sf_dir, until_us=T_US), T_US)


@query(f"{E} SELECT event_type, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(ts_us, seq) AS first_us, arg_max(ts_us, seq) AS last_us FROM e GROUP BY 1")
def event_stream_stats(spark, sf_dir):
    return events.stream_stats(event_log(spark, sf_dir))


@query(f"{E} SELECT seq, event_type, ts_us - lag(ts_us) OVER (PARTITION BY event_type ORDER BY seq) AS gap_us FROM e")
def event_gaps(spark, sf_dir):
    return events.with_next_gap(event_log(spark, sf_dir)).select("seq", "event_type", "gap_us")


@query(f"""{E}, x AS (SELECT event_type AS space, seq, (row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1)::VARCHAR AS n, ts_us::VARCHAR AS t, payload FROM e),
y AS (SELECT space, seq, strlen(n) || ':' || n || '|' || strlen(space) || ':' || space || '|' || strlen(t) || ':' || t || '|' || strlen(payload) || ':' || payload AS part FROM x)
SELECT space, count(*) AS checked, true AS valid, NULL::BIGINT AS first_invalid,
  list_reduce(['{events.GENESIS}'] || list(part ORDER BY seq), lambda h, part: sha256(part || '|64:' || h)) AS last_hash FROM y GROUP BY 1""")
def event_chain_verify(spark, sf_dir):
    """The events as a log of each type: chained, then checked."""
    log = event_log(spark, sf_dir).withColumn("position", F.col("seq")).withColumn("space", F.col("event_type"))
    return events.verify_chain(events.chains(log), by=("branch", "space")).drop("branch")


@query(f"""{W}, b(v) AS (SELECT {share_sql(30)} UNION SELECT {share_sql(60)}), n AS (SELECT *, lead(version) OVER (PARTITION BY key ORDER BY version) AS after FROM c),
h AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE version <= v AND (after IS NULL OR after > v)) AS held FROM n),
k AS (SELECT *, coalesce(bool_or(held) OVER (PARTITION BY key ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hides FROM h)
SELECT key, version FROM k WHERE held OR version > {share_sql(80)} OR ((after IS NULL OR after > {share_sql(80)}) AND version <= {share_sql(80)} AND ((NOT is_tombstone AND (ttl_ms IS NULL OR {T_US} - ts_us < ttl_ms * 1000)) OR hides))""")
def compact_with_forks(spark, sf_dir):
    """What compaction keeps where branches were forked at two versions."""
    at = {p: share_of_events(spark, sf_dir, p) for p in (30, 60, 80)}
    log = kv_cells(spark, sf_dir)
    return cells.prune(log, at[80], None, T_US, [("main", at[30]), ("main", at[60])]).select("key", "version")


@query(f"{E} SELECT seq, payload FROM e WHERE event_type = 'purchase' AND ts_us <= {T_US}")
def event_by_type_as_of(spark, sf_dir):
    return events.by_type(event_log(spark, sf_dir, until_us=T_US), "purchase", as_of_us=T_US).select("seq", "payload")


@query(f"""{E} SELECT seq, CASE seq % 5 WHEN 0 THEN 'the event type is empty' WHEN 1 THEN 'the event type is longer than 256 bytes'
WHEN 2 THEN 'the payload is no JSON object of finite numbers' WHEN 3 THEN 'the payload is no JSON object of finite numbers' END AS error FROM e""")
def event_entry_errors(spark, sf_dir):
    """Events, four of five of which are spoilt in one way each."""
    nth = F.col("seq") % 5
    kind = F.when(nth == 0, F.lit("  ")).when(nth == 1, F.repeat(F.lit("x"), 257)).otherwise(F.col("event_type")).alias("event_type")
    payload = F.when(nth == 2, F.lit("[1]")).when(nth == 3, F.lit('{"a": NaN}')).otherwise(F.col("payload")).alias("payload")
    return events.entry_errors(event_log(spark, sf_dir).select("seq", kind, payload)).select("seq", "error")


@query(f"{E} SELECT seq, event_type, payload FROM e WHERE seq % 4 <> 0")
def event_stream_ingest(spark, sf_dir):
    """The events as files of a stream, every fourth without a type; read to its end, the valid ones land in a log."""
    path = fresh_path(spark, "stream")
    log = event_log(spark, sf_dir)
    kind = F.when(F.col("seq") % 4 != 0, F.col("event_type")).alias("event_type")
    log.select("seq", kind, "payload", F.timestamp_micros("ts_us").alias("ts")).write.parquet(f"{path}/in")
    event_stream.ingest(event_stream.source(spark, f"{path}/in"), f"{path}/log", f"{path}/state").awaitTermination()
    return spark.read.schema(event_stream.SCHEMA).parquet(f"{path}/log").select("seq", "event_type", "payload")


@query(f"{E} SELECT ts_us // 3600000000 AS hour, event_type, count(*) AS n FROM e GROUP BY 1, 2")
def event_windowed_counts(spark, sf_dir):
    log = event_log(spark, sf_dir).select("event_type", F.timestamp_micros("ts_us").alias("ts"))
    hour = F.floor(F.unix_micros("window.start") / F.lit(3_600_000_000)).cast("bigint").alias("hour")
    return event_stream.windowed_counts(log).select(hour, "event_type", "n")
