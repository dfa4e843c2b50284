"""The test tables as the engine's primitives: cell logs, events, documents, vectors, graphs, branches."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

#: 2024-01-11 19:06:40, within the events' month.
T_US = 1_705_000_000_000_000
HOUR_US = 3_600_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def at(us: int) -> Column:
    """A time as the tables' own column type has it, so that the comparison reaches the Parquet reader."""
    text = f"{datetime.fromtimestamp(us // 1_000_000, UTC):%Y-%m-%d %H:%M:%S}.{us % 1_000_000:06d}"
    return F.lit(text).cast("timestamp_ntz")


def events_between(spark: SparkSession, sf_dir: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e if since_us is None else e.where(F.col("ts") >= at(since_us))
    return e if until_us is None else e.where(F.col("ts") <= at(until_us))


def kv_cells(spark: SparkSession, sf_dir: str, until_us: int | None = None) -> DataFrame:
    """The events as versions of a key for each user; errors are tombstones, views live for six hours."""
    e = events_between(spark, sf_dir, until_us=until_us)
    return e.select(
        F.lit("main").alias("branch"), F.lit("default").alias("space"), F.lit("kv").alias("type_tag"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("version"), micros("ts").alias("ts_us"),
        (F.col("event_type") == "error").alias("is_tombstone"), F.when(F.col("event_type") == "view", F.lit(21_600_000).cast("bigint")).alias("ttl_ms"),
        F.lit("json").alias("value_type"), F.col("props").alias("value"),
    )


def share_of_events(spark: SparkSession, sf_dir: str, percent: int) -> int:
    """A version so many hundredths through the events."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) * percent // 100


def share_sql(percent: int) -> str:
    return f"(SELECT max(event_id) * {percent} // 100 FROM events)"


#: The same in SQL: a table expression named c.
KV_SQL = """
c AS (SELECT 'main' AS branch, 'default' AS space, 'kv' AS type_tag, 'user:' || user_id AS key, event_id AS version, epoch_us(ts) AS ts_us,
  event_type = 'error' AS is_tombstone, CASE WHEN event_type = 'view' THEN 21600000::BIGINT END AS ttl_ms, props AS value FROM events)"""

#: The snapshot of c: a table expression named s.
LATEST_SQL = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM c) WHERE rn = 1 AND NOT is_tombstone)"


def event_log(spark: SparkSession, sf_dir: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    e = events_between(spark, sf_dir, since_us, until_us)
    payload = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"user_id":'), F.col("user_id").cast("string"), F.lit("}"))
    return e.select(
        F.lit("main").alias("branch"), F.lit("default").alias("space"), F.col("event_id").alias("seq"), "event_type", payload.alias("payload"), micros("ts").alias("ts_us")
    )


EVENT_SQL = """
e AS (SELECT event_id AS seq, event_type, '{"props":' || props || ',"user_id":' || user_id || '}' AS payload, epoch_us(ts) AS ts_us FROM events)"""


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    doc = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).alias("maker"), F.col("p_size").alias("size"), F.array("p_type", "p_brand").alias("tags")))
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("doc_id"), doc.alias("doc"))


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ref"), "text")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings; every seventh is deleted ten hours after its creation, an hour a vec_id."""
    e = table(spark, sf_dir, "embeddings")
    created = F.lit(T_US) + F.col("vec_id") * HOUR_US
    return e.select(
        F.col("vec_id").alias("vec_key"), "embedding", F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit(',"name":"v'), F.col("vec_id").cast("string"), F.lit('"}')).alias("metadata"),
        created.alias("created_us"), F.when(F.col("vec_id") % 7 == 3, created + 10 * HOUR_US).alias("deleted_us"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"),
    )


VECTOR_SQL = """
v AS (SELECT vec_id AS vec_key, embedding, embedding::DOUBLE[64] AS e, label, 1705000000000000 + vec_id * 3600000000 AS created_us,
  CASE WHEN vec_id % 7 = 3 THEN 1705000000000000 + vec_id * 3600000000 + 36000000000 END AS deleted_us FROM embeddings),
q AS (SELECT embedding::DOUBLE[64] AS q FROM embeddings WHERE vec_id = 0)"""


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers in nations, nations in regions, and suppliers in regions."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    nation = t("nation")
    parts = [
        t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("edge_type"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("weight")),
        t("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("edge_type"), (F.col("c_custkey") % 3 + 1).cast("double").alias("weight")),
        nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("edge_type"), F.lit(2.0).alias("weight")),
        t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s", "s_suppkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("SERVES").alias("edge_type"), F.lit(9.0).alias("weight")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PLACE_SQL = """
g AS (SELECT 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst, 'LOCATED_IN' AS edge_type, (s_suppkey % 5 + 1)::DOUBLE AS weight FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'LIVES_IN', (c_custkey % 3 + 1)::DOUBLE FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'PART_OF', 2.0 FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'r:' || n_regionkey, 'SERVES', 9.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ids AS (SELECT src AS node_id FROM g UNION SELECT dst FROM g)"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("dst"),
        F.lit("PLACED_BY").alias("edge_type"), F.lit(1.0).alias("weight"),
    )


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on main; the branch feature, forked at version 0, and main itself then change, delete and add some."""
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))

    def rows(where: str, branch: str, version: int, value: Column | None, shift: str = "") -> DataFrame:
        k = F.concat(key, F.lit(shift))
        return o.where(where).select(
            F.lit(branch).alias("branch"), F.lit("default").alias("space"), F.lit("kv").alias("type_tag"), k.alias("key"), F.lit(version).cast("bigint").alias("version"),
            F.lit(T_US + version).alias("ts_us"), F.lit(value is None).alias("is_tombstone"), F.lit(None).cast("bigint").alias("ttl_ms"), F.lit("string").alias("value_type"),
            (F.lit(None).cast("string") if value is None else value).alias("value"),
        )

    s, p, both = F.col("o_orderstatus"), F.col("o_orderpriority"), F.concat("o_orderstatus", "o_orderpriority")
    parts = [
        rows("true", "main", 0, s),
        rows("o_orderkey % 10 = 0", "feature", 1, p), rows("o_orderkey % 10 = 1", "feature", 2, None), rows("o_orderkey % 10 = 2", "feature", 3, both),
        rows("o_orderkey % 50 = 3", "feature", 4, p, "n"), rows("o_orderkey % 10 = 4", "feature", 5, F.lit("x")),
        rows("o_orderkey % 20 = 0", "main", 6, F.lit("m")), rows("o_orderkey % 20 = 1", "main", 7, None), rows("o_orderkey % 20 = 2", "main", 8, both),
        rows("o_orderkey % 20 = 4", "main", 9, None), rows("o_orderkey % 10 = 5", "main", 10, p), rows("o_orderkey % 10 = 6", "main", 11, None),
        rows("o_orderkey % 100 = 3", "main", 12, F.lit("z"), "n"), rows("o_orderkey % 50 = 7", "main", 13, p, "k"), rows("o_orderkey % 20 = 11", "main", 14, F.lit("w")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


ORDER_SQL = """
o AS (SELECT 'order:' || o_orderkey AS key, o_orderkey AS n, o_orderstatus AS s, o_orderpriority AS p FROM orders),
anc AS (SELECT key, s AS value FROM o),
src AS (SELECT CASE WHEN n % 10 = 0 THEN key ELSE key END AS key, CASE WHEN n % 10 = 0 THEN p WHEN n % 10 = 2 THEN s || p WHEN n % 10 = 4 THEN 'x' ELSE s END AS value FROM o WHERE n % 10 <> 1
  UNION ALL SELECT key || 'n', p FROM o WHERE n % 50 = 3),
tgt AS (SELECT key, CASE WHEN n % 20 = 0 THEN 'm' WHEN n % 20 = 2 THEN s || p WHEN n % 10 = 5 THEN p WHEN n % 20 = 11 THEN 'w' ELSE s END AS value FROM o WHERE n % 20 NOT IN (1, 4) AND n % 10 <> 6
  UNION ALL SELECT key || 'n', 'z' FROM o WHERE n % 100 = 3 UNION ALL SELECT key || 'k', p FROM o WHERE n % 50 = 7),
t AS (SELECT key, anc.value AS a, src.value AS b, tgt.value AS c, anc.key IS NOT NULL AS ha, src.key IS NOT NULL AS hb, tgt.key IS NOT NULL AS hc
  FROM anc FULL JOIN src USING (key) FULL JOIN tgt USING (key)),
k AS (SELECT key, a, b, c, ha, hb, hc, CASE
  WHEN NOT ha AND NOT hc THEN 'source_added' WHEN NOT ha AND NOT hb THEN 'target_added'
  WHEN NOT ha AND b IS NOT DISTINCT FROM c THEN 'both_added_same' WHEN NOT ha THEN 'both_added_different'
  WHEN NOT hb AND NOT hc THEN 'both_deleted' WHEN NOT hb AND a IS NOT DISTINCT FROM c THEN 'source_deleted' WHEN NOT hb THEN 'delete_modify_conflict'
  WHEN NOT hc AND a IS NOT DISTINCT FROM b THEN 'target_deleted' WHEN NOT hc THEN 'modify_delete_conflict'
  WHEN b IS NOT DISTINCT FROM c AND a IS NOT DISTINCT FROM b THEN 'unchanged' WHEN b IS NOT DISTINCT FROM c THEN 'both_changed_same'
  WHEN a IS NOT DISTINCT FROM c THEN 'source_changed' WHEN a IS NOT DISTINCT FROM b THEN 'target_changed' ELSE 'conflict' END AS outcome FROM t)"""
