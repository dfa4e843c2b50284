"""Queries over branches of the orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import branching, cells
from tessera.plans.registry import query
from tessera.plans.views import ORDER_SQL, order_cells
from tessera.session import table

K = f"WITH {ORDER_SQL}"


def _three(spark, sf_dir):
    log = order_cells(spark, sf_dir)
    main = log.where("branch = 'main'")
    return cells.snapshot(main, version=0), cells.snapshot(cells.fork_view(log, [("main", 0)], "feature")), cells.snapshot(main)


def _classified(spark, sf_dir):
    main = F.col("branch") == "main"
    return branching.classify_log(order_cells(spark, sf_dir), main & (F.col("version") <= 0), cells.seen_by([("main", 0)], "feature"), main, cells.alive(None))


@query(f"{K} SELECT key, value FROM src")
def branch_view(spark, sf_dir):
    return _three(spark, sf_dir)[1].select("key", "value")


@query(f"""{K} SELECT key, CASE WHEN NOT hb THEN 'added' WHEN NOT hc THEN 'removed' ELSE 'modified' END AS change, b AS value_a, c AS value_b FROM t
WHERE (hb OR hc) AND (NOT hb OR NOT hc OR b IS DISTINCT FROM c)""")
def branch_diff(spark, sf_dir):
    _, source, target = _three(spark, sf_dir)
    return branching.diff(source, target).select("key", "change", "value_a", "value_b")


@query(f"""{K} SELECT key, CASE WHEN NOT hb THEN 'added' WHEN NOT hc THEN 'removed' ELSE 'modified' END AS change, b AS value_a, c AS value_b FROM t
WHERE (hb OR hc) AND (NOT hb OR NOT hc OR b IS DISTINCT FROM c)""")
def branch_diff_since_fork(spark, sf_dir):
    """The same difference, of the keys alone that one of the branches wrote since the fork."""
    log = order_cells(spark, sf_dir)
    main, feature = cells.fork_view(log, [], "main"), cells.fork_view(log, [("main", 0)], "feature")
    keys = branching.touched(feature, main, {"main": (0, 0)})
    return branching.diff(*(cells.snapshot(branching.among(v, keys)) for v in (feature, main))).select("key", "change", "value_a", "value_b")


@query("""WITH m AS (SELECT max(o_orderkey) AS t FROM orders),
l AS (SELECT 'b' || o_orderkey % 4 AS branch, o_orderkey AS version, strlen('order:' || o_orderkey) + strlen(coalesce(o_orderpriority, '')) AS z FROM orders),
s AS (SELECT 'b1' AS branch, 'b0' AS parent, t // 2 AS bound FROM m UNION ALL SELECT 'b2', 'b0', t // 3 FROM m UNION ALL SELECT 'b3', 'b2', t // 4 FROM m UNION ALL SELECT 'b3', 'b0', t // 4 FROM m),
o AS (SELECT branch, count(*) AS n, sum(z) AS z, count(*) FILTER (version <= most) AS sn, sum(z) FILTER (version <= most) AS sz
  FROM l LEFT JOIN (SELECT parent, max(bound) AS most FROM s GROUP BY 1) p ON parent = branch GROUP BY 1),
i AS (SELECT s.branch, count(*) AS n, sum(z) AS z FROM s JOIN l ON l.branch = parent AND version <= bound GROUP BY 1)
SELECT o.branch, o.n::BIGINT AS own_rows, o.z::BIGINT AS own_bytes, sn::BIGINT AS shared_rows, coalesce(sz, 0)::BIGINT AS shared_bytes,
  coalesce(i.n, 0)::BIGINT AS inherited_rows, coalesce(i.z, 0)::BIGINT AS inherited_bytes FROM o LEFT JOIN i ON i.branch = o.branch""")
def branch_retention(spark, sf_dir):
    """Orders dealt to four branches; the last is forked from the third, which is forked from the first."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("bigint")
    log = orders.select(F.concat(F.lit("b"), (key % 4).cast("string")).alias("branch"), key.alias("version"), F.concat(F.lit("order:"), key.cast("string")).alias("key"), F.col("o_orderpriority").alias("value"))
    forks = spark.createDataFrame([("b1", "b0", 2), ("b2", "b0", 3), ("b3", "b2", 4), ("b3", "b0", 4)], "branch string, parent string, part int")
    seen = forks.crossJoin(orders.agg(F.max(key).alias("t"))).select("branch", "parent", F.expr("t div part").alias("bound"))
    return cells.retention(log, seen)


@query(f"{K} SELECT key, outcome, a AS ancestor_value, b AS source_value, c AS target_value FROM k WHERE outcome <> 'unchanged'")
def branch_diff3(spark, sf_dir):
    return branching.changes(_classified(spark, sf_dir)).drop("space", "type_tag")


@query(f"{K} SELECT outcome, count(*) AS n FROM k GROUP BY 1")
def branch_merge_outcomes(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""{K} SELECT key, CASE WHEN outcome IN ('source_added', 'source_changed', 'conflict', 'both_added_different', 'modify_delete_conflict') THEN b ELSE c END AS value FROM k
WHERE CASE WHEN outcome IN ('source_added', 'source_changed', 'conflict', 'both_added_different', 'modify_delete_conflict') THEN true
WHEN outcome IN ('source_deleted', 'delete_modify_conflict') THEN false ELSE hc END""")
def branch_merge_lww(spark, sf_dir):
    return branching.merged(_classified(spark, sf_dir)).select("key", "value")


@query(f"{K} SELECT key, outcome FROM k WHERE outcome IN ('conflict', 'both_added_different', 'delete_modify_conflict', 'modify_delete_conflict')")
def branch_merge_conflicts(spark, sf_dir):
    return branching.conflicts(_classified(spark, sf_dir)).select("key", "outcome")


@query(f"{K} SELECT key, 'put' AS action, value FROM src WHERE key IN ('order:10', 'order:12', 'order:11', 'order:3n')")
def branch_cherry_pick(spark, sf_dir):
    picks = spark.createDataFrame([("default", k) for k in ("order:10", "order:12", "order:11", "order:3n", "order:none")], "space string, key string")
    return branching.cherry_pick(_three(spark, sf_dir)[1], picks).select("key", "action", "value")


@query(f"""{K} SELECT key, CASE WHEN ha THEN 'put' ELSE 'delete' END AS action, a AS value FROM (
SELECT key, s AS a, true AS ha FROM o WHERE n % 20 IN (0, 1, 2) OR n % 20 = 4 OR n % 10 = 5
UNION ALL SELECT key, s, true FROM o WHERE n % 10 = 6) x WHERE NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.key = x.key AND tgt.value IS NOT DISTINCT FROM x.a)""")
def branch_revert(spark, sf_dir):
    log = order_cells(spark, sf_dir).where("branch = 'main'")
    return branching.revert(log, 6, 11, cells.alive(None)).select("key", "action", "value")


_PAIRS = [(4, 3), (4, 10), (0, 5), (11, 4)]


@query(f"""WITH RECURSIVE links AS (SELECT 'r:' || r_regionkey AS branch, 'root' AS up, 100 + r_regionkey AS ver FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 200 + n_nationkey FROM nation
  UNION ALL SELECT 'n:' || (n_nationkey + 1), 'n:' || n_nationkey, 300 + n_nationkey FROM nation WHERE n_nationkey % 7 = 3),
p(a, b) AS (VALUES {", ".join(f"('n:{a}', 'n:{b}')" for a, b in _PAIRS)}),
reach(start, branch, version) AS (SELECT DISTINCT x, x, 1000::BIGINT FROM (SELECT a AS x FROM p UNION SELECT b FROM p)
  UNION ALL SELECT start, up, ver::BIGINT FROM reach JOIN links USING (branch)),
best AS (SELECT start, branch, max(version) AS version FROM reach GROUP BY 1, 2)
SELECT a, b, x.branch AS branch, least(x.version, y.version) AS version FROM p JOIN best x ON x.start = a JOIN best y ON y.start = b AND x.branch = y.branch
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY least(x.version, y.version) DESC, x.branch) = 1""")
def branch_merge_base(spark, sf_dir):
    """Regions as forks of one branch, nations as forks of them; some nations were merged into the next one."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    n, r = F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")), lambda c: F.concat(F.lit("r:"), F.col(c).cast("string"))
    at = lambda base, c: (F.lit(base) + F.col(c)).cast("bigint").alias("fork_version")
    lineage = region.select(r("r_regionkey").alias("branch"), F.lit("root").alias("parent"), at(100, "r_regionkey")).unionByName(
        nation.select(n.alias("branch"), r("n_regionkey").alias("parent"), at(200, "n_nationkey"))
    )
    after = F.concat(F.lit("n:"), (F.col("n_nationkey") + 1).cast("string"))
    merges = nation.where("n_nationkey % 7 = 3").select(n.alias("source"), after.alias("target"), (F.col("n_nationkey") + 300).cast("bigint").alias("version"))
    found = [branching.merge_base(spark, lineage, merges, f"n:{a}", f"n:{b}", 1000, 1000).select(F.lit(f"n:{a}").alias("a"), F.lit(f"n:{b}").alias("b"), "*") for a, b in _PAIRS]
    return reduce(lambda x, y: x.unionByName(y), found)


@query("""SELECT 'order:' || o_orderkey AS key, 3::BIGINT AS version FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT 'order:' || o_orderkey || 'n', 4 FROM orders WHERE o_orderkey % 50 = 3
UNION ALL SELECT 'order:' || o_orderkey, 5 FROM orders WHERE o_orderkey % 10 = 4""")
def branch_own_entries(spark, sf_dir):
    """What the branch has written itself after version 2."""
    return cells.own_entries(order_cells(spark, sf_dir), "feature", 2).select("key", "version")
