"""Classification, merge and revert from one shuffle of the log, in bounded parts, against the same from snapshots."""

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import branching, cells
from tessera.plans.registry import QUERIES

LOG = "branch string, space string, type_tag string, key string, version bigint, ts_us bigint, is_tombstone boolean, ttl_ms bigint, value_type string, value string"


def rows(spark):
    """All that a key can go through: written, deleted, expired or untouched before the fork, on the branch and on main; documents too."""
    out, n = [], 0
    for before in (None, "a", "dead"):
        for there in (None, "a", "b", "dead"):
            for here in (None, "a", "b", "dead", "null"):
                for tag, wrap in (("kv", lambda v: v), ("json", lambda v: f'{{"{v}":1}}')):
                    n += 1
                    for branch, version, v in (("main", 1, before), ("feature", 2, there), ("main", 3, here)):
                        if v is not None:
                            value = None if v in ("dead", "null") else wrap(v)
                            out.append((branch, "default", tag, f"k{n}", version, version, v == "dead", n, "string", value))
    return spark.createDataFrame(out, LOG)


@pytest.fixture(params=["whole", "parts"])
def log(spark, request, monkeypatch):
    if request.param == "parts":
        monkeypatch.setattr(session, "PART_BYTES", 64)
    return rows(spark)


def plain(df):
    return sorted(map(str, df.collect()))


def both(log):
    main, seen, alive = F.col("branch") == "main", cells.seen_by([("main", 1)], "feature"), cells.alive(None)
    on_main = log.where(main)
    three = cells.snapshot(on_main, version=1), cells.snapshot(cells.fork_view(log, [("main", 1)], "feature")), cells.snapshot(on_main)
    return three, branching.classify_log(log, main & (F.col("version") <= 1), seen, main, alive)


def test_outcomes_as_from_snapshots(log):
    three, got = both(log)
    assert plain(got) == plain(branching.classify(*three))
    assert len({r["outcome"] for r in got.collect()}) == 14


def test_merged_as_applied(log):
    three, got = both(log)
    assert plain(branching.merged(got)) == plain(branching.apply(three[2], branching.merge(*three)))


def test_revert_as_from_snapshots(log):
    on_main, alive = log.where("branch = 'main'"), cells.alive(None)
    at = lambda df: cells.newest(df).where(alive)
    t = branching._aligned({"before": at(on_main.where("version < 2")), "after": at(on_main.where("version <= 3")), "now": at(on_main)})
    want = t.where("NOT (before <=> after) AND after <=> now").select(*branching.KEY, F.expr("if(before IS NULL, 'delete', 'put')").alias("action"), "before.*")
    assert plain(branching.revert(on_main, 2, 3, alive)) == plain(want) and want.count() > 5


@pytest.mark.parametrize("name", ["branch_diff3", "branch_merge_outcomes", "branch_merge_lww", "branch_merge_conflicts", "branch_revert"])
def test_parts_are_in_proportion_to_the_log(spark, tmp_path, monkeypatch, name):
    part = "id AS o_orderkey, 'O' AS o_orderstatus, '1-URGENT' AS o_orderpriority"
    spark.range(2000).selectExpr(*part.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    counts = []
    for size in (4096, 1024):
        monkeypatch.setattr(session, "PART_BYTES", size)
        text = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        found = [int(x.rsplit(", ", 1)[-1]) for x in text.splitlines() if "RepartitionByExpression" in x]
        assert found, text
        counts.append(max(found))
    assert counts[1] > 3 * counts[0] > 0
