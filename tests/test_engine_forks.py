"""Forks through compaction, what goes with a merged value, and commands that other tests do not reach."""

import pytest

from tessera.engine import Engine
from tessera.errors import NotFound
from tessera.operators import cells


@pytest.fixture()
def db(spark, tmp_path):
    ticks = iter(range(1_000_000, 1_000_000_000, 1000))
    return Engine(spark, str(tmp_path / "db"), clock=lambda: next(ticks))


def test_compaction_keeps_what_forks_inherit(db):
    db.kv_put("k", 1)
    db.kv_put("gone", "x")
    db.branch_fork("default", "fork")
    db.kv_put("k", 2)
    db.kv_delete("gone")
    db.branch_use("fork")
    db.kv_put("own", 5)
    db.branch_fork("fork", "deep")
    db.kv_put("own", 6)
    db.branch_use("default")
    db.kv_put("k", 3)
    before = db._raw().count()
    assert db.compact() == before - 1
    for _ in range(2):
        assert db.kv_get("k")["value"] == 3 and db.kv_get("gone") is None
        db.branch_use("fork")
        assert db.kv_get("k")["value"] == 1 and db.kv_get("gone")["value"] == "x" and db.kv_get("own")["value"] == 6
        assert db.kv_delete("k") and db.kv_get("k") is None
        db.compact()
        assert db.kv_get("k") is None  # the tombstone hides what is inherited
        db.kv_put("k", 1)
        db.branch_use("deep")
        assert db.kv_get("k")["value"] == 1 and db.kv_get("own")["value"] == 5
        db.branch_use("default")


def test_a_compaction_that_breaks_off_leaves_the_log(db, spark):
    db.kv_put("k", 1)
    db.kv_put("k", 2)
    half = db._folder(1)
    spark.createDataFrame([], cells.SCHEMA).write.parquet(half)  # written, but no pointer was made
    assert db.kv_get("k")["value"] == 2 and len(db.kv_getv("k")) == 2
    db.compact()
    assert db.kv_get("k")["value"] == 2 and len(db.kv_getv("k")) == 1
    db.kv_put("k", 3)
    assert Engine(spark, db.root).kv_get("k")["value"] == 3


def test_a_merged_value_still_expires(db):
    db.branch_fork("default", "side")
    db.branch_use("side")
    db.kv_put("short", 1.0, ttl_ms=5_000_000)
    db.kv_put("kept", b"\x01")
    db.branch_use("default")
    db.branch_merge("side", "default")
    rows = {r["key"]: r for r in db.frame("kv").collect()}
    assert rows["short"]["ttl_ms"] == 5_000_000 and rows["kept"]["ttl_ms"] is None
    assert db.kv_get("short")["value"] == 1.0 and db.kv_get("kept")["value"] == b"\x01"
    db.clock = lambda: 10_000_000_000_000
    assert db.kv_get("short") is None and db.kv_get("kept")["value"] == b"\x01"


def test_cherry_pick_and_three_way_diff(db):
    db.kv_put("a", 1)
    db.branch_fork("default", "side")
    db.branch_use("side")
    db.kv_put("a", 2)
    db.kv_put("b", "x", ttl_ms=9_000_000)
    db.branch_use("default")
    assert {(r["key"], r["outcome"]) for r in db.branch_diff_three_way("side", "default").collect()} == {("a", "source_changed"), ("b", "source_added")}
    db.branch_cherry_pick("side", "default", keys=[("default", "b"), ("default", "none")])
    assert db.kv_get("b")["value"] == "x" and db.kv_get("a")["value"] == 1
    assert [r["ttl_ms"] for r in db.frame("kv").where("key = 'b'").collect()] == [9_000_000]


def test_batches_of_keys_and_documents(db):
    db.kv_batch_put({"a": 1, "b": None})
    assert [x and x["value"] for x in db.kv_batch_get(["b", "none", "a"])] == [None, None, 1]
    assert db.kv_batch_delete(["a", "none", "a"]) == [True, False, True] and db.kv_count() == 1
    assert db.json_batch_set([("d", "", {"x": 1}), ("d", "y", 2), ("", "", 1)])[:2] == [None, None]
    assert db.json_batch_get([("d", "x"), ("d", "y"), ("e", "")]) == [1, 2, None]
    assert db.json_batch_delete([("d", "x"), ("e", "")]) == [True, False] and db.json_exists("d")
    assert db.json_sample(count=1)["total"] == 1


def test_vectors_one_by_one(db):
    db.vector_create_collection("c", 2)
    db.vector_upsert("c", "k", [1.0, 0.0], {"n": 1})
    db.vector_upsert("c", "k", [0.0, 1.0])
    assert db.vector_get("c", "k") == {"embedding": [0.0, 1.0], "metadata": None} and len(db.vector_getv("c", "k")) == 2
    assert db.vector_exists("c", "k") and not db.vector_exists("c", "none")
    assert [v and v["embedding"] for v in db.vector_batch_get("c", ["none", "k"])] == [None, [0.0, 1.0]]
    assert db.vector_sample("c", 1)[0]["key"] == "k" and db.vector_delete("c", "k") and not db.vector_delete("c", "k")
    assert db.vector_count("c") == 0 and db.vector_delete_collection("c")
    with pytest.raises(NotFound):
        db.vector_count("none")


def test_events_by_time_and_existence(db):
    for i in range(3):
        db.event_append("a" if i < 2 else "b", {"i": i})
    times = [e["ts_us"] for e in db.event_list()]
    assert [e["seq"] for e in db.event_range_by_time(times[0], times[1])["events"]] == [0, 1]
    assert db.event_exists(2) and not db.event_exists(3) and [e["seq"] for e in db.event_list("b")] == [2]
