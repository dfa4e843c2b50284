"""What branches share, scans in transactions, entities that go, embedding on write, retention."""

import pytest

from tessera.engine import Engine
from tessera.errors import Conflict
from tessera.operators import branching


@pytest.fixture()
def db(spark, tmp_path):
    ticks = iter(range(1_000_000, 1_000_000_000, 1000))
    return Engine(spark, str(tmp_path / "db"), clock=lambda: next(ticks), embedder=lambda ts: [[float(len(t)), 1.0] for t in ts])


def test_a_diff_reads_the_keys_written_since_the_fork(db):
    db.kv_batch_put({f"k{i}": i for i in range(5)})
    db.branch_fork("default", "a")
    db.kv_put("k0", "main")
    db.branch_use("a")
    db.kv_put("k1", "a")
    db.kv_delete("k2")
    db.branch_fork("a", "b")
    db.branch_use("b")
    db.kv_put("k3", "b")
    assert {r["key"] for r in db._touched("default", "a").collect()} == {"k0", "k1", "k2"}
    assert {r["key"] for r in db._touched("a", "b").collect()} == {"k3"}
    for x, y in (("default", "a"), ("a", "b"), ("b", "default"), ("a", "a")):
        whole = branching.diff(db._snapshot(x), db._snapshot(y)).collect()
        assert sorted(map(tuple, db.branch_diff(x, y).collect())) == sorted(map(tuple, whole))
    assert {(r["key"], r["outcome"]) for r in db.branch_diff_three_way("b", "default").collect()} == {
        ("k0", "target_changed"), ("k1", "source_changed"), ("k2", "source_deleted"), ("k3", "source_changed")}


def test_a_branch_made_again_shares_nothing_with_old_forks(db):
    db.branch_create("x")
    db.branch_use("x")
    db.kv_put("k", 1)
    db.branch_fork("x", "y")
    db.branch_use("default")
    db.branch_delete("x")
    db.branch_create("x")
    assert [tuple(r)[2:4] for r in db.branch_diff("x", "y").collect()] == [("k", "added")]


def test_scans_of_a_transaction_are_reads(db):
    db.kv_batch_put({"a1": 1, "a2": 2, "b1": 3})

    def commit(read, written):
        db.txn_begin()
        read()
        db.kv_put("own", 0)
        txn, db._txn = db._txn, None
        db.kv_put(written, "other")
        db._txn = txn
        return db.txn_commit()

    for read in (lambda: db.kv_list("a"), lambda: db.kv_count("a"), lambda: db.kv_sample("a", 1), lambda: db.kv_scan("a1", 1)):
        with pytest.raises(Conflict):
            commit(read, "a2")
        assert not db.txn_is_active()
    assert commit(lambda: db.kv_list("a"), "b1") and commit(lambda: db.kv_scan("b"), "a1")
    assert commit(lambda: db.kv_list("a"), "a3")  # a key that the scan did not see


def test_entities_that_go(db):
    for graph, policy in (("c", "cascade"), ("d", "detach"), ("i", "ignore")):
        db.graph_create(graph, policy)
        db.graph_add_node(graph, "n", entity_ref="kv:k", properties={"p": 1}, object_type="T")
        db.graph_add_node(graph, "m")
        db.graph_add_edge(graph, "n", "m", "E")
        db.graph_add_edge(graph, "n", "n", "E")
    assert db.graph_nodes_for_entity("kv:k") == [("c", "n"), ("d", "n"), ("i", "n")]
    assert db.graph_entities_deleted(["kv:k", "kv:none"]) == 3
    assert db.graph_list_nodes("c") == ["m"] and db.graph_neighbors("c", "m", "both") == []
    assert db.graph_get_node("d", "n") == {"entity_ref": None, "object_type": "T", "properties": '{"p":1}'}
    assert len(db.graph_neighbors("d", "n")) == 2 and db.graph_nodes_for_entity("kv:k") == [("i", "n")]


def test_a_graph_deleted_here_and_written_there(db):
    db.graph_create("g")
    db.graph_add_node("g", "a")
    db.branch_fork("default", "side")
    db.graph_delete("g")
    db.branch_use("side")
    db.kv_put("x", 1)
    db.branch_use("default")
    db.branch_merge("side", "default")
    db.branch_use("side")
    db.graph_add_node("g", "b")
    db.branch_use("default")
    with pytest.raises(Conflict):
        db.branch_merge("side", "default")


def test_embedding_on_write(db, monkeypatch):
    monkeypatch.setattr("tessera.engine.EMBED_BATCH", 3)
    db.kv_put("before", "x")
    db.config_set_auto_embed(True)
    db.kv_put("a", "xx")
    db.kv_put("a", "xxx")
    db.txn_begin()
    db.json_set("d", "", {"t": "y"})
    assert db.embed_status()["pending"] == 1
    db.txn_commit()
    assert db.embed_status() == {"auto_embed": True, "pending": 2, "batch_size": 3}
    db.event_append("e", {"z": 1})
    assert db.embed_status()["pending"] == 0 and db.vector_count("embedded") == 3
    db.kv_put("b", "x")
    db.flush()
    assert db.vector_count("embedded") == 4 and db.embed_status()["pending"] == 0


def test_retention_report(db):
    db.kv_put("k", 1)
    db.branch_fork("default", "side")
    db.kv_put("k", 22)
    db.branch_use("side")
    db.kv_put("own", 3)
    got = {r["branch"]: r for r in db.retention_report()}
    assert (got["default"]["own_rows"], got["default"]["shared_rows"], got["default"]["inherited_rows"]) == (2, 1, 0)
    assert (got["default"]["own_bytes"], got["default"]["shared_bytes"]) == (5, 2) and got["default"]["status"] == "active"
    assert (got["side"]["own_rows"], got["side"]["shared_rows"], got["side"]["inherited_rows"], got["side"]["inherited_bytes"]) == (1, 0, 1, 2)
    db.branch_use("default")
    db.branch_delete("side")
    gone = {r["branch"]: r for r in db.retention_report()}
    assert gone["side"]["status"] is None and gone["default"]["shared_rows"] == 0


def test_events_of_a_type_at_a_time(db):
    for i in range(3):
        db.event_append("a", {"i": i})
    at = db.event_get(1)["ts_us"]
    assert [e["seq"] for e in db.event_get_by_type("a", as_of=at)] in ([0], [0, 1])
    assert [e["seq"] for e in db.event_get_by_type("a", as_of=at + 10_000_000)] == [0, 1, 2]
