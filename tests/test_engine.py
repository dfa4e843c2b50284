"""The command facade: each primitive, branches, transactions, search, import and export."""

import json

import pytest

from tessera.engine import Engine, branch_id
from tessera.errors import AlreadyExists, Conflict, ConstraintViolation, InvalidInput, NotFound, NotImplementedHere, TransactionState, WrongDimension


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    ticks = iter(range(1_000_000, 10_000_000, 1000))
    return Engine(spark, str(tmp_path_factory.mktemp("db")), clock=lambda: next(ticks), embedder=lambda ts: [[float(len(t)), 1.0] for t in ts])


def test_key_values(db):
    first = db.kv_put("a", 1)
    db.kv_put("a", 1.5)
    assert db.kv_batch_put({"b": {"x": [1, None]}, "": 3, "c": b"\x00\xff"}) == [None, "not a key: ''", None]
    assert db.kv_get("a")["value"] == 1.5 and db.kv_get("b")["value"] == {"x": [1, None]} and db.kv_get("c")["value"] == b"\x00\xff"
    assert [v["value"] for v in db.kv_getv("a")] == [1.5, 1]
    before = db.kv_getv("a")[1]["timestamp"]
    assert db.kv_get("a", as_of=before)["value"] == 1 and db.kv_get("a", as_of=before - 1) is None
    assert db.kv_list(limit=2) == {"keys": ["a", "b"], "has_more": True, "cursor": "b"}
    assert db.kv_list(limit=2, cursor="b")["keys"] == ["c"]
    assert db.kv_delete("b") and not db.kv_delete("b") and not db.kv_exists("b")
    assert db.kv_batch_exists(["a", "b", "a"]) == [True, False, True]
    assert db.kv_scan("b") == [("c", b"\x00\xff")] and db.kv_count() == 2
    assert db.execute("KvSample", count=1)["items"] == [("a", 1.5)]
    assert first == 2  # the default branch is the first commit


def test_json(db):
    db.json_set("d", "", {"n": 3, "t": "Red", "list": [1]})
    db.json_set("d", "list[1]", 2)
    with pytest.raises(InvalidInput):
        db.json_set("d", "list[9]", 2)
    assert db.json_get("d", "list[1]") == 2 and db.json_get("d", "no.where") is None
    assert db.json_delete("d", "list[0]") and db.json_get("d", "list") == [2]
    assert db.json_batch_set([("e", "n", 5), ("e", "t", "blue"), ("", "x", 1)])[:2] == [None, None]
    db.json_create_index("size", "n", "numeric")
    from tessera.operators.documents import NotIndexed, Range

    assert db.json_search(Range("n", 4)) == ["e"] and db.json_search(sort="n", descending=True) == ["e", "d"]
    with pytest.raises(NotIndexed):
        db.json_search(Range("t", "a"))
    assert db.json_list(cursor="d")["keys"] == ["e"] and db.json_list(cursor="none")["keys"] == []
    assert db.json_drop_index("size") and db.json_list_indexes() == []
    assert db.json_delete("e") and not db.json_exists("e")


def test_events(db):
    assert db.event_append("click", {"a": 1}) == 0
    assert db.event_batch_append([("view", {"b": 2}), ("view", [1]), ("click", {"c": 3})])[0::2] == [1, 2]
    with pytest.raises(InvalidInput):
        db.event_append("x", {"a": float("nan")})
    page = db.event_range(0, limit=2)
    assert [e["seq"] for e in page["events"]] == [0, 1] and page["has_more"] and page["cursor"] == "seq:1"
    assert [e["seq"] for e in db.event_get_by_type("click", after_sequence=0)] == [2]
    assert db.event_len() == 3 and db.event_list_types() == ["click", "view"]
    chain = db.event_verify_chain()
    assert (chain["checked"], chain["valid"], chain["first_invalid"], len(chain["last_hash"])) == (3, True, None, 64)


def test_vectors(db):
    db.vector_create_collection("v", 2, "l2")
    with pytest.raises(AlreadyExists):
        db.vector_create_collection("v", 2)
    with pytest.raises(WrongDimension):
        db.vector_batch_upsert("v", [("x", [1, 2], None), ("y", [1], None)])
    db.vector_batch_upsert("v", [("x", [0, 0], {"c": "red"}), ("y", [3, 4], {"c": "blue"}), ("z", [0, 0], None)])
    assert [k for k, _ in db.vector_query("v", [0, 0], 2)] == ["x", "z"]
    assert db.vector_query("v", [0, 0], 5, filter=[("c", "ne", "red")]) == [("y", pytest.approx(1 / 6))]
    assert db.vector_query("v", [0, 0], 0) == [] and db.vector_count("v") == 3
    assert db.vector_batch_delete("v", ["x", "none"]) == [True, False]
    assert db.vector_collection_stats("v")["bytes"] == 16
    assert db.vector_delete_collection("v") and db.vector_list_collections() == []


def test_graph(db):
    db.graph_create("g")
    db.graph_define_object_type("g", {"name": "P", "properties": {"age": {"type": "number", "required": True}}})
    db.graph_define_link_type("g", {"name": "KNOWS", "source": "P", "target": "P"})
    db.graph_freeze_ontology("g")
    with pytest.raises(ConstraintViolation):
        db.graph_add_node("g", "a", object_type="P")
    assert db.graph_add_node("g", "a", object_type="P", properties={"age": 3})
    db.graph_bulk_insert("g", [{"node_id": n} for n in "bcd"], [{"src": "a", "dst": "b", "edge_type": "KNOWS"}, {"src": "b", "dst": "c", "edge_type": "KNOWS"}])
    with pytest.raises(NotFound):
        db.graph_add_edge("g", "a", "zz", "KNOWS")
    assert db.graph_neighbors("g", "b", "both") == [("a", "KNOWS", 1.0), ("c", "KNOWS", 1.0)]
    assert [(n, d) for n, d, _ in db.graph_bfs("g", "a")] == [("a", 0), ("b", 1), ("c", 2)]
    assert db.graph_wcc("g")["groups"] == [{"component": 0, "size": 3, "sample": ["a", "b", "c"]}, {"component": 3, "size": 1, "sample": ["d"]}]
    assert db.graph_sssp("g", "a")["top"] == [("a", 0.0), ("b", 1.0), ("c", 2.0)]
    assert db.graph_pagerank("g")["top"][0][0] == "c"
    db.graph_remove_node("g", "b")
    assert db.graph_list_nodes("g") == ["a", "c", "d"] and db.graph_neighbors("g", "a") == []
    assert db.graph_list_ontology_types("g") == ["KNOWS", "P"]


def test_branches(db):
    db.kv_put("shared", "old")
    db.branch_fork("default", "work")
    db.branch_use("work")
    db.kv_put("shared", "new")
    db.kv_put("mine", 1)
    db.branch_use("default")
    assert db.kv_get("shared")["value"] == "old" and db.kv_get("mine") is None
    changes = {r["key"]: r["change"] for r in db.branch_diff("default", "work").collect()}
    assert changes == {"shared": "modified", "mine": "added"}
    assert db.branch_merge_base("default", "work")["branch"] == "default"
    db.kv_put("shared", "other")
    with pytest.raises(Conflict):
        db.branch_merge("work", "default", "strict")
    at = db.branch_merge("work", "default")
    assert at["conflicts"] == 1 and db.kv_get("shared")["value"] == "new" and db.kv_get("mine")["value"] == 1
    db.branch_revert(at["version"], at["version"])
    assert db.kv_get("mine") is None and db.kv_get("shared")["value"] == "other"
    assert branch_id("default") == "00000000-0000-0000-0000-000000000000"
    db.tag_create("t1")
    db.note_add(3, "hello")
    assert db.tag_resolve("t1")["name"] == "t1" and [n["message"] for n in db.note_get()] == ["hello"]
    assert db.tag_delete("t1") and db.tag_list() == []


def test_bundles(db, tmp_path):
    info = db.branch_export("work", str(tmp_path / "b"))
    assert db.branch_bundle_validate(str(tmp_path / "b"))["valid"]
    db.branch_delete("work")
    assert not db.branch_exists("work")
    assert db.branch_import(str(tmp_path / "b"))["entries"] == info["entries"]
    db.branch_use("work")
    assert db.kv_get("mine")["value"] == 1 and db.branch_get()["generation"] == 1
    db.branch_use("default")


def test_transactions(db):
    db.kv_put("n", 1)
    db.txn_begin()
    with pytest.raises(TransactionState):
        db.txn_begin()
    db.kv_get("n")
    db.kv_put("m", 2)
    assert db.kv_get("m")["value"] == 2 and db.txn_is_active()
    db.txn_commit()
    assert db.kv_get("m")["value"] == 2
    db.txn_begin()
    assert db.kv_get("n")["value"] == 1
    db.kv_put("m", 3)
    txn, db._txn = db._txn, None  # another session writes meanwhile
    db.kv_put("n", 9)
    db._txn = txn
    with pytest.raises(Conflict):
        db.txn_commit()
    assert db.kv_get("m")["value"] == 2
    db.txn_begin()
    db.kv_delete("m")
    db.txn_rollback()
    assert db.kv_exists("m")


def test_transactions_of_other_types(db):
    db.txn_begin()
    db.json_set("t", "a", 1)
    db.json_set("t", "b", 2)
    seq = db.event_append("inside", {"x": 1})
    assert db.json_get("t") == {"a": 1, "b": 2} and db.event_get(seq)["event_type"] == "inside" and db.json_count("t") == 1
    with pytest.raises(TransactionState):
        db.graph_delete("g")
    db.txn_rollback()
    assert db.json_get("t") is None and db.event_get(seq) is None
    db.txn_begin()
    db.json_set("t", "a", 1)
    db.kv_delete("n")
    assert not db.kv_exists("n") and "n" not in db.kv_list()["keys"]
    db.txn_commit()
    assert db.json_get("t", "a") == 1 and not db.kv_exists("n")


def test_search_and_recipes(db):
    db.json_set("s1", "", {"text": "running foxes jump"})
    db.json_set("s2", "", {"text": "a fox is quick"})
    assert {h["doc_ref"] for h in db.search("fox")} == {"json:s1", "json:s2"}
    assert db.search("nothing here") == []
    db.recipe_set("mine", json.dumps({"retrieve": {"bm25": {"k": 1, "k1": 0.9, "b": 0.4}}, "transform": {"limit": 1}}))
    assert "mine" in db.recipe_list() and len(db.search("fox", "mine")) == 1
    assert db.recipe_delete("mine") and "mine" not in db.recipe_list()
    assert db.reindex_embeddings() > 0
    before = db.json_getv("s1")[0]["timestamp"]
    changed = db.search("fox", diff=(before - 1, before + 100_000))
    assert {r["doc_ref"]: r["change"] for r in changed} == {"json:s1": "added", "json:s2": "added"}
    assert [h["doc_ref"] for h in db.search("fox", between=(before, before))] == ["json:s1"]
    assert len(db.search("fox", depth=1)[0]["versions"]) == 1
    db.expander, db.reranker = (lambda q: "lex: quick fox\nvec: other"), (lambda q, texts: "\n".join(f"{i}: {10 if 'jump' in t else 0}" for i, t in enumerate(texts, 1)))
    db.generator = lambda prompt: "It jumps [1], not [9]."
    assert db.search("fox", "rag", k=1)[0]["doc_ref"] in ("json:s1", "json:s2")
    assert len(db.answer("fox")["citations"]) == 1


def test_import_export(db, tmp_path, spark):
    spark.createDataFrame([("i1", "x"), (None, "y")], "id string, title string").write.parquet(str(tmp_path / "in.parquet"))
    assert db.arrow_import(str(tmp_path / "in.parquet"), "kv") == {"imported": 2 - 1, "skipped": 1}
    assert db.kv_get("i1")["value"] == "x"
    assert db.db_export("kv", "csv", str(tmp_path / "out.csv"), prefix="i1") == 1
    assert "i1,x" in "".join(p.read_text() for p in (tmp_path / "out.csv").glob("*.csv"))


def test_administration(db):
    assert db.ping() and db.info()["branches"] == 2 and db.health()["log"]
    with pytest.raises(NotImplementedHere):
        db.retention_stats()
    db.configure_set("k", "v")
    assert db.configure_get_key("k") == "v"
    db.space_use("other")
    db.kv_put("in_other", 1)
    db.space_use("default")
    assert db.space_list() == ["default", "other"]
    with pytest.raises(ConstraintViolation):
        db.space_delete("other")
    db.space_delete("other", force=True)
    assert db.space_list() == ["default"]
    live = lambda: {(r["space"], r["type_tag"]): r["live"] for r in db.describe().collect() if r["live"]}
    before = live()
    db.compact()
    assert live() == before
    with pytest.raises(InvalidInput):
        db.execute("NoSuchCommand")
