"""Operators on small tables: edge cases that the SQL twins do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import analysis, jsonpath, recipes, values
from tessera.operators import branching, cells, events, graph, search, vectors
from tessera.operators.components import connected_components

CELL = "branch string, space string, type_tag string, key string, version long, ts_us long, is_tombstone boolean, ttl_ms long, value_type string, value string"


def log(spark, *rows):
    return spark.createDataFrame([("main", "default", "kv", k, v, t, dead, ttl, "string", val) for k, v, t, dead, ttl, val in rows], CELL)


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_visibility_goes_by_version_then_hides(spark):
    c = log(spark, ("a", 1, 100, False, None, "x"), ("a", 2, 50, True, None, None), ("b", 3, 10, False, 1, "y"), ("c", 4, 10, False, None, "z"))
    assert keys(cells.snapshot(c, now_us=5000)) == ["c"]
    assert keys(cells.snapshot(c, version=1)) == ["a"]
    assert keys(cells.as_of(c, 10)) == ["b", "c"]
    assert keys(cells.as_of(c, 1009)) == ["b", "c"]
    assert keys(cells.as_of(c, 1010)) == ["c"]


def test_fork_chain_bounds(spark):
    row = lambda b, k, v: (b, "default", "kv", k, v, v, False, None, "string", b)
    c = spark.createDataFrame([row("main", "a", 1), row("main", "b", 5), row("mid", "c", 6), row("mid", "a", 9), row("leaf", "d", 10)], CELL)
    view = cells.snapshot(cells.fork_view(c, [("mid", 7), ("main", 8)], "leaf"))
    assert {(r["key"], r["value"]) for r in view.collect()} == {("a", "main"), ("b", "main"), ("c", "mid"), ("d", "leaf")}


def test_prune_keeps_events_and_newest(spark):
    c = log(spark, ("a", 1, 1, False, None, "x"), ("a", 2, 2, False, None, "y"), ("a", 9, 9, False, None, "z"), ("b", 1, 1, True, None, None))
    e = c.where("key = 'a'").withColumn("type_tag", F.lit("event"))
    kept = cells.prune(c.unionByName(e), floor=5, max_versions=2, now_us=10)
    assert sorted((r["type_tag"], r["key"], r["version"]) for r in kept.collect()) == [("event", "a", 1), ("event", "a", 2), ("event", "a", 9), ("kv", "a", 2), ("kv", "a", 9)]


def test_sample_and_rank(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("key"))
    assert sorted(r["key"] for r in cells.sample_even(rows, 3).collect()) == ["0", "3", "6"]
    assert cells.sample_even(rows.limit(2), 5).count() == 2
    assert cells.sample_even(rows.where("false"), 5).count() == 0
    assert [r["rank"] for r in cells.with_rank(rows.repartition(4), "key").orderBy("key").collect()] == list(range(10))


def test_cas(spark):
    c = log(spark, ("a", 3, 1, False, None, "x"), ("b", 4, 1, True, None, None))
    want = spark.createDataFrame([("main", "default", "kv", k, v) for k, v in (("a", 3), ("b", 0), ("c", 0), ("d", 2))], "branch string, space string, type_tag string, key string, expected_version long")
    assert keys(cells.cas_conflicts(want, c)) == ["d"]


def test_chain_finds_tampering(spark):
    entries = spark.createDataFrame([(i, "t", json.dumps({"i": i}), i) for i in range(5)], "position int, event_type string, payload string, ts_us long")
    chain = events.append((-1, events.GENESIS), entries).cache()
    last = chain.orderBy("seq").collect()[-1]["hash"]
    assert events.verify_chain(chain).first().asDict() == {"checked": 5, "valid": True, "first_invalid": None, "last_hash": last}
    bad = chain.withColumn("payload", F.when(F.col("seq") == 3, '{"i":9}').otherwise(F.col("payload")))
    assert events.verify_chain(bad).first()["first_invalid"] == 3
    assert events.verify_chain(chain.where("seq <> 2")).first()["first_invalid"] == 3
    assert events.verify_chain(chain.where("false")).first().asDict() == {"checked": 0, "valid": True, "first_invalid": None, "last_hash": None}


def test_entry_errors(spark):
    rows = spark.createDataFrame([("a", '{"x": 1}'), (" ", "{}"), ("a", "[1]"), ("a", '{"x": NaN}'), ("b" * 300, "{}"), (None, "{}"), ("a", None)], "event_type string, payload string")
    assert [r["error"] is None for r in events.entry_errors(rows).collect()] == [True] + [False] * 6


@pytest.mark.parametrize("text, steps", [("", ()), ("a.b[0]", ("a", "b", 0)), (".a", ("a",)), ('["x y"].z', ("x y", "z")), ('a["q\\"r"]', ("a", 'q"r')), ("[1][2]", (1, 2))])
def test_paths(text, steps):
    assert jsonpath.parse(text) == steps
    assert jsonpath.parse(jsonpath.show(steps)) == steps


@pytest.mark.parametrize("bad", ["a..b", "a b", "[x]", "a[", "*"])
def test_bad_paths(bad):
    with pytest.raises(jsonpath.PathError):
        jsonpath.parse(bad)


def test_set_delete_merge():
    assert jsonpath.set_at({}, ("a", 0, "b"), 1) == {"a": [{"b": 1}]}
    assert jsonpath.set_at([1], (1,), 2) == [1, 2]
    for doc, path in (([1], (3,)), ([1], ("a",)), ({"a": 1}, (0,)), (5, ("a",))):
        with pytest.raises(jsonpath.PathError):
            jsonpath.set_at(doc, path, 0)
    assert jsonpath.delete_at({"a": [1, 2]}, ("a", 0)) == {"a": [2]} and jsonpath.delete_at({"a": 1}, ("b",)) == {"a": 1} and jsonpath.delete_at([1], ()) is None
    with pytest.raises(jsonpath.PathError):
        jsonpath.delete_at({"a": 1}, ("b", "c"))
    assert jsonpath.merge_patch({"a": 1, "b": {"c": 2}}, {"a": None, "b": {"d": 3}}) == {"b": {"c": 2, "d": 3}}
    assert jsonpath.three_way({"a": 1, "b": 1}, {"a": 2, "b": 1}, {"a": 1, "b": 3}) == ({"a": 2, "b": 3}, 0)
    assert jsonpath.three_way({"a": 1}, {"a": 2}, {"a": 3}) == ({"a": 2}, 1)
    assert jsonpath.three_way({"a": 1, "b": 1}, {"b": 1}, {"a": 1, "b": 1}) == ({"b": 1}, 0)


def test_value_equality():
    assert not values.equal(1, 1.0) and not values.equal(b"a", "a") and not values.equal(float("nan"), float("nan")) and values.equal(0.0, -0.0)
    assert values.equal({"a": [1, None]}, {"a": [1, None]}) and values.encode(1) == ("int", "1") and values.encode(1.0) == ("float", "1.0")


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"),
    ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("hopefulness", "hope"), ("triplicate", "triplic"),
    ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("as", "as"), ("über", "über"),
])
def test_porter(word, stem):
    assert analysis.porter(word) == stem


def test_query_parsing():
    q = analysis.parse_query('red "blue car" "one" red "open')
    assert q.terms == ["red", "blue", "car", "one", "open"] and q.phrases == [["blue", "car"]]


def test_words(spark):
    df = spark.createDataFrame([("The dog's U.S.A. can't 1,000 a x_y é hello-world",), ("",), (None,)], "text string")
    rows = [r["w"] for r in df.select(analysis.words(F.col("text")).alias("w")).collect()]
    assert [(t["pos"], t["term"]) for t in rows[0]] == [(1, "dog"), (2, "usa"), (3, "cant"), (4, "1000"), (6, "xy"), (7, "é"), (8, "hello"), (9, "world")]
    assert rows[1] == [] and rows[2] is None


def test_phrases_and_spans():
    assert search.count_phrase([[0, 5], [1, 9]], 0) == 1 and search.count_phrase([[0], [3]], 2) == 1 and search.count_phrase([[0], [3]], 1) == 0
    assert search.least_span([[0, 10], [12], [11]]) == 3


def test_search_edges(spark):
    corpus = spark.createDataFrame([("a", "quick brown fox"), ("b", "brown quick fox fox"), ("c", None), ("d", "")], "doc_ref string, text string")
    hits = search.bm25(corpus, '"quick brown" fox', 5).collect()
    assert [h["doc_ref"] for h in hits] == ["a", "b"]
    assert [h["doc_ref"] for h in search.bm25(corpus, '"quick brown"', 5, phrase_filter=True).collect()] == ["a"]
    assert search.bm25(corpus, "the of", 5).count() == 0 and search.bm25(corpus, "absent", 5).count() == 0
    assert [h["doc_ref"] for h in search.bm25(corpus, "foxes", 5, stem=True).collect()] == ["b", "a"]
    near = search.bm25(corpus, "quick fox", 5, proximity=True).collect()
    plain = {h["doc_ref"]: h["score"] for h in search.bm25(corpus, "quick fox", 5).collect()}
    assert {h["doc_ref"]: round(h["score"] - plain[h["doc_ref"]], 6) for h in near} == {"a": round(0.5 / 1.3, 6), "b": round(0.5 / 1.2, 6)}


def test_vector_conditions(spark):
    rows = [("a", [1.0, 0.0], '{"n": 3, "s": "Red"}'), ("b", [0.0, 0.0], '{"n": 3.0}'), ("c", [1.0, 0.0], None), ("d", [0.5, 0.5], "[1]")]
    v = spark.createDataFrame(rows, "vec_key string, embedding array<float>, metadata string").withColumns({"created_us": F.lit(0), "deleted_us": F.lit(None).cast("bigint")})
    got = lambda *f: sorted(r["vec_key"] for r in v.where(vectors.condition(*f)).collect())
    assert got("n", "eq", 3) == ["a"] and got("n", "ne", 3) == ["b"] and got("n", "gte", 3) == ["a", "b"] and got("s", "contains", "ed") == ["a"] and got("s", "gt", 1) == []
    assert got("s", "in", ["Red", 3]) == ["a"]
    assert [(r["vec_key"], round(r["score"], 6)) for r in vectors.nearest(v, [1.0, 0.0], 4).collect()] == [("a", 1.0), ("c", 1.0), ("d", 0.707107), ("b", 0.0)]
    with pytest.raises(vectors.DimensionMismatch):
        vectors.check([1.0], 2)


def test_sq8(spark):
    v = spark.createDataFrame([([0.0, 5.0],), ([1.0, 5.0],), ([0.5, 5.0],)], "embedding array<float>")
    low, high = vectors.sq8_bounds(v, 2)
    assert [r["code"] for r in vectors.sq8(v, low, high).collect()] == [[0, 0], [255, 0], [128, 0]]
    assert [r["bits"] for r in vectors.binary_code(v, [0.6, 5.0]).collect()] == ["01", "11", "01"]


EDGE = "src string, dst string, edge_type string, weight double"


def test_graph_edges(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "x", 1.0), ("c", "a", "x", 1.0), ("a", "a", "x", 1.0), ("c", "d", "y", 2.0), ("a", "b", "y", 5.0)], EDGE)
    nodes = spark.createDataFrame([("z",)], "node_id string")
    look = lambda df: {r[0]: r[1] for r in df.collect()}
    assert look(graph.degree(nodes, e)) == {"a": 5, "b": 3, "c": 3, "d": 1, "z": 0}
    assert look(graph.wcc(nodes, e)) == {"a": 0, "b": 0, "c": 0, "d": 0, "z": 4}
    assert look(graph.lcc(nodes, e)) == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3), "d": 0.0, "z": 0.0}
    assert look(graph.sssp(e, "a")) == {"a": 0.0, "b": 1.0, "c": 2.0, "d": 4.0}
    assert [tuple(r) for r in graph.bfs(e, "b", edge_types=["x"]).orderBy("depth").collect()] == [("b", 0, None), ("c", 1, "b"), ("a", 2, "c")]
    assert graph.bfs(e, "nowhere").count() == 1
    rank, n = graph.pagerank(nodes, e, max_iterations=100)
    assert n < 100 and sum(r["rank"] for r in rank.collect()) == pytest.approx(1)
    with pytest.raises(ValueError):
        graph.pagerank(nodes, e, personal=spark.createDataFrame([("q", 1.0)], "node_id string, weight double"))
    empty = e.where("false")
    assert graph.wcc(None, empty).count() == 0 and graph.pagerank(None, empty)[1] == 0 and graph.lcc(None, empty).count() == 0
    with pytest.raises(ValueError):
        graph.sssp(e.withColumn("weight", F.lit(-1.0)), "a")


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    more = spark.createDataFrame([(500, 501), (501, 501), (None, 3)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(path.unionByName(more)).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100])
def test_score_distribution(spark, n):
    row = graph.score_distribution(spark.range(1, n + 1).select(F.col("id").cast("double").alias("v")), "v").first()
    assert row["n"] == n
    if n:
        assert (row["median"], row["p90"], row["p99"], row["max"]) == ((n + 1) / 2, -(-n * 9 // 10), -(-n * 99 // 100), n)


def test_three_way_outcomes(spark):
    side = lambda d: spark.createDataFrame([("s", "kv", k, v) for k, v in d.items()], "space string, type_tag string, key string, value string")
    anc = {"same": "1", "sc": "1", "tc": "1", "bs": "1", "cf": "1", "sd": "1", "td": "1", "dm": "1", "md": "1", "bd": "1", "null": None}
    src = {"same": "1", "sc": "2", "tc": "1", "bs": "2", "cf": "2", "td": "1", "md": "2", "sa": "1", "as": "1", "ad": "1", "null": None}
    tgt = {"same": "1", "sc": "1", "tc": "2", "bs": "2", "cf": "3", "sd": "1", "dm": "2", "ta": "1", "as": "1", "ad": "2"}
    found = {r["key"]: r["outcome"] for r in branching.classify(side(anc), side(src), side(tgt)).collect()}
    assert found == {
        "same": "unchanged", "sc": "source_changed", "tc": "target_changed", "bs": "both_changed_same", "cf": "conflict", "sd": "source_deleted", "td": "target_deleted",
        "dm": "delete_modify_conflict", "md": "modify_delete_conflict", "bd": "both_deleted", "sa": "source_added", "ta": "target_added", "as": "both_added_same",
        "ad": "both_added_different", "null": "target_deleted",
    }
    with pytest.raises(branching.MergeConflict):
        branching.merge(side(anc), side(src), side(tgt), strict=True)


def test_documents_merge_inside(spark):
    side = lambda v: spark.createDataFrame([("s", "json", "d", v)], "space string, type_tag string, key string, value string")
    row = branching.merge(side('{"a":1,"b":1}'), side('{"a":2,"b":1}'), side('{"a":1,"b":3}')).first()
    assert row["value"] == '{"a":2,"b":3}'


def test_helpers():
    assert recipes.sandwich([1, 2, 3, 4, 5]) == [1, 3, 5, 4, 2] and recipes.citations("x [2] [1, 2] [9]", 3) == [2, 1]
    assert recipes.parse_expansion("lex: red car\nvec: boats\nhyde: a text\nno", "red fox") == [("lex", "red car"), ("hyde", "a text")]
    assert recipes.parse_ratings("1: 8\n[2]: 15\nx") == {1: 0.8, 2: 1.0} and recipes.strong_signal([0.9, 0.7]) and not recipes.strong_signal([0.9, 0.8])
    assert recipes.embedding_text({"b": [1, None], "a": "x"}) == "a: x\nb: 1"
