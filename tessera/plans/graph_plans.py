"""Queries over the graphs of places and of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.registry import query
from tessera.plans.views import PLACE_SQL, order_edges, place_edges
from tessera.session import table

G = f"WITH {PLACE_SQL}"
A = f"{G}, a AS (SELECT src AS a, dst AS b, weight FROM g UNION ALL SELECT dst, src, weight FROM g)"


@query(f"{G} SELECT dst AS node_id, edge_type, weight FROM g WHERE src = 'n:3' UNION ALL SELECT src, edge_type, weight FROM g WHERE dst = 'n:3'")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(place_edges(spark, sf_dir), "n:3", graph.BOTH)


@query(f"{A} SELECT node_id, count(a.a) AS degree FROM ids LEFT JOIN a ON node_id = a.a GROUP BY 1")
def graph_degree(spark, sf_dir):
    return graph.degree(None, place_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {PLACE_SQL}, r(node_id, depth) AS (SELECT 'r:1', 0 UNION SELECT g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node_id WHERE r.depth < 4)
SELECT node_id, min(depth)::INT AS depth FROM r GROUP BY 1""")
def graph_bfs(spark, sf_dir):
    return graph.bfs(place_edges(spark, sf_dir), "r:1", max_depth=4, direction=graph.IN).select("node_id", "depth")


@query(f"{G} SELECT src, dst, edge_type FROM g WHERE src[1] IN ('s', 'n') AND dst[1] IN ('s', 'n')")
def graph_subgraph(spark, sf_dir):
    edges = place_edges(spark, sf_dir)
    members = graph.node_ids(None, edges).where(F.substring("node_id", 1, 1).isin("s", "n"))
    return graph.subgraph(edges, members).select("src", "dst", "edge_type")


@query("""WITH ids AS (SELECT 'o:' || o_orderkey AS node_id, o_custkey AS c FROM orders UNION SELECT 'c:' || o_custkey, o_custkey FROM orders),
r AS (SELECT node_id, c, row_number() OVER (ORDER BY node_id) - 1 AS rk FROM ids) SELECT node_id, min(rk) OVER (PARTITION BY c) AS component FROM r""")
def graph_wcc(spark, sf_dir):
    return graph.wcc(None, order_edges(spark, sf_dir))


def _cdlp_sql(rounds: int) -> str:
    out = f"{A}, l0 AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS label FROM ids)"
    for i in range(rounds):
        out += f""", m{i} AS (SELECT a.a AS node_id, label, count(*) AS n FROM a JOIN l{i} ON a.b = l{i}.node_id GROUP BY 1, 2),
b{i} AS (SELECT node_id, label FROM m{i} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, label) = 1),
l{i + 1} AS (SELECT l{i}.node_id AS node_id, coalesce(b{i}.label, l{i}.label) AS label FROM l{i} LEFT JOIN b{i} ON l{i}.node_id = b{i}.node_id)"""
    return out + f" SELECT node_id, label FROM l{rounds}"


@query(_cdlp_sql(3))
def graph_cdlp(spark, sf_dir):
    return graph.cdlp(None, place_edges(spark, sf_dir), 3, graph.BOTH)


def _pagerank_sql(rounds: int, start: str) -> str:
    out = f"""{G}, p AS ({start}), od AS (SELECT src, count(*) AS d FROM g GROUP BY 1),
r0 AS (SELECT node_id, share AS r FROM p)"""
    for i in range(rounds):
        out += f""", x{i} AS (SELECT coalesce(sum(r), 0) AS dang FROM r{i} WHERE node_id NOT IN (SELECT src FROM od)),
y{i} AS (SELECT g.dst AS node_id, sum(r / d) AS got FROM g JOIN od USING (src) JOIN r{i} ON r{i}.node_id = g.src GROUP BY 1),
r{i + 1} AS (SELECT p.node_id AS node_id, 0.15 * share + 0.85 * dang * share + 0.85 * coalesce(got, 0) AS r FROM p LEFT JOIN y{i} ON p.node_id = y{i}.node_id, x{i})"""
    return out + f" SELECT node_id, round(r, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(4, "SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS share FROM ids"))
def graph_pagerank(spark, sf_dir):
    rank, _ = graph.pagerank(None, place_edges(spark, sf_dir), max_iterations=4, tolerance=0.0)
    return rank.select("node_id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(3, "SELECT node_id, CASE node_id WHEN 's:1' THEN 0.75 WHEN 'n:2' THEN 0.25 ELSE 0 END::DOUBLE AS share FROM ids"))
def graph_ppr(spark, sf_dir):
    personal = spark.createDataFrame([("s:1", 3.0), ("n:2", 1.0), ("none", 5.0)], "node_id string, weight double")
    rank, _ = graph.pagerank(None, place_edges(spark, sf_dir), max_iterations=3, tolerance=0.0, personal=personal)
    return rank.select("node_id", F.round("rank", 9).alias("rank"))


@query(f"""{A}, u AS (SELECT DISTINCT a.a AS a, a.b AS b FROM a WHERE a.a <> a.b), d AS (SELECT u.a AS node_id, count(*) AS d FROM u GROUP BY 1),
t AS (SELECT x.a AS node_id, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT ids.node_id AS node_id, round(CASE WHEN d >= 2 THEN coalesce(t, 0) / (d * (d - 1) / 2.0) ELSE 0 END, 9) AS lcc FROM ids LEFT JOIN d ON ids.node_id = d.node_id LEFT JOIN t ON ids.node_id = t.node_id""")
def graph_lcc(spark, sf_dir):
    return graph.lcc(None, place_edges(spark, sf_dir)).select("node_id", F.round("lcc", 9).alias("lcc"))


@query(f"""WITH RECURSIVE {PLACE_SQL}, a AS (SELECT src AS a, dst AS b, weight FROM g UNION ALL SELECT dst, src, weight FROM g),
e AS (SELECT a, b, min(weight) AS w FROM a GROUP BY 1, 2),
r(node_id, distance, hops) AS (SELECT 'n:0', 0.0::DOUBLE, 0 UNION ALL (SELECT e.b, min(r.distance + e.w), r.hops + 1 FROM r JOIN e ON e.a = r.node_id WHERE r.hops < 8 GROUP BY e.b, r.hops))
SELECT node_id, min(distance) AS distance FROM r GROUP BY 1""")
def graph_sssp(spark, sf_dir):
    return graph.sssp(place_edges(spark, sf_dir), "n:0", graph.BOTH)


@query("""WITH s AS (SELECT 'c:' || o_custkey AS l, count(*) + 1 AS size FROM orders GROUP BY 1) SELECT size, count(*) AS groups FROM s GROUP BY 1""")
def graph_group_sizes(spark, sf_dir):
    sizes = graph.wcc(None, order_edges(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


@query("""WITH ids AS (SELECT 'o:' || o_orderkey AS node_id, o_custkey AS c FROM orders UNION SELECT 'c:' || o_custkey, o_custkey FROM orders),
r AS (SELECT node_id, c, row_number() OVER (ORDER BY node_id) - 1 AS rk FROM ids), l AS (SELECT node_id, min(rk) OVER (PARTITION BY c) AS component FROM r),
z AS (SELECT component, count(*) AS size FROM l GROUP BY 1 ORDER BY size DESC, component LIMIT 10)
SELECT component, size, (SELECT string_agg(node_id, ',' ORDER BY node_id) FROM (SELECT node_id FROM l WHERE l.component = z.component ORDER BY node_id LIMIT 5)) AS sample FROM z""")
def graph_group_summary(spark, sf_dir):
    groups = graph.group_summary(graph.wcc(None, order_edges(spark, sf_dir)), "component")
    return groups.select("component", "size", F.array_join("sample", ",").alias("sample"))


@query("""WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM orders)
SELECT max(n) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median, min(v) FILTER (rn >= ceil(n * 0.9)) AS p90, min(v) FILTER (rn >= ceil(n * 0.99)) AS p99 FROM s""")
def graph_score_distribution(spark, sf_dir):
    d = graph.score_distribution(table(spark, sf_dir, "orders"), "o_totalprice")
    return d.select("n", "min", "max", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "p90", "p99")


def _typed_nodes(edges):
    kind = F.substring("node_id", 1, 1)
    name = F.when(kind == "s", "Supplier").when(kind == "c", "Customer").when(kind == "n", "Nation")
    has = F.when((kind == "s") & (F.substring("node_id", -1, 1) != "7"), '{"code": 5}').when(kind == "s", '{"code": "x"}').otherwise("{}")
    return graph.node_ids(None, edges).select("node_id", name.alias("object_type"), has.alias("properties"))


def _ontology(spark):
    objects = spark.createDataFrame([("Supplier",), ("Customer",), ("Nation",), ("Port",)], "name string")
    links = spark.createDataFrame([("LOCATED_IN", "Supplier", "Nation"), ("LIVES_IN", "Customer", "Port"), ("SHIPS", "Port", "Nation")], "name string, source string, target string")
    return objects, links


@query(f"""{G} SELECT 'object' AS kind, t AS name, (SELECT count(*) FROM ids WHERE node_id[1] = c) AS n FROM (VALUES ('Supplier', 's'), ('Customer', 'c'), ('Nation', 'n'), ('Port', '-')) x(t, c)
UNION ALL SELECT 'link', t, (SELECT count(*) FROM g WHERE edge_type = t) FROM (VALUES ('LOCATED_IN'), ('LIVES_IN'), ('SHIPS')) y(t)""")
def graph_ontology_summary(spark, sf_dir):
    edges = place_edges(spark, sf_dir)
    return graph.ontology_summary(_typed_nodes(edges), edges, *_ontology(spark))


@query(f"""{G} SELECT node_id, 'wrong type of code' AS violation FROM ids WHERE node_id[1] = 's' AND node_id[-1] = '7'
UNION ALL SELECT node_id, 'missing head' FROM ids WHERE node_id[1] = 'n'""")
def graph_ontology_violations(spark, sf_dir):
    edges = place_edges(spark, sf_dir)
    objects, _ = _ontology(spark)
    required = spark.createDataFrame([("Supplier", "code", "number"), ("Nation", "head", "string")], "object_type string, property string, type string")
    return graph.node_violations(_typed_nodes(edges), objects, required)


@query(f"""{G} SELECT src, dst, edge_type, CASE edge_type WHEN 'LIVES_IN' THEN 'ends of another type' ELSE 'unknown link type' END AS violation FROM g WHERE edge_type <> 'LOCATED_IN'""")
def graph_edge_violations(spark, sf_dir):
    edges = place_edges(spark, sf_dir)
    return graph.edge_violations(edges, _typed_nodes(edges), _ontology(spark)[1])


@query(f"{G} SELECT node_id FROM ids WHERE NOT (node_id[1] = 's' AND node_id[-1] = '3')")
def graph_cascade_nodes(spark, sf_dir):
    """Suppliers are bound to entities of their own name; entities whose names end in 3 are deleted, and their nodes go."""
    return _cascaded(spark, sf_dir)[0].select("node_id")


@query(f"{G} SELECT src, dst, edge_type FROM g WHERE NOT (src[1] = 's' AND src[-1] = '3')")
def graph_cascade_edges(spark, sf_dir):
    return _cascaded(spark, sf_dir)[1].select("src", "dst", "edge_type")


def _cascaded(spark, sf_dir):
    edges = place_edges(spark, sf_dir)
    ref = F.when(F.col("node_id").startswith("s:"), F.concat(F.lit("entity/"), F.col("node_id")))
    nodes = graph.node_ids(None, edges).select("node_id", ref.alias("entity_ref"))
    deleted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("entity/s:"), F.col("s_suppkey").cast("string")).alias("entity_ref")).where(F.col("entity_ref").endswith("3"))
    gone, _ = graph.cascade(nodes, deleted, "cascade")
    return graph.without_nodes(nodes, edges, gone)


@query("""SELECT 'link type ' || n_name || ' needs object type ' || n_name AS error FROM nation WHERE n_nationkey % 2 = 1""")
def graph_freeze_errors(spark, sf_dir):
    """Regions and even nations are object types; every nation is a link type from its region to itself."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    links = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    objects = region.select(F.col("r_name").alias("name")).unionByName(nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")))
    return graph.freeze_errors(objects, links)
