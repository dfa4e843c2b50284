"""Property graphs: neighbours, traversal, components, communities, ranks, clustering, paths, ontologies.

Nodes have node_id (and object_type, properties, entity_ref); edges have src, dst, edge_type, weight.
The node set of an analysis is the declared nodes and the edges' ends. Of edges with equal (src, dst,
edge_type) the last written counts; several types between two nodes count each. Iterations are
checkpointed, a round at a time, and a round's state is a row a node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cells import with_rank
from tessera.operators.components import connected_components
from tessera.session import cut

OUT, IN, BOTH = "outgoing", "incoming", "both"


def node_ids(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    return (ends if nodes is None else ends.unionByName(nodes.select("node_id"))).distinct()


def last_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, edge_type): that of the highest version."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "edge_type")]
    top = edges.groupBy("src", "dst", "edge_type").agg(F.max_by(F.struct(*rest), "version").alias("_e"))
    return top.select("src", "dst", "edge_type", *(F.col("_e")[c].alias(c) for c in rest))


def arcs(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, edge_type, weight): from a node to its neighbour. In both directions a loop is there twice."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    kind = F.col("edge_type") if "edge_type" in edges.columns else F.lit(None).cast("string")
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), kind.alias("edge_type"), w.alias("weight"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), kind.alias("edge_type"), w.alias("weight"))
    return {OUT: out, IN: back, BOTH: out.unionByName(back)}[direction]


def neighbors(edges: DataFrame, node_id: str, direction: str = OUT, edge_type: str | None = None) -> DataFrame:
    rows = arcs(edges, direction).where(F.col("a") == node_id)
    rows = rows if edge_type is None else rows.where(F.col("edge_type") == edge_type)
    return rows.select(F.col("b").alias("node_id"), "edge_type", "weight")


def degree(nodes: DataFrame | None, edges: DataFrame, direction: str = BOTH) -> DataFrame:
    counts = arcs(edges, direction).groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("degree"))
    return node_ids(nodes, edges).join(counts, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def bfs(edges: DataFrame, start: str, max_depth: int = 100, max_nodes: int | None = None, edge_types: list[str] | None = None, direction: str = OUT) -> DataFrame:
    """(node_id, depth, parent) in order of (depth, node_id), the start first, even if it has no edges.

    parent: the smallest node of the depth before that leads here. A level is two equi-joins.
    """
    step = arcs(edges, direction)
    step = step if edge_types is None else step.where(F.col("edge_type").isin(edge_types))
    step = step.select("a", "b").distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0, None)], "node_id string, depth int, parent string")
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = step.join(frontier.select(F.col("node_id").alias("a")), "a").groupBy(F.col("b").alias("node_id")).agg(F.min("a").alias("parent"))
        frontier = cut(reached.join(seen, "node_id", "left_anti").select("node_id", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
        if max_nodes is not None and seen.count() >= max_nodes:
            break
    return seen if max_nodes is None else seen.orderBy("depth", "node_id").limit(max_nodes)


def subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges with both ends among `members` (node_id)."""
    ids = members.select("node_id").distinct()
    inner = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return inner.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(edges.columns)


def wcc(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node_id, component): the 0-based rank, among all node ids in byte order, of the component's smallest."""
    every = node_ids(nodes, edges)
    label = connected_components(edges.select("src", "dst")).withColumnRenamed("node", "node_id")
    both = every.join(label, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("root"))
    ranks = with_rank(every, "node_id", name="component").withColumnRenamed("node_id", "root")
    return both.join(ranks, "root").select("node_id", "component")


def cdlp(nodes: DataFrame | None, edges: DataFrame, max_iterations: int, direction: str = OUT) -> DataFrame:
    """(node_id, label) by synchronous label propagation: the commonest label of the neighbours, ties to the smaller."""
    state = with_rank(node_ids(nodes, edges), "node_id", name="label")
    step = arcs(edges, direction).select(F.col("a").alias("node_id"), F.col("b"))
    for _ in range(max_iterations):
        votes = step.join(state.select(F.col("node_id").alias("b"), "label"), "b").groupBy("node_id", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
        changed = cut(state.join(best, "node_id", "left").select("node_id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        state = changed.drop("moved")
        if changed.where("moved").isEmpty():
            break
    return state


def pagerank(nodes: DataFrame | None, edges: DataFrame, damping: float = 0.85, max_iterations: int = 20, tolerance: float = 1e-6, personal: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((node_id, rank), iterations). Nodes without edges out give their rank to all; with personal (node_id, weight),
    to those it names, as the restarts go. Stops after the round whose change sums to less than `tolerance`."""
    ids = node_ids(nodes, edges)
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out"))
    n = ids.count()
    if n == 0:
        return ids.select("node_id", F.lit(0.0).alias("rank")), 0
    if personal is None:
        base = ids.withColumn("share", F.lit(1.0 / n))
    else:
        bad = personal.where("weight IS NULL OR isnan(weight) OR weight < 0").count()
        held = personal.groupBy("node_id").agg(F.sum("weight").alias("weight")).join(ids, "node_id", "left_semi")
        total = held.agg(F.sum("weight")).first()[0]
        if bad or not total:
            raise ValueError("the restart weights must be at least 0, and one of an existing node more")
        base = ids.join(held, "node_id", "left").select("node_id", (F.coalesce("weight", F.lit(0.0)) / total).alias("share"))
    links = cut(edges.select("src", "dst"))
    state = cut(base.join(out, "node_id", "left").select("node_id", "share", F.coalesce("out", F.lit(0)).alias("out"), F.col("share").alias("rank")))
    for i in range(1, max_iterations + 1):
        dangling = state.where("out = 0").agg(F.sum("rank")).first()[0] or 0.0
        sent = links.join(state.where("out > 0").select(F.col("node_id").alias("src"), (F.col("rank") / F.col("out")).alias("r")), "src")
        sent = sent.groupBy(F.col("dst").alias("node_id")).agg(F.sum("r").alias("got"))
        new = (1 - damping) * F.col("share") + damping * dangling * F.col("share") + damping * F.coalesce("got", F.lit(0.0))
        moved = cut(state.join(sent, "node_id", "left").select("node_id", "share", "out", new.alias("new"), F.abs(new - F.col("rank")).alias("delta")))
        delta = moved.agg(F.sum("delta")).first()[0]
        state = moved.select("node_id", "share", "out", F.col("new").alias("rank"))
        if delta < tolerance:
            break
    return state.select("node_id", "rank"), i


def lcc(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node_id, lcc): the share of a node's pairs of neighbours that are linked, either way; 0 below two neighbours.

    Every link is pointed from the end of smaller degree to the other; so a triangle is found once, at the
    end of least degree, and a node of very many links spans few pairs.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    pairs = cut(pairs)
    ends = pairs.select(F.col("u").alias("node_id")).unionByName(pairs.select(F.col("v").alias("node_id")))
    deg = cut(ends.groupBy("node_id").agg(F.count("*").alias("d")))
    both = pairs.join(deg.select(F.col("node_id").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("node_id").alias("v"), F.col("d").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    arc = cut(both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b")))
    two = arc.join(arc.select("a", F.col("b").alias("c")), "a").where("b < c").select("a", F.col("b").alias("u"), F.col("c").alias("v"))
    tri = two.join(pairs, ["u", "v"]).select(F.explode(F.array("a", "u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("t"))
    rows = node_ids(nodes, edges).join(deg, "node_id", "left").join(tri, "node_id", "left")
    value = F.when(F.col("d") >= 2, F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1) / 2)).otherwise(0.0)
    return rows.select("node_id", value.alias("lcc"))


def sssp(edges: DataFrame, source: str, direction: str = OUT, max_rounds: int = 1000) -> DataFrame:
    """(node_id, distance) of the nodes that are reached; weights must not be negative. A round relaxes the nodes that moved."""
    step = arcs(edges, direction).groupBy("a", "b").agg(F.min("weight").alias("w"))
    if not step.where("w < 0").isEmpty():
        raise ValueError("a weight is negative")
    step = cut(step)
    best = edges.sparkSession.createDataFrame([(source, 0.0)], "node_id string, distance double")
    moved = best
    for _ in range(max_rounds):
        offers = step.join(moved.withColumnRenamed("node_id", "a"), "a").groupBy(F.col("b").alias("node_id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        merged = cut(best.join(offers, "node_id", "full_outer"))
        better = F.col("offer") < F.coalesce("distance", F.lit(float("inf")))
        moved = merged.where(better).select("node_id", F.col("offer").alias("distance"))
        best = merged.select("node_id", F.least("distance", "offer").alias("distance"))
        if moved.isEmpty():
            break
    return best


def group_summary(labels: DataFrame, label: str, top_n: int = 10) -> DataFrame:
    """(label, size, sample): the largest groups, ties to the smaller label, each with its five smallest node ids."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("size")).orderBy(F.desc("size"), label).limit(top_n)
    mine = labels.join(F.broadcast(sizes), label)
    nth = F.row_number().over(Window.partitionBy(label).orderBy("node_id"))
    few = mine.withColumn("_n", nth).where(F.col("_n") <= 5)
    return few.groupBy(label, "size").agg(F.sort_array(F.collect_list("node_id")).alias("sample"))


def score_distribution(scores: DataFrame, column: str) -> DataFrame:
    """n, min, max, mean, median, p90 and p99 of a column; percentiles are values of it, by nearest rank."""
    counts = scores.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    # Range-partitioned by value: sums run within a partition, from where those before it end.
    counts = cut(counts.orderBy("v").withColumn("part", F.spark_partition_id()))
    sums = counts.groupBy("part").agg(F.sum("c").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("before"), F.sum("all").over(Window.partitionBy()).alias("n"))  # a row a partition
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    c = counts.join(F.broadcast(starts), "part").withColumn("upto", upto)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= place, F.col("v")))

    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    return c.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        ((at(low) + at(high)) / 2).alias("median"), at(F.ceil(F.col("n") * 0.9)).alias("p90"), at(F.ceil(F.col("n") * 0.99)).alias("p99"),
    )


# Ontologies: object types and link types; a draft may change, a frozen one is enforced.


def freeze_errors(object_types: DataFrame, link_types: DataFrame) -> DataFrame:
    """(error): why the ontology cannot be frozen; no rows if it can."""
    ends = link_types.select("name", F.explode(F.array("source", "target")).alias("needs"))
    missing = ends.join(object_types.select(F.col("name").alias("needs")), "needs", "left_anti")
    errors = missing.select(F.concat(F.lit("link type "), "name", F.lit(" needs object type "), "needs").alias("error")).distinct()
    empty = object_types.select("name").unionByName(link_types.select("name")).agg(F.count("*").alias("n")).where("n = 0")
    return errors.unionByName(empty.select(F.lit("the ontology has no types").alias("error")))


def node_violations(nodes: DataFrame, object_types: DataFrame, required: DataFrame) -> DataFrame:
    """(node_id, violation). Nodes without a type may be anything. required: object_type, property, type
    (string, number, boolean; null: any)."""
    typed = nodes.where("object_type IS NOT NULL")
    unknown = typed.join(object_types.select(F.col("name").alias("object_type")), "object_type", "left_anti")
    out = unknown.select("node_id", F.concat(F.lit("unknown type "), "object_type").alias("violation"))
    have = typed.join(required.withColumnRenamed("type", "needed"), "object_type")
    got = F.try_variant_get(F.try_parse_json("properties"), "$", "map<string,variant>")[F.col("property")]
    kind = F.schema_of_variant(got)
    fits = (
        F.when(F.col("needed") == "string", kind == "STRING").when(F.col("needed") == "number", kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"))
        .when(F.col("needed") == "boolean", kind == "BOOLEAN").otherwise(True)
    )
    why = F.when(got.isNull(), F.concat(F.lit("missing "), "property")).when(~fits, F.concat(F.lit("wrong type of "), "property"))
    return out.unionByName(have.select("node_id", why.alias("violation")).where("violation IS NOT NULL"))


def edge_violations(edges: DataFrame, nodes: DataFrame, link_types: DataFrame) -> DataFrame:
    """(src, dst, edge_type, violation): unknown link types, ends of another type, ends that are no nodes."""
    types = nodes.select(F.col("node_id"), F.col("object_type"), F.lit(True).alias("there"))
    named = lambda end: types.select(F.col("node_id").alias(end), F.col("object_type").alias(f"{end}_type"), F.col("there").alias(f"{end}_there"))
    rows = edges.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
    rows = rows.join(link_types.select(F.col("name").alias("edge_type"), "source", "target"), "edge_type", "left")
    why = (
        F.when(F.col("src_there").isNull() | F.col("dst_there").isNull(), "dangling")
        .when(F.col("source").isNull(), "unknown link type")
        .when((F.col("src_type") != F.col("source")) | (F.col("dst_type") != F.col("target")), "ends of another type")
    )
    return rows.withColumn("violation", why).where("violation IS NOT NULL").select("src", "dst", "edge_type", "violation")


def ontology_summary(nodes: DataFrame, edges: DataFrame, object_types: DataFrame, link_types: DataFrame) -> DataFrame:
    """(kind, name, n): members of every declared type."""
    n = nodes.groupBy(F.col("object_type").alias("name")).agg(F.count("*").alias("n"))
    e = edges.groupBy(F.col("edge_type").alias("name")).agg(F.count("*").alias("n"))
    parts = [
        types.select("name").join(counts, "name", "left").select(F.lit(kind).alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
        for kind, types, counts in (("object", object_types, n), ("link", link_types, e))
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cascade(nodes: DataFrame, deleted_refs: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(node ids to remove, node ids to detach) when entities are deleted; policy: cascade, detach or ignore."""
    bound = nodes.join(deleted_refs.select("entity_ref").distinct(), "entity_ref", "left_semi").select("node_id")
    none = bound.where(F.lit(False))
    return {"cascade": (bound, none), "detach": (none, bound), "ignore": (none, none)}[policy]


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of `gone` (node_id) and the edges at them."""
    g = gone.select("node_id").distinct()
    kept = edges.join(g.withColumnRenamed("node_id", "src"), "src", "left_anti").join(g.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(g, "node_id", "left_anti"), kept.select(edges.columns)
