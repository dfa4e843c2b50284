"""Branches: differences, three-way classification, merges, cherry-picks, reverts, merge bases.

Snapshots have space, type_tag, key, value, and ttl_ms and value_type, which go with the value. A key that is absent is another thing than
a key whose value is null: presence is a flag of its own. Classifying three snapshots is one aggregation
over their union, so one shuffle serves for what would be two full outer joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.session import ship, spread

KEY = ["space", "type_tag", "key"]
CELL = {"value": "string", "ttl_ms": "bigint", "value_type": "string"}


class MergeConflict(RuntimeError):
    """A strict merge met conflicting keys, or the two histories cannot be merged."""


def _mark(snapshot: DataFrame, side: str) -> DataFrame:
    parts = [F.col(c) if c in snapshot.columns else F.lit(None).cast(t).alias(c) for c, t in CELL.items()]
    return snapshot.select(*KEY, F.lit(side).alias("side"), F.struct(*parts).alias("cell"))


def _aligned(sides: dict[str, DataFrame]) -> DataFrame:
    """KEY and, for each side, the struct CELL, null where the side has no such key."""
    rows = None
    for name, snap in sides.items():
        marked = _mark(snap, name)
        rows = marked if rows is None else rows.unionByName(marked)
    return spread(rows, *KEY).groupBy(*KEY).agg(*(F.max(F.when(F.col("side") == s, F.col("cell"))).alias(s) for s in sides))


def sides(log: DataFrame, seen: dict[str, Column], alive: Column) -> DataFrame:
    """KEY and, for each side, the struct CELL of the newest version that it sees; null where that is dead, or there is none.

    The sides are taken from one reading and one shuffle of the log, in parts of bounded size, so there are no snapshots to align.
    """
    parts = [F.col(c) if c in log.columns else F.lit(None).cast(t).alias(c) for c, t in CELL.items()]
    at = [F.when(sees, F.col("version")).alias(f"_{name}") for name, sees in seen.items()]
    rows = spread(log.select(*KEY, F.when(alive, F.struct(*parts)).alias("_cell"), *at), *KEY)
    both = rows.groupBy(*KEY).agg(*(F.max_by("_cell", f"_{name}").alias(name) for name in seen))
    return both.where(reduce(lambda x, y: x | y, (F.col(name).isNotNull() for name in seen)))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(KEY, change, value_a, value_b): added (in b only), removed (in a only), modified."""
    both = _aligned({"a": a, "b": b})
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a.value").eqNullSafe(F.col("b.value")), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*KEY, "change", F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))


def touched(a: DataFrame, b: DataFrame, shared: dict[str, tuple[int, int]]) -> DataFrame:
    """KEY of every key of which one of two branches' views (fork_view) holds a version that the other does not see.

    shared: by the branch that wrote them, the first and the last version that both see. Other keys are alike on both.
    """
    both = reduce(lambda x, y: x | y, [(F.col("origin") == n) & F.col("version").between(*v) for n, v in shared.items()], F.lit(False))
    return a.where(~both).select(*KEY).unionByName(b.where(~both).select(*KEY)).distinct()


def among(cells: DataFrame, keys: DataFrame | None) -> DataFrame:
    """The rows of these keys; all, if there is no table of keys."""
    return cells if keys is None else cells.join(keys, KEY, "left_semi")


def lost_graphs(classified: DataFrame) -> DataFrame:
    """(space, graph): graphs that one side deleted while the other wrote to their nodes or edges."""
    graph = F.split("key", "/")[0].alias("graph")
    sides = [
        (["source_deleted", "delete_modify_conflict"], ["target_added", "target_changed", "delete_modify_conflict"]),
        (["target_deleted", "modify_delete_conflict"], ["source_added", "source_changed", "modify_delete_conflict"]),
    ]
    parts = []
    for gone, written in sides:
        graphs = classified.where((F.col("type_tag") == "graph") & F.col("outcome").isin(gone)).select("space", F.col("key").alias("graph"))
        work = classified.where(F.col("type_tag").isin("node", "edge") & F.col("outcome").isin(written)).select("space", graph)
        parts.append(graphs.join(work, ["space", "graph"], "left_semi"))
    return parts[0].unionByName(parts[1]).distinct()


def classify(ancestor: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """KEY, anc, src, tgt and outcome of every key that any of the three has. The 14 outcomes:

    all three: unchanged, source_changed, target_changed, both_changed_same, conflict
    none before: source_added, target_added, both_added_same, both_added_different
    one side gone: source_deleted, target_deleted, delete_modify_conflict, modify_delete_conflict; both: both_deleted
    """
    return outcomes(_aligned({"anc": ancestor, "src": source, "tgt": target}))


def classify_log(log: DataFrame, ancestor: Column, source: Column, target: Column, alive: Column) -> DataFrame:
    """As classify, of one log of which each of the three sees the rows of a condition."""
    return outcomes(sides(log, {"anc": ancestor, "src": source, "tgt": target}, alive))


def outcomes(t: DataFrame) -> DataFrame:
    """Adds the outcome to KEY, anc, src and tgt."""
    same = lambda x, y: F.col(f"{x}.value").eqNullSafe(F.col(f"{y}.value"))
    no = lambda x: F.col(x).isNull()
    outcome = (
        F.when(no("anc") & no("tgt"), "source_added")
        .when(no("anc") & no("src"), "target_added")
        .when(no("anc") & same("src", "tgt"), "both_added_same")
        .when(no("anc"), "both_added_different")
        .when(no("src") & no("tgt"), "both_deleted")
        .when(no("src") & same("anc", "tgt"), "source_deleted")
        .when(no("src"), "delete_modify_conflict")
        .when(no("tgt") & same("anc", "src"), "target_deleted")
        .when(no("tgt"), "modify_delete_conflict")
        .when(same("src", "tgt") & same("anc", "src"), "unchanged")
        .when(same("src", "tgt"), "both_changed_same")
        .when(same("anc", "tgt"), "source_changed")
        .when(same("anc", "src"), "target_changed")
        .otherwise("conflict")
    )
    return t.withColumn("outcome", outcome)


CONFLICTS = ["conflict", "both_added_different", "delete_modify_conflict", "modify_delete_conflict"]
#: Outcomes at which a merge puts the source's cell, and at which it deletes the key.
TAKES = ["source_added", "source_changed", *CONFLICTS[:2], "modify_delete_conflict"]
GIVES_UP = ["source_deleted", "delete_modify_conflict"]


def three_way_diff(ancestor: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    return changes(classify(ancestor, source, target))


def changes(classified: DataFrame) -> DataFrame:
    return classified.where("outcome <> 'unchanged'").select(
        *KEY, "outcome", F.col("anc.value").alias("ancestor_value"), F.col("src.value").alias("source_value"), F.col("tgt.value").alias("target_value")
    )


def conflicts(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome").isin(CONFLICTS)).select(*KEY, "outcome")


def merge_actions(classified: DataFrame) -> DataFrame:
    """(KEY, action: put or delete, CELL): what the target must do; where both changed the source wins.

    JSON documents that both sides changed are merged value by value, the source winning below that.
    """
    rows = classified.where(F.col("outcome").isin([*TAKES, *GIVES_UP]))
    action = F.when(F.col("outcome").isin(TAKES), "put").otherwise("delete")
    plain = rows.select(*KEY, "outcome", action.alias("action"), "src.*", F.col("anc.value").alias("anc"), F.col("tgt.value").alias("tgt"))
    both = _both_wrote_documents()
    simple = plain.where(~both).select(*KEY, "action", *CELL)
    return simple.unionByName(_merge_documents(plain.where(both)))


def _both_wrote_documents() -> Column:
    return (F.col("type_tag") == "json") & F.col("outcome").isin("conflict", "both_added_different")


def merged(classified: DataFrame) -> DataFrame:
    """The target's snapshot after the merge: KEY, value. As apply of merge_actions, without a join."""
    both, takes = _both_wrote_documents(), F.col("outcome").isin(TAKES)
    stays = F.col("tgt").isNotNull() & ~F.col("outcome").isin(GIVES_UP)
    plain = classified.where(~both & (takes | stays)).select(*KEY, F.when(takes, F.col("src.value")).otherwise(F.col("tgt.value")).alias("value"))
    return plain.unionByName(merge_actions(classified.where(both)).select(*KEY, "value"))


def _merge_documents(rows: DataFrame) -> DataFrame:
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        load = lambda x: jsonpath.ABSENT if x is None else json.loads(x)
        for b in batches:
            merged = [jsonpath.three_way(load(a), load(s), load(t))[0] for a, s, t in zip(*(b.column(c).to_pylist() for c in ("anc", "value", "tgt")))]
            cols = [b.column(c) for c in (*KEY, "action")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(["null" if m is jsonpath.ABSENT else jsonpath.canonical(m) for m in merged], pa.string())], names=[*KEY, "action", "value"])

    merged = rows.mapInArrow(run, "space string, type_tag string, key string, action string, value string")
    return merged.select("*", F.lit(None).cast("bigint").alias("ttl_ms"), F.lit("json").alias("value_type"))


def merge(ancestor: DataFrame, source: DataFrame, target: DataFrame, strict: bool = False) -> DataFrame:
    """merge_actions of the three; a strict merge raises MergeConflict if any key conflicts."""
    c = classify(ancestor, source, target)
    if strict and not (found := conflicts(c).limit(10).collect()):
        pass
    elif strict:
        raise MergeConflict(", ".join(f"{r['space']}/{r['key']}: {r['outcome']}" for r in found))
    return merge_actions(c)


def apply(target: DataFrame, actions: DataFrame) -> DataFrame:
    """The target's snapshot after the actions: KEY, value."""
    kept = target.select(*KEY, "value").join(actions.select(*KEY), KEY, "left_anti")
    return kept.unionByName(actions.where("action = 'put'").select(*KEY, "value"))


def cherry_pick(source: DataFrame, picks: DataFrame) -> DataFrame:
    """Put actions for the live source rows that `picks` (space, key) names; absent ones are passed over."""
    rows = source.join(picks.select("space", "key").distinct(), ["space", "key"], "left_semi")
    return rows.select(*KEY, F.lit("put").alias("action"), *(c for c in CELL if c in rows.columns))


def pick_actions(actions: DataFrame, spaces: list[str] | None = None, keys: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    for column, wanted in (("space", spaces), ("key", keys), ("type_tag", kinds)):
        if wanted is not None:
            actions = actions.where(F.col(column).isin(wanted))
    return actions


def revert(cells: DataFrame, first: int, last: int, alive: Column) -> DataFrame:
    """(KEY, action, CELL): takes back the versions first..last where the key is still as they left it."""
    t = sides(cells, {"before": F.col("version") < first, "after": F.col("version") <= last, "now": F.lit(True)}, alive)
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    rows = t.where(~same("before", "after") & same("after", "now"))
    action = F.when(F.col("before").isNull(), "delete").otherwise("put")
    return rows.select(*KEY, action.alias("action"), "before.*")


def merge_base(spark, lineage: DataFrame, merges: DataFrame, a: str, b: str, head_a: int, head_b: int, max_depth: int = 64) -> DataFrame:
    """(branch, version): the latest point that both branches have, one row or none.

    lineage: branch, parent, fork_version. merges: source, target, version, the source's version that was
    merged. A branch reaches itself at its head, its parents up to the fork, and what it merged. The chains
    are as deep as forks go, and are followed by joins.
    """
    links = lineage.select("branch", F.col("parent").alias("to"), F.col("fork_version").alias("at")).where("to IS NOT NULL")
    links = links.unionByName(merges.select(F.col("target").alias("branch"), F.col("source").alias("to"), F.col("version").alias("at")))

    def reach(name: str, head: int) -> DataFrame:
        seen = spark.createDataFrame([(name, head)], "branch string, version bigint")
        step = seen
        for _ in range(max_depth):
            step = step.join(links, "branch").select(F.col("to").alias("branch"), F.col("at").alias("version"))
            if step.isEmpty():
                break
            seen = seen.unionByName(step)
        return seen.groupBy("branch").agg(F.max("version").alias("version"))

    both = reach(a, head_a).alias("x").join(reach(b, head_b).alias("y"), "branch")
    shared = both.select("branch", F.least("x.version", "y.version").alias("version"))
    return shared.orderBy(F.desc("version"), "branch").limit(1)
