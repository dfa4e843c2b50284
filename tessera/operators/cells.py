"""The versioned cell log: snapshots, time travel, scans, branch views, pruning, transactions.

A cell log has columns branch, space, type_tag, key, version, ts_us, is_tombstone, ttl_ms, value (and
any others, which ride along). Rows are only ever appended. Of a key's rows the highest version that
a read admits decides; only then are tombstones and expired rows hidden, so a deleted key stays
deleted. A snapshot is one aggregation with map-side combination; keys without a visible row give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

ID = ["branch", "space", "type_tag", "key"]
SCHEMA = "branch string, space string, type_tag string, key string, version bigint, ts_us bigint, is_tombstone boolean, ttl_ms bigint, value_type string, value string"


def newest(rows: DataFrame, keys: list[str] = ID) -> DataFrame:
    """Each key's row of the highest version, tombstones included."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
    return top.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(rows.columns)


def alive(at_us: int | Column | None) -> Column:
    """Neither tombstone nor, at that time, expired: a row expires when its age reaches ttl_ms."""
    shown = ~F.coalesce(F.col("is_tombstone"), F.lit(False))
    if at_us is None:
        return shown
    at = at_us if isinstance(at_us, Column) else F.lit(at_us)
    return shown & (F.col("ttl_ms").isNull() | (at - F.col("ts_us") < F.col("ttl_ms") * 1000))


def snapshot(cells: DataFrame, version: int | None = None, now_us: int | None = None) -> DataFrame:
    """The visible rows at a version, or now."""
    rows = cells if version is None else cells.where(F.col("version") <= version)
    return newest(rows).where(alive(now_us))


def as_of(cells: DataFrame, ts_us: int) -> DataFrame:
    """The visible rows at a time: among rows not later than it, the highest version decides."""
    return newest(cells.where(F.col("ts_us") <= ts_us)).where(alive(ts_us))


def history(cells: DataFrame) -> DataFrame:
    """All versions of every key with age_rank, 1 for the newest."""
    return cells.withColumn("age_rank", F.row_number().over(Window.partitionBy(*ID).orderBy(F.desc("version"))))


def prefix_scan(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(F.col("key").startswith(prefix))


def page(rows: DataFrame, limit: int, prefix: str = "", after: str | None = None) -> DataFrame:
    """The next `limit` rows by key after the cursor; has_more tells of the row beyond them, which is read too."""
    rows = prefix_scan(rows, prefix)
    if after is not None:
        rows = rows.where(F.col("key") > after)
    some = rows.orderBy("key").limit(limit + 1)
    place = F.row_number().over(Window.orderBy("key"))
    numbered = some.withColumn("_n", place).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("_n") <= limit).drop("_n")


def page_after_member(rows: DataFrame, limit: int, after: str, prefix: str = "") -> DataFrame:
    """Document paging: a cursor that is no existing key gives an empty page."""
    known = prefix_scan(rows, prefix).where(F.col("key") == after).select(F.lit(1).alias("_k")).limit(1)
    return page(rows, limit, prefix, after).crossJoin(F.broadcast(known)).drop("_k")


def range_scan(rows: DataFrame, start: str | None, limit: int | None) -> DataFrame:
    rows = rows if start is None else rows.where(F.col("key") >= start)
    rows = rows.orderBy("key")
    return rows if limit is None else rows.limit(limit)


def count_prefix(rows: DataFrame, prefix: str = "") -> DataFrame:
    return prefix_scan(rows, prefix).agg(F.count("*").alias("n"))


def with_rank(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank in the total order of `order`, without gathering the rows in one task.

    The rows are range-partitioned and sorted once; a partition's ranks begin where those before end.
    """
    sorted_rows = rows.orderBy(*order).withColumn("_part", F.spark_partition_id())
    sorted_rows = cut(sorted_rows.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = sorted_rows.join(F.broadcast(starts), "_part")  # a row for each partition
    return ranked.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def sample_even(rows: DataFrame, count: int) -> DataFrame:
    """`count` rows spread evenly over the key order: those of rank floor(i * n / count); all, if no more."""
    ranked = with_rank(rows, "key", name="_rank")
    total = ranked.agg(F.count("*").alias("_total"))
    picks = rows.sparkSession.range(count).crossJoin(F.broadcast(total)).select(
        F.floor(F.col("id") * F.col("_total") / count).cast("bigint").alias("_rank")
    ).distinct()
    return ranked.join(F.broadcast(picks), "_rank").drop("_rank")


def batch_get(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (position, key), each with its visible row's columns, or null; found tells which."""
    hit = rows.withColumn("found", F.lit(True))
    return wanted.join(hit, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def time_range(cells: DataFrame) -> DataFrame:
    """The times of the first and the last write, tombstones included."""
    return cells.agg(F.min("ts_us").alias("oldest_us"), F.max("ts_us").alias("latest_us"))


def spaces(cells: DataFrame) -> DataFrame:
    """The spaces in use; the default one always is."""
    default = cells.sparkSession.range(1).select(F.lit("default").alias("space"))
    return cells.select("space").unionByName(default).distinct()


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Several runs of the log as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def fork_view(cells: DataFrame, lineage: list[tuple[str, int]], branch: str) -> DataFrame:
    """The log as a branch sees it: its own rows, and its ancestors' up to the version it was forked at.

    lineage: (ancestor, fork version), nearest first. Every bound is also bounded by the nearer ones.
    Own rows come later than inherited ones, so the newest-version rule lets them shadow those.
    """
    return cells.where(seen_by(lineage, branch)).withColumn("origin", F.col("branch")).withColumn("branch", F.lit(branch))


def seen_by(lineage: list[tuple[str, int]], branch: str) -> Column:
    """Whether a branch sees a row of the log; lineage as for fork_view."""
    seen, bound = [F.col("branch") == branch], None
    for parent, at in lineage:
        bound = at if bound is None else min(bound, at)
        seen.append((F.col("branch") == parent) & (F.col("version") <= bound))
    return reduce(lambda a, b: a | b, seen)


def own_entries(cells: DataFrame, branch: str, after: int) -> DataFrame:
    return cells.where((F.col("branch") == branch) & (F.col("version") > after))


def retention(cells: DataFrame, seen: DataFrame) -> DataFrame:
    """(branch, own_rows, own_bytes, shared_rows, shared_bytes, inherited_rows, inherited_bytes) of every branch.

    seen (branch, parent, bound): the branch sees the parent's versions up to the bound. Own versions are shared
    if a branch sees them, and stay as long as it does. The log is aggregated by commit before anything is joined.
    """
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    commits = cells.groupBy("branch", "version").agg(F.count("*").alias("n"), F.sum(size.cast("bigint")).alias("z"))
    most = F.max("bound").alias("most")
    own = commits.join(seen.groupBy(F.col("parent").alias("branch")).agg(most), "branch", "left")
    shared = F.col("version") <= F.col("most")
    own = own.groupBy("branch").agg(
        F.sum("n").alias("own_rows"), F.sum("z").alias("own_bytes"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("shared_rows"), F.coalesce(F.sum(F.when(shared, F.col("z"))), F.lit(0)).alias("shared_bytes"),
    )
    bounds = seen.select(F.col("parent").alias("branch"), F.col("bound").alias("version")).distinct()
    marked = commits.withColumn("bound", F.lit(False)).unionByName(bounds.select("*", F.lit(0).alias("n"), F.lit(0).alias("z"), F.lit(True).alias("bound")))
    upto = Window.partitionBy("branch").orderBy("version").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = marked.select(F.col("branch").alias("parent"), "version", "bound", F.sum("n").over(upto).alias("n"), F.sum("z").over(upto).alias("z"))
    sums = sums.where("bound").select("parent", F.col("version").alias("bound"), "n", "z")
    inherited = seen.join(sums, ["parent", "bound"]).groupBy("branch").agg(F.sum("n").alias("inherited_rows"), F.sum("z").alias("inherited_bytes"))
    return own.join(inherited, "branch", "full_outer").na.fill(0)


def prune(
    cells: DataFrame, floor: int, max_versions: int | None, now_us: int, bounds: list[tuple[str, int]] = (), inheriting: list[str] = (),
) -> DataFrame:
    """What compaction keeps. Events are never pruned.

    Versions over `floor` stay, and of the others the newest of each key, unless it is a tombstone or
    expired with nothing older kept; of all that, the `max_versions` newest. bounds: (branch, version)
    that forks and merges see: a key's newest row at each stays, whatever it is. inheriting: branches
    with a parent, whose newest rows stay though dead, since they hide what is inherited.
    """
    own = Window.partitionBy(*ID).orderBy(F.desc("version"))
    ranked = history(cells).withColumn("_after", F.lag("version").over(own))
    open_at = lambda b: (F.col("version") <= b) & (F.col("_after").isNull() | (F.col("_after") > b))
    held = F.lit(False)
    if bounds:
        seen = cells.sparkSession.createDataFrame(sorted(set(bounds)), "branch string, _at bigint").groupBy("branch").agg(F.collect_list("_at").alias("_bounds"))
        ranked = ranked.join(F.broadcast(seen) if len(bounds) <= 100_000 else seen, "branch", "left")  # a row a branch
        held = F.coalesce(F.exists("_bounds", open_at), F.lit(False))
    ranked = ranked.withColumn("_held", held)
    below = F.max("_held").over(own.rowsBetween(1, Window.unboundedFollowing))
    hides = F.coalesce(below, F.lit(False)) | F.col("branch").isin(list(inheriting))
    ranked = ranked.withColumn("_hides", hides)
    keep = (F.col("version") > floor) | (open_at(F.lit(floor)) & (alive(now_us) | F.col("_hides")))
    if max_versions is not None:
        keep = keep & (F.col("age_rank") <= max_versions)
    return ranked.where((F.col("type_tag") == "event") | F.col("_held") | keep).select(cells.columns)


def overlay(visible: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """A transaction's own view: its writes, and of the snapshot what it has neither written nor deleted."""
    touched = writes.select(*ID).unionByName(deletes.select(*ID)).distinct()
    return visible.join(touched, ID, "left_anti").unionByName(writes, allowMissingColumns=True)


def read_conflicts(read_set: DataFrame, cells: DataFrame) -> DataFrame:
    """The keys of read_set (ID, seen_version; 0: there was none) that have another version now.

    First committer wins: one such row aborts the transaction. Keys only written never conflict.
    """
    now = newest(cells).select(*ID, F.col("version").alias("now_version"))
    both = read_set.join(now, ID, "left")
    return both.where(F.col("seen_version") != F.coalesce("now_version", F.lit(0)))


def cas_conflicts(expected: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of expected (ID, expected_version; 0: must not exist) that do not hold; deleted keys do not exist."""
    now = snapshot(cells).select(*ID, F.col("version").alias("now_version"))
    return expected.join(now, ID, "left").where(F.col("expected_version") != F.coalesce("now_version", F.lit(0)))


def describe(cells: DataFrame) -> DataFrame:
    """Live keys and all versions, by branch, space and type."""
    by = ["branch", "space", "type_tag"]
    live = snapshot(cells).groupBy(*by).agg(F.count("*").alias("live"))
    return cells.groupBy(*by).agg(F.count("*").alias("versions")).join(live, by, "left").withColumn("live", F.coalesce("live", F.lit(0)))
