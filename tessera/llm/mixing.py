"""Mixing sources to target weights by systematic sampling.

A source's rate is its target divided by its size; each document of it is expected `rate` times
in the mix. The documents of a source stand in order of size, their expected copies are summed
up, a random offset is added, and a document is emitted once for each integer that the sum passes
at it: floor(rate) or ceil(rate) times. Ordering by size lets every size class contribute its
share, so that a source's words come near its target.

The prefix sum is taken in two steps, so that no task holds a source: counts of (source, size
class, slice of documents) are summed up in a small table, and the places within a cell are
numbered by a window over the cell. The slices grow in number with the documents.

Null sources are a source of their own, the last in order. Null sizes count as 0. A source of
size 0 has rate 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

KEY = ["__null", "__source"]
CELL = [*KEY, "__class", "__slice"]


def _random(*parts: Column) -> Column:
    """An integer below 2**32 that depends on the parts' text alone; nulls are empty."""
    text = F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds target to sizes(__null, __source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. They divide `share` times all
    sizes by weight; none gets more than `cap` times its size, and what is over goes to the others
    by weight: the target is min(cap * size, level * weight), for the level that gives the sum.
    The windows hold a row a source.
    """
    by_name = Window.orderBy(*KEY)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("__w", w).withColumn("__cap", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), *KEY)
    before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    s = s.withColumn("__total", total).withColumn("__level", (F.col("__total") - before) / ahead)
    level = F.max("__level").over(everything)
    return s.select(*KEY, "source_size", F.least("__cap", level * F.col("__w")).alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """All columns of `docs` with size, source_size, target and copies, the times the mix has the row.

    Of these names, columns of `docs` are replaced. Equal calls give equal copies.
    """
    add = ["size", "source_size", "target", "copies"]
    slices = min(4096, max(64, docs.count() // 2000))
    kept = [c for c in docs.columns if c not in add]
    dealt = (
        docs.withColumn("__size", F.coalesce(size, F.lit(0)).cast("bigint"))
        .withColumn("__null", F.col("source").isNull())
        .withColumn("__source", F.coalesce("source", F.lit("")))
        .withColumn("__class", F.length(F.bin("__size")))
        .withColumn("__slice", _random(F.lit(f"{seed}:"), F.col("doc_id")) % slices)
    )
    cells = cut(dealt.groupBy(*CELL).agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum")))
    sizes = cells.groupBy(*KEY).agg(F.sum("__sum").alias("source_size"))
    places = Window.partitionBy(*KEY).orderBy("__class", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    # A multiple of 2**-20, so that sums of whole copies stay exact.
    offset = (_random(F.lit(f"{seed}:"), F.col("__null"), F.lit(":"), F.col("__source")) % (1 << 20)) / F.lit(float(1 << 20))
    starts = (
        cells.withColumn("__start", F.coalesce(F.sum("__n").over(places), F.lit(0)))
        .join(targets(sizes, weights, share, cap), KEY)
        .withColumn("__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("__offset", offset)
        .drop("__n", "__sum")
    )
    others = [c for c in kept if c not in ("doc_id", "source")]
    order = Window.partitionBy(*CELL).orderBy("__size", "doc_id", F.xxhash64(*(others or ["doc_id"])))
    end = F.col("__start") + F.row_number().over(order)
    at = dealt.select(*kept, "__size", *CELL).join(starts, CELL).withColumn("__end", end)
    passed = [F.floor(F.col("__rate") * p + F.col("__offset")) for p in (F.col("__end"), F.col("__end") - 1)]
    copies = F.least(passed[0] - passed[1], F.ceil("__rate")).cast("int")
    return at.select(*kept, F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: `columns` of every row, as often as its copies say."""
    return mixed.where("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)
