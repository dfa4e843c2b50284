"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Every component x becomes floor(256 * x). A vector takes part if it and its components are not null
and all are finite, 256-fold too. Only vectors of equal length are compared, length by length; empty
ones have scores of 0. Scores are exact: where sums could pass 2**53, products in double precision only
choose the vectors that can be among the best, by a bound on their error, and whole numbers decide.
A score beyond the range of bigint is given as the end of that range; such scores rank as doubles.

Equal vectors are merged, keeping the k + 1 smallest ids, which is all that a query can return of
them. Pivots, a bounded sample of vectors, divide the data into Voronoi cells. A cell's summary is
its radius, its size and the k + 1 smallest distances to its pivot. For a query q, data s of cell j
and d = |s - p_j|, q.s lies within q.p_j -+ |q| d; so the summaries give a score that k + 1 vectors
reach, and with it the least d from which a cell's vectors can matter to q. Queries are grouped by
pivots too; a query group takes from each cell the vectors at or beyond its queries' least d, and no
others. Groups are split into units of bounded size, each solved by one matrix product after another,
and the partial results are merged by score and id.

Rows without vec_id take no part. An empty table gives no rows. Repeated vec_ids are repeated results.
Only vec_id and embedding are read, so that other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, small_batches

#: Most vectors and queries of a unit.
UNIT_ROWS, UNIT_QUERIES = 50_000, 256
#: Room for rounding: of sums of products, against the product of the lengths; of distances, against the lengths.
SLACK = 1e-9
#: Components beyond which vectors go as doubles; the squares of larger lengths would pass the range of doubles.
INT, SCALE_FROM = float(1 << 31), 2.0**400


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v array<double>) of the rows that take part: whole numbers; an empty vector is one zero."""
    slim = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    slim = slim.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda e: _floor(e.cast("double") * 256)).alias("v"))
    slim = slim.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return slim.select("vec_id", F.size("v").alias("dim"), F.when(F.size("v") == 0, F.array(F.lit(0.0))).otherwise(F.col("v")).alias("v"))


def _floor(x: Column) -> Column:
    """The floor as a double; doubles of 2**53 and more are whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _place(pivots: np.ndarray, kind: str, shrink: float) -> callable:
    """Adds (cell, d): the nearest pivot's number and the distance; v becomes bytes. Lengths are times `shrink`."""
    small = pivots * shrink
    norms = (small**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
            f = x * shrink
            cell = ((f**2).sum(axis=1)[:, None] - 2 * f @ small.T + norms).argmin(axis=1)
            d = np.sqrt(((f - small[cell]) ** 2).sum(axis=1))
            raw = x.astype(kind)
            names = [n for n in b.schema.names if n != "v"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d)],
                names=[*names, "v", "cell", "d"],
            )

    return run


def _bounds(pivots: np.ndarray, kind: str, shrink: float, nearest: list[np.ndarray], k: int) -> callable:
    """(grp, cell, least) for every query and cell: the least distance at which a vector can matter."""
    known = np.concatenate([np.full(len(n), j) for j, n in enumerate(nearest)]).astype(int)
    ds, small = np.concatenate(nearest), pivots * shrink
    far = np.sqrt((small**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("v"), pivots.shape[1], kind) * shrink
            if not len(q):
                continue
            norm = np.sqrt((q**2).sum(axis=1))
            to = q @ small.T
            low = to[:, known] - norm[:, None] * (ds + SLACK * (ds + far[known]))
            reach = -np.sort(-low, axis=1)[:, k] if low.shape[1] > k else np.full(len(q), -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = (reach[:, None] - to) / norm[:, None]
                least -= SLACK * (np.abs(least) + far + np.abs(reach / norm)[:, None])
            least[(norm == 0) | ~np.isfinite(reach)] = -np.inf
            n, cells = least.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column("grp").to_numpy(zero_copy_only=False), cells)), pa.array(np.tile(np.arange(cells, dtype=np.int32), n)), pa.array(least.ravel())],
                names=["grp", "cell", "least"],
            )

    return run


def _solve(dim: int, kind: str, shrink: float, k: int) -> callable:
    """The k + 1 best (q, size, score, vec_id) of a unit's vectors for each of its queries; size is the score as a double."""
    ends = -(1 << 63), (1 << 63) - 1

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = {"q": [], "size": [], "score": [], "vec_id": []}
        if queries.num_rows and data.num_rows:
            qv = _matrix(queries.column("v").combine_chunks(), dim, kind)
            dv = _matrix(data.column("v").combine_chunks(), dim, kind)
            ids = data.column("ids").combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            first, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            names = queries.column("q").to_numpy()
            exact = dim * float(np.abs(qv).max()) * float(np.abs(dv).max()) < 2.0**53
            near, far = (qv, dv) if exact else (qv * shrink, dv * shrink)
            room = np.zeros(len(dv)) if exact else SLACK * np.sqrt((far**2).sum(axis=1))
            for lo in range(0, len(qv), 32):
                for i, s in enumerate(near[lo : lo + 32] @ far.T, lo):
                    slack = room * np.sqrt((near[i] ** 2).sum())
                    sure = s - slack
                    edge = np.partition(sure, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -np.inf
                    hits = np.flatnonzero(s + slack >= edge)
                    if exact:
                        size, score = s[hits], s[hits].astype(np.int64)
                    else:
                        own = [int(x) for x in qv[i]]
                        whole = [sum(a * int(x) for a, x in zip(own, dv[h])) for h in hits]
                        size = np.array([math.copysign(math.inf, w) if abs(w) >> 1000 else float(w) for w in whole])
                        score = np.array([min(max(w, ends[0]), ends[1]) for w in whole], np.int64)
                    counts = first[hits + 1] - first[hits]
                    at = np.repeat(first[hits] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                    got, size, score = values[at], np.repeat(size, counts), np.repeat(score, counts)
                    best = np.lexsort((got, -np.maximum(score, ends[0] + 1), -size))[: k + 1]
                    out["q"] += [int(names[i])] * len(best)
                    out["size"] += size[best].tolist()
                    out["score"] += score[best].tolist()
                    out["vec_id"] += got[best].tolist()
        return pa.table({n: pa.array(v, pa.float64() if n == "size" else pa.int64()) for n, v in out.items()})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `is_query`, the k best other rows; ties to smaller ids.

    pivots: the most cells of the data; the pivots are a sample by hash of the distinct vectors.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    every = integer_vectors(vectors)
    greatest = F.max(F.array_max(F.transform("v", lambda e: F.abs(e)))).alias("top")
    found = None
    for r in every.groupBy("dim").agg(greatest).orderBy("dim").collect():  # a row for each length that occurs
        part = _of_length(every.where(F.col("dim") == r["dim"]).drop("dim"), max(1, r["dim"]), r["top"], is_query, k, pivots)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint") if found is None else found


def _of_length(every: DataFrame, dim: int, top: float, is_query: Column, k: int, pivots: int) -> DataFrame:
    """exact_top_k of vectors with `dim` components of a size of at most `top`."""
    kind = "<i4" if top < INT else "<f8"
    shrink = 1.0 if top < SCALE_FROM else 2.0 ** -int(math.log2(top))
    if kind == "<i4":
        every = every.withColumn("v", F.col("v").cast("array<int>"))
    every = every.withColumn("h", F.xxhash64("v"))
    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    merged = every.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    merged = cut(merged)
    chosen = merged.orderBy(F.xxhash64("h"), "h", "v").limit(pivots).select("v").collect()
    centres = np.array([r["v"] for r in chosen], np.float64)
    data = cut(merged.mapInArrow(_place(centres, kind, shrink), "h bigint, ids array<bigint>, v binary, cell int, d double"))
    near = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    few = data.select("cell", "d").withColumn("nth", near).where(F.col("nth") <= k + 1).collect()
    nearest = [np.sort([r["d"] for r in few if r["cell"] == j]) for j in range(len(centres))]

    asked = every.where(is_query).select(F.col("vec_id").alias("query_id"), "h", "v")
    distinct = asked.groupBy("h", "v").agg(F.min("query_id").alias("q"))
    placed = cut(distinct.mapInArrow(_place(centres, kind, shrink), "h bigint, q bigint, v binary, cell int, d double"))
    n_queries, n_data = placed.count(), data.count()
    # Query groups: runs of neighbouring pivots, or parts of one pivot's queries.
    groups = max(1, -(-n_queries // UNIT_QUERIES))
    order = np.argsort(((centres[:, None] - centres[None]) ** 2).sum(axis=2)[0], kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    rank = F.element_at(F.array(*(F.lit(int(p)) for p in place)), F.col("cell") + 1)
    parts = max(1, -(-groups // len(centres)))
    grp = F.floor(rank * min(groups, len(centres)) / len(centres)) * parts + F.pmod("h", F.lit(parts))
    placed = placed.withColumn("grp", grp.cast("int"))
    bounds = placed.select("grp", "v").mapInArrow(_bounds(centres, kind, shrink, nearest, k), "grp int, cell int, least double")
    bounds = bounds.groupBy("grp", "cell").agg(F.min("least").alias("least"))
    salts = max(8, -(-n_data // UNIT_ROWS))
    needed = (
        data.join(bounds, "cell")
        .where("d >= least")
        .select("grp", F.pmod(F.xxhash64("h"), F.lit(salts)).cast("int").alias("salt"), "v", "ids")
    )
    copies = placed.select("grp", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "q", "v")
    found = (
        copies.groupBy("grp", "salt").cogroup(needed.groupBy("grp", "salt"))
        .applyInArrow(_solve(dim, kind, shrink, k), "q bigint, size double, score bigint, vec_id bigint")
    )
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("size"), F.desc("score"), "vec_id"))
    found = found.withColumn("nth", best).where(F.col("nth") <= k + 1).select("q", "size", "score", "vec_id")
    named = asked.join(distinct, ["h", "v"]).select("query_id", "q")
    mine = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), "vec_id")
    return (
        named.join(found, "q")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(mine).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
