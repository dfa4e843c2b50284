"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A text's words are its runs of bytes other than ASCII white space, A-Z lower-cased; its shingles
are `k` consecutive words, repeats counted. Fewer words make one shingle of all; no words make
the zero fingerprint. Every shingle is hashed by XXH64 (seed 42), and a fingerprint bit is set
where more than half the hashes have it. Fingerprints of more than 64 bits take further hashes,
mixed from the first.

Equal fingerprints are merged first, so that copies cost nothing afterwards. The distinct ones
are dealt into cells, and numpy compares a cell's rows by exclusive-or and bit counts. Of a cell
only a spanning forest of its links is kept, so that a dense group makes no more rows than it has
members. Two ways of dealing:
  signature: a tile holds the fingerprints with equal bit counts in each of `blocks` parts (1: of all). Two
             fingerprints within `radius` have signatures whose counts differ by `radius` in sum
             at most; only such tiles meet. Exact. For small radii.
  keys:      a tile holds the fingerprints of texts that share one of the `keys` shingles with the
             least hashes. Sets of n shingles with a Jaccard similarity of s share one for certain
             if n <= keys / (1 - s), else but for a chance of (1 - s)^keys. For large radii, whose
             bit counts rule nothing out.
A cell of more than CELL_ROWS rows is dealt by hash into parts of about that size, each pair of
which is a cell, so no task holds more than two parts.

Null texts count as empty. Rows without doc_id link nothing and get a null component. Of rows that
share a doc_id each gets the component of its own text. Very long texts are one row of a batch
bounded by bytes; bits are counted UNPACK hashes at a time. Other columns are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.components import connected_components
from tessera.session import cut, partitions, small_batches, trim

#: Rows of a cell beyond which it is dealt into parts, and rows beyond which a cell is compared on its own.
CELL_ROWS, FEW_ROWS = 50_000, 32
#: Hot cells up to which their table is broadcast; a row is two numbers.
BROADCAST_CELLS = 100_000
#: Rows of cells that are looked at together.
CHUNK_ROWS = 1 << 14
#: Comparisons that numpy makes at a time.
STRIP = 1 << 21
#: Rows of a tile of a group of candidates, the tiles that rows alone make of a group, and a tile's shingles.
TILE_ROWS, MOST_TILES, TILE_SHINGLES = 1500, 12, 3_000_000
#: Hash bits that are unpacked at a time.
UNPACK = 1 << 16


def _mix(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further hash of each hash: a multiply-and-shift finaliser."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * i) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group of hashes, which begin at `starts`: the bits set in more than half."""
    counts = np.zeros((len(starts), 64), np.int64)
    sizes = np.diff(np.append(starts, len(hashes)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    for lo in range(0, len(hashes), UNPACK):
        part, own = hashes[lo : lo + UNPACK], owner[lo : lo + UNPACK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints_of(texts: list[bytes | None], k: int, words: int) -> np.ndarray:
    """Fingerprints of texts in UTF-8: an array of `words` 64-bit integers for each."""
    return _fingerprints([_hashes(t, k) for t in texts], words)


def _hashes(text: bytes | None, k: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    w = (text or b"").lower().split()
    shingles = map(b" ".join, zip(*(w[j:] for j in range(k)))) if len(w) >= k else [b" ".join(w)] if w else []
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def _fingerprints(hashes: list[np.ndarray], words: int) -> np.ndarray:
    rows = [i for i, h in enumerate(hashes) if len(h)]
    out = np.zeros((len(hashes), words), np.uint64)
    if rows:
        h, starts = np.concatenate([hashes[i] for i in rows]), np.append(0, np.cumsum([len(hashes[i]) for i in rows])[:-1])
        for j in range(words):
            out[rows, j] = _majority(h if j == 0 else _mix(h, j), starts)
    return out


def fingerprints(docs: DataFrame, k: int, words: int = 1) -> DataFrame:
    """(doc_id, f0 .. f<words-1>) of every row, the fingerprint's parts as signed integers."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(1).to_pylist(), k, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.ascontiguousarray(fp[:, j])) for j in range(words))],
                names=["doc_id", *(f"f{j}" for j in range(words))],
            )
        trim()

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return slim.mapInArrow(run, "doc_id bigint, " + ", ".join(f"f{j} bigint" for j in range(words)))


def _steps(blocks: int, radius: int) -> list[list[int]]:
    """The signature differences of a sum of at most `radius`, one of each opposite pair."""
    near = [d for d in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, d)) <= radius]
    return [list(d) for d in near if d > (0,) * blocks]


def _by_signature(nodes: DataFrame, parts: list[str], radius: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """((cell, visitor, node, parts), (cell, rows)): each node at home in its own tile and a visitor in half the others near it."""
    width = 64 // blocks if blocks > 1 else 64 * len(parts)
    counts = [
        F.bit_count(F.shiftrightunsigned("f0", width * b).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        for b in range(blocks)
    ] if blocks > 1 else [sum((F.bit_count(p) for p in parts), F.lit(0))]
    base = 2 * width + 2 * radius
    code = sum((c.cast("bigint") + radius) * base**b for b, c in enumerate(counts))
    shifts = [sum(x * base**b for b, x in enumerate(d)) for d in _steps(blocks, radius)]
    moves = F.array(*(F.lit(s).cast("bigint") for s in [0, *shifts]))
    cell = (F.col("code") + F.col("move")).alias("cell")
    nodes = nodes.withColumn("code", code)
    dealt = nodes.select("node", *parts, "code", F.explode(moves).alias("move"))
    sizes = nodes.groupBy("code").count().select("code", "count", F.explode(moves).alias("move"))
    return (
        dealt.select(cell, (F.col("move") != 0).cast("int").alias("visitor"), "node", *parts),
        sizes.select(cell, "count").groupBy("cell").agg(F.sum("count").alias("rows")),
    )


def _by_keys(nodes: DataFrame, parts: list[str], keys: int) -> tuple[DataFrame, DataFrame]:
    """((cell, visitor, node, parts), (cell, rows)): each node at home in the cells of its keys k0, k1, ..."""
    dealt = nodes.select("node", *parts, F.explode(F.array(*(f"k{i}" for i in range(keys)))).alias("cell")).where("cell IS NOT NULL")
    return dealt.withColumn("visitor", F.lit(0)), dealt.groupBy("cell").agg(F.count("*").alias("rows"))


def _in_parts(cells: DataFrame, hash_of: str, tiles: str) -> DataFrame:
    """Deals the rows of a cell into `tiles` parts; sub tells the pair of parts, role what a row is in it.

    role: 0 of a part with itself, 2 of the lower part of a pair, 4 of the higher; one more for visitors.
    """
    t = F.pmod(F.xxhash64(hash_of), tiles).cast("int")
    dealt = cells.withColumn("t", t).withColumn("o", F.explode(F.sequence(F.lit(0), F.col(tiles) - 1)))
    low, high = F.least("t", "o").cast("bigint"), F.greatest("t", "o").cast("bigint")
    role = F.when(F.col("t") == F.col("o"), 0).when(F.col("t") < F.col("o"), 2).otherwise(4) + F.col("visitor")
    return dealt.withColumn("sub", F.shiftright(high * (high + 1), 1) + low).withColumn("role", role).drop("t", "o", tiles, "visitor")


def _bounded(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, sub, role, ..): the cells, those of more than CELL_ROWS rows in parts."""
    large = cut(sizes.where(F.col("rows") > CELL_ROWS).select("cell", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("tiles")))
    n = large.count()
    if not n:
        return cells.select("cell", F.lit(0).cast("bigint").alias("sub"), F.col("visitor").alias("role"), *(c for c in cells.columns if c not in ("cell", "visitor")))
    joined = cells.join(F.broadcast(large) if n <= BROADCAST_CELLS else large, "cell", "left")
    return _in_parts(joined.withColumn("tiles", F.coalesce("tiles", F.lit(1))), "node", "tiles")


def _near(a: np.ndarray, b: np.ndarray, radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of `a` and `b`, both in order of bit counts, within the radius; a before b if own."""
    ca, cb = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    step = max(1, min(len(a), STRIP // max(1, min(len(b), 4096))))
    for i in range(0, len(a), step):
        x = a[i : i + step]
        lo = int(np.searchsorted(cb, ca[i] - radius, "left"))
        hi = int(np.searchsorted(cb, ca[min(len(a), i + step) - 1] + radius, "right"))
        for j in range(max(lo, i) if own else lo, hi, 4096):
            y = b[j : min(hi, j + 4096)]
            d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for w in range(1, min(2, a.shape[1])):
                d += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
            p, q = np.nonzero(d <= radius)
            dist = d[p, q].astype(np.int64)
            if a.shape[1] > 2 and len(p):
                dist += np.bitwise_count(x[p, 2:] ^ y[q, 2:]).sum(axis=1, dtype=np.int64)
            good = dist <= radius
            if own:
                good &= p + i < q + j
            if good.any():
                yield p[good] + i, q[good] + j


def _forest(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Lets the links join the components that `label` gives, in place; label: a smaller member's index."""
    while True:
        lp, lq = label[p], label[q]
        if (same := lp == lq).all():
            return
        p, q, lp, lq = p[~same], q[~same], lp[~same], lq[~same]
        np.minimum.at(label, np.maximum(lp, lq), np.minimum(lp, lq))
        while not np.array_equal(jump := label[label], label):
            label[:] = jump


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows in runs of whole cells, some CHUNK_ROWS at a time or one large cell, and the first row of each cell.

    The first two columns tell the cell; the rows come in order of cells.
    """
    held: list[pa.RecordBatch] = []
    rows, last = 0, None

    def firsts(t: pa.Table) -> np.ndarray:
        ids = [t.column(i).to_numpy() for i in range(2)]
        return np.flatnonzero(np.append(True, (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])))

    for b in batches:
        if not b.num_rows:
            continue
        ends = [tuple(b.column(i)[j].as_py() for i in range(2)) for j in (0, b.num_rows - 1)]
        grown = ends[0] == ends[1] == last  # all of the cell that was open before
        last = ends[1]
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK_ROWS and not grown:
            t = pa.Table.from_batches(held)
            first = firsts(t)
            if len(first) > 1:
                yield t.slice(0, int(first[-1])), first[:-1]
                held = t.slice(int(first[-1])).to_batches()
                rows = sum(x.num_rows for x in held)
    if held:
        t = pa.Table.from_batches(held)
        yield t, firsts(t)


def _forest_rows(label: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Links (src, dst) that span the components of a cell."""
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["src", "dst"])


def _read(t: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(roles, nodes, fingerprints) of rows of cells."""
    fp = np.stack([t.column(f"f{j}").to_numpy() for j in range(words)], axis=1).view(np.uint64)
    return t.column("role").to_numpy(), t.column("node").to_numpy(), fp


def _meetings(role: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """The (rows, other rows, whether they are the same) of a cell that are to be compared."""
    at = [np.flatnonzero(role == r) for r in range(6)]
    pairs = [(0, 0), (0, 1), (2, 4), (2, 5), (3, 4)]
    return [(at[x], at[y], x == y) for x, y in pairs if len(at[x]) and len(at[y])]


def _few(first: np.ndarray, size: np.ndarray, role: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of all cells of 2 to FEW_ROWS rows, at a time for each size."""
    out = [], []
    for m in range(2, FEW_ROWS + 1):
        at = first[size == m]
        i, j = np.triu_indices(m, 1)
        for lo in range(0, len(at), step := max(1, STRIP // 8 // len(i))):
            p, q = ((at[lo : lo + step, None] + k).ravel() for k in (i, j))
            side = role[p] >> 1
            meet = ((role[p] & role[q] & 1) == 0) & ((side == 0) | (side != role[q] >> 1))
            p, q = p[meet], q[meet]
            near = np.bitwise_count(fp[p] ^ fp[q]).sum(axis=1, dtype=np.int64) <= radius
            out[0].append(p[near])
            out[1].append(q[near])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def _links(batches: Iterator[pa.RecordBatch], words: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) of each cell, which span the components that all its links make."""
    for t, first in _whole(batches):
        role, node, fp = _read(t, words)
        size = np.diff(np.append(first, len(node)))
        label = np.arange(len(node))
        _forest(label, *_few(first, size, role, fp, radius))
        for lo, n in zip(first[size > FEW_ROWS].tolist(), size[size > FEW_ROWS].tolist()):
            order = lo + np.argsort(np.bitwise_count(fp[lo : lo + n]).sum(axis=1, dtype=np.int64), kind="stable")
            for home, other, own in _meetings(role[order]):
                home, other = order[home], order[other]
                for p, q in _near(fp[home], fp[other], radius, own):
                    _forest(label, home[p], other[q])
        yield _forest_rows(label, node)
    trim()


def _verified(batches: Iterator[pa.RecordBatch], words: int, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) of each cell, which span the components that its pairs within the radius and as similar make.

    Every such pair is decided by its sets of shingles, unless verified links join it already.
    """
    for t, first in _whole(batches):
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), t.num_rows]):
            if hi - lo > 1:
                yield _verified_cell(t.slice(lo, hi - lo), words, radius, similarity)
    trim()


def _verified_cell(t: pa.Table, words: int, radius: int, similarity: float) -> pa.RecordBatch:
    role, node, fp = _read(t, words)
    order = np.argsort(np.bitwise_count(fp).sum(axis=1, dtype=np.int64), kind="stable")
    texts = t.column("shingles").to_pylist()
    size = np.array([len(x) // 8 for x in texts])
    ends = np.cumsum(size)
    _, ids = np.unique(np.frombuffer(b"".join(texts), np.uint64), return_inverse=True)
    del texts
    sets = [ids[ends[i] - size[i] : ends[i]] for i in order]
    role, node, fp, size = role[order], node[order], fp[order], size[order]
    label, mark = np.arange(len(node)), np.zeros(len(ids), np.uint8)
    for home, other, own in _meetings(role):
        for p, q in _near(fp[home], fp[other], radius, own):
            p, q = home[p], other[q]
            small, large = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
            maybe = (label[p] != label[q]) & (small > 0) & (small >= similarity * large)
            p, q = p[maybe], q[maybe]
            ends = np.append(np.flatnonzero(p[1:] != p[:-1]) + 1, len(p))
            lo = 0
            for hi in ends.tolist():
                if hi > lo:
                    one, rest = p[lo], q[lo:hi]
                    rest = rest[label[rest] != label[one]]
                    if len(rest):
                        mark[sets[one]] = 1
                        starts = np.append(0, np.cumsum(size[rest])[:-1])
                        shared = np.add.reduceat(mark[np.concatenate([sets[i] for i in rest])], starts, dtype=np.int64)
                        mark[sets[one]] = 0
                        alike = rest[shared >= similarity * (size[one] + size[rest] - shared)]
                        _forest(label, np.full(len(alike), one), alike)
                lo = hi
    return _forest_rows(label, node)


def _fingerprinted(docs: DataFrame, k: int, words: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(fingerprints of all rows, one node for each different one, the names of their parts)."""
    parts = [f"f{j}" for j in range(words)]
    found = cut(fingerprints(docs, k, words))
    return found, cut(found.where("doc_id IS NOT NULL").groupBy(*parts).agg(F.min("doc_id").alias("node"))), parts


def _linked(cells: DataFrame, sizes: DataFrame, words: int, radius: int) -> DataFrame:
    """(src, dst): links between the nodes of cells, which span the components of all."""
    dealt = _bounded(cells, sizes).select("cell", "sub", "role", "node", *(f"f{j}" for j in range(words)))
    dealt = dealt.repartition(partitions(cells.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub")
    return dealt.mapInArrow(lambda it: _links(it, words, radius), "src bigint, dst bigint")


def _named(found: DataFrame, nodes: DataFrame, parts: list[str], edges: DataFrame) -> DataFrame:
    """found with component_id."""
    named = nodes.join(connected_components(edges), "node", "left").select(
        *parts, F.coalesce("component", "node").alias("component_id")
    )
    return found.where("doc_id IS NOT NULL").join(named, parts).unionByName(
        found.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("bigint"))
    )


def simhash_components(docs: DataFrame, k: int = 3, words: int = 1, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(doc_id, f0 .., component_id) of every row: its fingerprint and the smallest doc_id that links reach.

    k: words of a shingle. words: 64-bit parts of a fingerprint. radius: most differing bits of a link.
    blocks: parts of a signature where words is 1 and radius 2 or less, else the signature is the count
    of all bits; more blocks make smaller tiles and more visits.
    """
    found, nodes, parts = _fingerprinted(docs, k, words)
    cells = _by_signature(nodes, parts, radius, blocks if words == 1 and radius <= 2 else 1)
    return _named(found, nodes, parts, _linked(*cells, words, radius))


def _named_sets(docs: DataFrame, k: int, words: int, keys: int) -> DataFrame:
    """(doc_id, f0 .., s0, s1, n, k0 ..) of every row: the fingerprint of its set of shingles, a digest of the set, its size and least hashes."""
    small_batches(docs.sparkSession)
    columns = ["doc_id", *(f"f{j}" for j in range(words)), "s0", "s1", "n", *(f"k{i}" for i in range(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_hashes(t, k)) for t in b.column(1).to_pylist()]
            names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), np.int64).reshape(-1, 2)
            size = np.array([len(x) for x in sets], np.int64)
            least = np.zeros((len(sets), keys), np.uint64)
            for i, x in enumerate(sets):
                least[i, : len(x)] = x[:keys]
            numbers = np.column_stack([_fingerprints(sets, words).view(np.int64), names, size])
            made = [pa.array(np.ascontiguousarray(c)) for c in numbers.T]
            made += [pa.array(np.ascontiguousarray(least[:, i]).view(np.int64), mask=size <= i) for i in range(keys)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=columns)
        trim()

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return slim.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def _with_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """members (node, .., s0, s1, n) with the sets of shingles that these name, from the texts."""
    kept = [c for c in members.columns if c not in ("s0", "s1", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for b in batches:
            sets, good = [], []
            for node, text, *name in zip(*(b.column(c).to_pylist() for c in ("node", "t", "s0", "s1"))):
                if node != last:
                    last, seen = node, set()
                sets.append(np.unique(_hashes(text, k)).tobytes())
                digest = np.frombuffer(xxhash.xxh3_128_digest(sets[-1]), np.int64).tolist()
                good.append(digest == name and tuple(digest) not in seen)
                if good[-1]:
                    seen.add(tuple(digest))
            rows = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "shingles"])
            yield rows.filter(pa.array(good, pa.bool_()))
        trim()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("binary").alias("t"))
    joined = texts.hint("merge").join(members.hint("merge"), "node")
    types = {c: t for c, t in members.dtypes}
    return joined.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", shingles binary")


def similar_components(docs: DataFrame, k: int = 5, words: int = 4, radius: int = 60, similarity: float = 0.8, keys: int = 8) -> DataFrame:
    """(doc_id, f0 .., component_id) of every row: near-duplicates by their shingles, found by SimHash.

    Texts that share one of their `keys` least shingles meet in its tile. There fingerprints of 256 bits, of sets of shingles
    without repeats, that differ in `radius` bits or fewer are candidates: texts of Jaccard similarity 0.8 differ in 38.8 bits
    on average, with a deviation of 5.7, unlike ones in 128 with one of 8. Every pair of candidates is a link if its sets of
    shingles are as similar as is asked; only pairs that verified links of their cell join already are not looked at. Texts
    with the same set are one node. Candidates meet within the groups that they make: a large group is dealt into parts,
    each pair of which is a cell.
    """
    parts = [f"f{j}" for j in range(words)]
    names, least = [*parts, "s0", "s1"], [f"k{i}" for i in range(keys)]
    found = cut(_named_sets(docs, k, words, keys))
    same = found.where("doc_id IS NOT NULL").groupBy(*names)
    nodes = cut(same.agg(F.min("doc_id").alias("node"), *(F.min(c).alias(c) for c in ["n", *least])))
    groups = connected_components(_linked(*_by_keys(nodes, parts, keys), words, radius))
    members = cut(nodes.join(groups, "node").select("node", *names, "n", F.col("component").alias("grp")))
    tiles = F.greatest(
        F.least(F.ceil(F.count("*") / TILE_ROWS), F.lit(MOST_TILES)), F.ceil(F.sum("n") / TILE_SHINGLES)
    ).cast("int")
    large = cut(members.groupBy("grp").agg(tiles.alias("tiles")).where("tiles > 1"))
    large = F.broadcast(large) if large.count() <= BROADCAST_CELLS else large
    members = members.join(large, "grp", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    cells = _in_parts(_with_sets(docs, members, k).withColumn("visitor", F.lit(0)), "node", "tiles")
    cells = cells.select("grp", "sub", "role", "node", *parts, "shingles")
    n = partitions(docs.sparkSession)
    cells = cells.repartitionById(n, F.pmod(F.xxhash64("grp") % n + F.col("sub"), F.lit(n)).cast("int"))
    checked = cells.sortWithinPartitions("grp", "sub").mapInArrow(lambda it: _verified(it, words, radius, similarity), "src bigint, dst bigint")
    return _named(found.drop("n", *least), nodes.drop("n", *least), names, checked).drop("s0", "s1")


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` whose document is the smallest of its group of similar_components.

    Of rows that share a doc_id one stays, that with the least hash of its columns. Rows without doc_id stay.
    """
    comp = similar_components(docs.select("doc_id", "text"), **how)
    keep = comp.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id = c").select("doc_id")
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    one = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id IS NULL"))
