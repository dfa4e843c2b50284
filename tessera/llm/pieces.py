"""Sampled SentencePiece segmentations: forward filtering, backward sampling; and lossless decoding.

A text is a space followed by the text, each space written as U+2581. Its lattice has an edge for
every vocabulary piece at every place, with the piece's log-weight, and, for a character that no
piece covers, edges for its UTF-8 bytes. U+2581 in the text itself goes by bytes, so that decoding
gives the text back whatever it holds. No other normalisation is done. The log-weight of a piece is
its score in a unigram model, and -log(1 + rank) in a BPE model, whose scores are ranks, times `alpha`.

No piece crosses a line feed, nor a space after another character, so a text's lattice is a chain of
lattices of its chunks. The forward sums of a chunk, and from them the chances of the edges into each
of its nodes, are computed once per chunk and worker; the backward sampling then goes through all
chunks of a group at a time, an edge each step. The random numbers are hashes of the seed, the row's
key, the chunk's place and the step: equal calls give equal segmentations, however rows are dealt.

Memory is bounded by bytes, not by rows: texts are read in groups of GROUP_CHARS characters, long ones
in several; new chunks are learnt LEARN_CHARS characters at a time; the lattices that a worker remembers
take EDGE_BYTES at most and are forgotten beyond that. A chunk of more than LONG characters is cut
wherever no piece holds the two characters beside each other, which changes no chance; what is left whole
beyond that takes about 0.5 KB a character while it is learnt.

Null texts are empty: they have the piece of the leading space. Null keys are a key of their own. Repeated
rows with equal keys get equal segmentations. An empty table gives no rows. Columns named pieces and text
are replaced, all others are kept. Vocabulary pieces that hold a line feed, or a space after another
character, cannot be used by this lattice and are refused with an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import small_batches, trim

SPACE = "▁"
_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Chunks whose lattices a worker remembers at most, and the bytes of their edges.
REMEMBERED, EDGE_BYTES = 100_000, 48 << 20
#: Characters that are sampled at a time, that are learnt at a time, and beyond which a chunk is cut.
GROUP_CHARS, LEARN_CHARS, LONG = 1 << 17, 1 << 15, 1024
#: The multiplier of the hashes of pieces.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Held:
    """An array of fixed room, whose pages are touched as it fills; it grows only for what exceeds the room on its own."""

    def __init__(self, dtype, room: int):
        self.a, self.n = np.empty(room, dtype), 0

    def add(self, values) -> None:
        m = self.n + len(values)
        if m > len(self.a):
            self.a = np.append(self.a[: self.n], np.empty(m - self.n, self.a.dtype))
        self.a[self.n : m] = values
        self.n = m

    @property
    def live(self) -> np.ndarray:
        return self.a[: self.n]


class Lattices:
    """The vocabulary and the lattices of chunks.

    Nodes of all remembered chunks are numbered; node 0 is the start of every chunk. The edges into
    node i begin at first[i]; `upto` rises over them to more than 1, so that the first edge whose
    `upto` is over a random number is the one it takes.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        ordinary = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        ranks = min((m.get_score(i) for i in ordinary), default=0) < -1000
        self.byte_id = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(m.is_byte(int(i)) for i in self.byte_id):
            raise ValueError("the model has no byte pieces, and without them decoding loses characters")
        self.bytes = [b""] * n
        for b, i in enumerate(self.byte_id.tolist()):
            self.bytes[i] = bytes([b])
        #: By pieces: id and log-weight.
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in ordinary:
            p = m.id_to_piece(i)
            self.bytes[i] = p.replace(SPACE, " ").encode()
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {i} goes over a line feed or an inner space")
            if p:
                self.pieces[p] = (i, alpha * (-log(1 - m.get_score(i)) if ranks else m.get_score(i)))
        self.byte_weight = alpha * -log(n)
        self.tables = [self._table(k) for k in range(1, max(map(len, self.pieces), default=0) + 1)]
        pairs = {p[j : j + 2] for p in self.pieces for j in range(len(p) - 1)}
        #: The pairs of neighbouring characters that pieces hold.
        self.pairs = np.sort(np.array([ord(x[0]) << 32 | ord(x[1]) for x in pairs], np.uint64))
        self.clear()

    def _table(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the beginnings of pieces of k characters: hashes in order, ids (-1: not a whole piece) and weights."""
        heads = sorted({p[:k] for p in self.pieces if len(p) >= k})
        h = np.zeros(len(heads), np.uint64)
        for j in range(k):
            h = h * _BASE + np.array([ord(p[j]) + 1 for p in heads], np.uint64)
        order = np.argsort(h)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces have equal hashes")
        found = [self.pieces.get(p, (-1, 0.0)) for p in heads]
        return h[order], np.array([f[0] for f in found], np.int32)[order], np.array([f[1] for f in found])[order]

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        room = EDGE_BYTES // 12
        self.first, self.upto, self.piece, self.source = (Held(t, room) for t in (np.int32, np.float32, np.int32, np.int32))
        self.first.add([0])
        self.nodes = 1

    @property
    def full(self) -> bool:
        return len(self.number) > REMEMBERED or self.upto.n * 12 > EDGE_BYTES * 3 // 4

    def _codes(self, text: str) -> np.ndarray:
        """Code points as pieces have them. A lone surrogate, which no piece holds, stands for U+2581 in the text itself."""
        return np.frombuffer(text.replace(SPACE, "\ud800").replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def cut(self, chunk: str) -> list[str]:
        """A long chunk, cut wherever no piece holds both neighbours."""
        codes = self._codes(chunk)
        pairs = codes[:-1] << np.uint64(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
        loose = self.pairs[at] != pairs if len(self.pairs) else np.ones(len(pairs), bool)
        ends = [*(np.flatnonzero(loose) + 1).tolist(), len(chunk)]
        return [chunk[x:y] for x, y in zip([0, *ends], ends)]

    def parts(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, some GROUP_CHARS characters at a time."""
        if len(text) <= GROUP_CHARS:
            chunks = _CHUNK.findall(text)
            if max(map(len, chunks)) > LONG:
                chunks = [x for c in chunks for x in (self.cut(c) if len(c) > LONG else [c])]
            yield chunks
            return
        held, size = [], 0
        for m in _CHUNK.finditer(text):
            for c in self.cut(m[0]) if len(m[0]) > LONG else [m[0]]:
                held.append(c)
                size += len(c)
                if size >= GROUP_CHARS:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def learn(self, chunks: list[str]) -> None:
        """Builds the lattices of new chunks, some LEARN_CHARS characters at a time; number[chunk] is its last node."""
        ends = np.cumsum([len(c) for c in chunks])
        lo = 0
        while lo < len(chunks):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LEARN_CHARS, "right")))
            self._learn(chunks[lo:hi])
            lo = hi

    def _learn(self, chunks: list[str]) -> None:
        sizes = np.array([len(c) for c in chunks], np.int64)
        text = "".join(chunks)
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        codes = self._codes(text)
        n, owner = len(codes), np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(n) - begin[owner]  # of a character in its chunk; its slot is the place's node
        slot, left = np.arange(n) + owner, sizes[owner] - place
        src, dst, ids, weights, covered = [], [], [], [], np.zeros(n, bool)
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        for k, (hashes, piece, weight) in enumerate(self.tables, 1):
            fits = left[alive] >= k
            alive, h = alive[fits], h[fits]
            if not len(alive):
                break
            h = h * _BASE + codes[alive + k - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[at] == h
            alive, h, at = alive[known], h[known], at[known]
            whole = piece[at] >= 0
            s = alive[whole]
            src.append(slot[s])
            dst.append(slot[s] + k)
            ids.append(piece[at[whole]])
            weights.append(weight[at[whole]])
            if k == 1:
                covered[s] = True
        # The other characters go by their bytes: a node after each but the last.
        bare = np.flatnonzero(~covered)
        total = n + len(sizes)
        by_bytes = [chr(c).encode() for c in raw[bare].tolist()]
        lengths = np.array([len(x) for x in by_bytes], np.int64)
        bytes_id = self.byte_id[np.frombuffer(b"".join(by_bytes), np.uint8)] if len(bare) else np.empty(0, np.int32)
        last = np.cumsum(lengths) - 1
        inner = np.ones(len(bytes_id), bool)
        inner[last] = False
        chain = total + np.cumsum(inner) - 1  # the node after each inner byte
        opens = np.zeros(len(bytes_id), bool)
        opens[last - lengths + 1] = True
        before = np.where(opens, np.repeat(slot[bare], lengths), np.append(0, chain[:-1])[: len(chain)])
        src.append(slot[bare])
        dst.append(slot[bare] + 1)
        ids.append(bytes_id[last])
        weights.append(self.byte_weight * lengths)
        back = np.concatenate([*src[:-1], before[last]]) if len(bare) else np.concatenate(src)
        src, dst, ids, weights = (np.concatenate(x) for x in (src, dst, ids, weights))
        # Forward sums as logarithms, over all chunks at a time: the edges into the first places, the second ones ...
        chunk_of = np.repeat(np.arange(len(sizes)), sizes + 1)
        place_of = np.arange(total) - (begin + np.arange(len(sizes)))[chunk_of]
        order = np.lexsort((dst, place_of[dst]))
        src, dst, ids, weights, back = src[order], dst[order], ids[order], weights[order], back[order]
        starts = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.empty(0, np.int64)
        segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(dst))))
        stage = place_of[dst[starts]]
        alpha, share = np.zeros(total), np.empty(len(dst))
        ends = np.append(starts, len(dst))
        bounds = np.append(np.flatnonzero(np.append(True, stage[1:] != stage[:-1])), len(stage)) if len(stage) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            x, y = ends[lo], ends[hi]
            value, seg, own = alpha[src[x:y]] + weights[x:y], starts[lo:hi] - x, segment[x:y] - lo
            most = np.maximum.reduceat(value, seg)
            value = np.exp(value - most[own])
            whole = np.add.reduceat(value, seg)
            alpha[dst[starts[lo:hi]]] = most + np.log(whole)
            share[x:y] = value / whole[own]
        # Sums within a node, edge after edge, so that they do not depend on the chunks beside.
        upto, nth = share.copy(), np.arange(len(dst)) - starts[segment] if len(dst) else share
        for k in range(1, int(nth.max(initial=0)) + 1):
            e = np.flatnonzero(nth == k)
            upto[e] += upto[e - 1]
        upto[ends[1:] - 1] = 2.0
        # Nodes: the slots, then those between bytes.
        base, edges = self.nodes, self.upto.n
        first = np.zeros(total + int(inner.sum()), np.int64)
        first[dst[starts]] = starts + edges
        first[total:] = edges + len(dst) + np.arange(int(inner.sum()))
        is_start = np.zeros(len(first), bool)
        is_start[begin + np.arange(len(sizes))] = True
        node = np.where(is_start, 0, base + np.arange(len(first)))
        self.first.add(first)
        self.upto.add(np.append(upto, np.full(int(inner.sum()), 2.0)))
        self.piece.add(np.append(ids, bytes_id[inner]))
        self.source.add(np.append(node[back], node[before[inner]]) if len(back) else [])
        self.nodes += len(first)
        self.number.update(zip(chunks, (base + begin + np.arange(len(sizes)) + sizes).tolist()))

    def encode(self, texts: list[str | None], keys: list, seed: int) -> list[np.ndarray]:
        """The ids of a sampled segmentation of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, chars = [], 0

        def flush() -> None:
            for (i, _, _, _), ids in zip(held, self._sample(held)):
                out[i].append(ids)
            held.clear()

        for i, (text, key) in enumerate(zip(texts, keys)):
            row, place = xxhash.xxh64_intdigest(str(key), seed), 0
            for chunks in self.parts(" " + (text or "")):
                held.append((i, row, place, chunks))
                place += len(chunks)
                chars += sum(map(len, chunks))
                if chars >= GROUP_CHARS:
                    flush()
                    chars = 0
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _sample(self, parts: list[tuple[int, int, int, list[str]]]) -> list[np.ndarray]:
        """The ids of each part (text's number, key's hash, place of its first chunk, chunks)."""
        sizes = np.array([len(p[3]) for p in parts], np.int64)
        chunks = [c for p in parts for c in p[3]]
        if self.full:
            self.clear()
        end = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(miss := np.flatnonzero(end < 0)):
            lost = [chunks[i] for i in miss.tolist()]
            self.learn(list(dict.fromkeys(lost)))
            end[miss] = [self.number[c] for c in lost]
        row, begin = np.array([p[1] for p in parts], np.uint64), np.array([p[2] for p in parts], np.int64)
        place = np.arange(len(chunks)) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)
        base = _hash(np.repeat(row, sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first, upto, piece, source = self.first.live, self.upto.live, self.piece.live, self.source.live
        live, at, steps = np.arange(len(chunks)), end, []
        while len(live):
            step = np.uint64((len(steps) + 1) * 0xD1B54A32D192ED03 % (1 << 64))
            u = (_hash(base[live] + step) >> np.uint64(40)).astype(np.float32) / np.float32(2**24)
            edge = first[at].astype(np.int64)
            on = np.flatnonzero(upto[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[upto[edge[on]] <= u[on]]
            steps.append((live, piece[edge]))
            at = source[edge]
            more = at > 0
            live, at = live[more], at[more]
        count = np.zeros(len(chunks), np.int64)
        for live, _ in steps:
            count[live] += 1
        stop = np.cumsum(count)
        ids = np.empty(stop[-1] if len(stop) else 0, np.int32)
        for k, (live, found) in enumerate(steps):
            ids[stop[live] - 1 - k] = found
        upto_row = np.append(0, np.append(0, stop)[np.cumsum(sizes)])
        return [ids[x:y] for x, y in zip(upto_row[:-1].tolist(), upto_row[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes, its leading space taken off."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:]


@lru_cache(maxsize=4)
def lattices(path: str, alpha: float) -> Lattices:
    return Lattices(path, alpha)


def _encode(docs: DataFrame, model: str, key: str, alpha: float, seed: int, back: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("pieces", "text")]
    given = docs.select(*kept, F.col(key).cast("string").alias("__key"), F.col("text").cast("string").alias("__text"))
    fields = [*docs.select(*kept).schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("text", T.StringType())] * back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattices(model, alpha)
        for b in batches:
            ids = table.encode(b.column("__text").to_pylist(), b.column("__key").to_pylist(), seed)
            at = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            out = [*(b.column(c) for c in kept), pa.ListArray.from_arrays(at, pa.array(flat))]
            if back:
                out.append(pa.array([table.decode(x).decode() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "pieces", *["text"] * back])
        trim()

    return given.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, key: str = "doc_id", alpha: float = 1.0, seed: int = 11) -> DataFrame:
    """The columns of `docs` but text, and pieces, the ids of a sampled segmentation (a column of that name is replaced)."""
    return _encode(docs, model, key, alpha, seed, False)


def encode_and_decode(docs: DataFrame, model: str, key: str = "doc_id", alpha: float = 1.0, seed: int = 11) -> DataFrame:
    """As encode, and text as it is decoded from the pieces, in one pass."""
    return _encode(docs, model, key, alpha, seed, True)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of `encoded` and text, decoded from pieces (null: null); a column of that name is replaced."""
    small_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "text"]
    schema = T.StructType([*encoded.select(*kept).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattices(model, 1.0)
        for b in batches:
            texts = [None if not x.is_valid else table.decode(x.values.to_numpy(zero_copy_only=False)).decode() for x in b.column("pieces")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return encoded.select(*kept).mapInArrow(run, schema)
