"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

A file holds a run of documents in ascending doc_id order (null first):

  bytes 0-3    TKID                       the magic
  byte  4      1                          the version
  byte  5      2 or 4                     bytes of an id, little-endian
  bytes 6-13   u64                        XXH64 of the dictionary; 0 without one
  then         one zstandard frame a document
  index        n x i64 doc_id, n x u8 doc_id is null, (n + 1) x u64 offset, n x u64 tokens
  last 16      u64 n, u64 place of the index

The dictionary, trained on the serialised ids of a bounded sample of documents, is a file of its
own, named by its hash. One document is read by its offset alone, without those before it.

Files are written under a task's own name and then renamed, so that a task that runs again
replaces its file. Null texts are empty: the end id alone. Rows that share a doc_id are kept.
An empty table makes no files. Only doc_id and text are read, so that other columns may have any
names. A very long text is one frame; its ids are held by one task, four bytes each.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, partitions, small_batches, trim

MAGIC = b"TKID\x01"
#: Pieces of text whose ids a worker remembers at most, and their characters.
REMEMBERED, REMEMBERED_CHARS = 1_500_000, 30_000_000
#: Documents, and ids of each, that the dictionary is trained on at most, and its bytes at most.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY = 1000, 4096, 64 << 10
_BREAK = re.compile(r"(?= \S)")
_RUN = re.compile(r" \s")
#: The splitting rule of the byte-level tokenizers, a fixed value of theirs.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _key(text: str) -> str:
    """The key of a text: without its leading space, if it has one only; else with one more."""
    return text[1:] if text[0] == " " and text[1:2] not in ("", " ") else " " + text


def _of_key(key: str) -> str:
    """The text of a key."""
    return key[1:] if key[0] == " " else " " + key


class Remembered:
    """Runs of ids by string: a number for each string, and all runs in one array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.flat, self.ends, self.used = np.empty(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), 0

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, m = len(self.number), len(ids)
        self.chars += sum(map(len, strings))
        self.number.update(zip(strings, range(first, first + len(strings))))
        if self.used + m > len(self.flat):
            self.flat = np.append(self.flat, np.empty(max(self.used + m, 2 * len(self.flat)) - len(self.flat), np.uint32))
        if first + len(sizes) >= len(self.ends):
            self.ends = np.append(self.ends, np.empty(max(first + len(sizes), len(self.ends)) + 1, np.int64))
        self.flat[self.used : self.used + m] = ids
        self.ends[first + 1 : first + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += m

    def find(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, strings, repeat(-1)), np.int64, len(strings))

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbers, one after another, and the size of each run."""
        lo, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        skip = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[skip + np.arange(len(skip))], sizes


class Encoder:
    """A byte-level BPE tokenizer, with the library's results for add_special_tokens=False.

    Merges never cross the pieces of its splitting rule, which always begins one at a space before
    a non-space. So texts are cut there, equal parts are split into pieces once, and the library's
    model merges every different piece once. The strings of added tokens have ids of their own, and
    the texts between them are encoded one by one; where an added token takes white space beside it
    or whole words only, texts that hold it go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or self.tokenizer.normalizer is not None:
            raise ValueError("the tokenizer is no byte-level one")
        # The characters that stand for bytes in byte-level vocabularies: printable ones for themselves.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.letters[32])
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {c: i for c, (i, _) in added.items()}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for _, t in added.values())
        self.marks = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.known = Remembered()

    def _shown(self, key: str) -> str:
        """The text of a key as byte-level vocabularies write it."""
        if key.isascii() and key.isalpha():
            return self.space + key
        return _of_key(key).encode().decode("latin-1").translate(self.letters)

    def _merge(self, new: list[str]) -> None:
        """Remembers the ids of new pieces, given by their keys."""
        merge = self.tokenizer.model.tokenize
        runs = [[t.id for t in merge(x)] for x in map(self._shown, new)]
        self.known.add(new, np.fromiter(chain.from_iterable(runs), np.uint32), np.fromiter(map(len, runs), np.int64, len(runs)))

    def _learn(self, keys: list[str]) -> None:
        """Remembers the ids of new parts. A part of letters alone is a piece; others are split."""
        words, others = [], []
        for k in keys:
            (words if k.isalpha() else others).append(k)
        if words:
            self._merge(words)
        find, known = _PIECES.findall, self.known
        split = [list(map(_key, find(_of_key(k)))) for k in others]
        flat = [x for xs in split for x in xs]
        at = known.find(flat)
        if len(miss := np.flatnonzero(at < 0)):
            self._merge(list(dict.fromkeys(flat[i] for i in miss.tolist())))
            at = known.find(flat)
        ids, sizes = known.runs(at)
        counts = np.array([len(xs) for xs in split], np.int64)
        lengths = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))])
        several = counts > 1  # a part of one piece is known by now
        known.add([k for k, s in zip(others, several.tolist()) if s], ids[np.repeat(several, lengths)], lengths[several])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null texts have none."""
        marked = [i for i, t in enumerate(texts) if t and any(c in t for c in self.added)]
        if not marked:
            return self._encode(texts)
        split = {i: self.marks.split(texts[i]) if self.plain else [] for i in marked}
        rest = [x for i, t in enumerate(texts) for x in (split[i][::2] if i in split else [t])]
        found, out = iter(self._encode(rest)), []
        for i, t in enumerate(texts):
            if i not in split:
                out.append(next(found))
            elif self.plain:
                out.append(np.concatenate([np.array([self.added[x]], np.uint32) if j % 2 else next(found) for j, x in enumerate(split[i])]))
            else:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        keys: list[str] = []
        sizes = []
        for text in texts:
            before = len(keys)
            if text:
                if _RUN.search(text) or text[0] == " " or text[-1] == " ":
                    keys += [_key(p) for p in _BREAK.split(text) if p]
                else:
                    rest = text.split(" ")
                    rest[0] = " " + rest[0]
                    keys += rest
            sizes.append(len(keys) - before)
        if len(self.known.number) > REMEMBERED or self.known.chars > REMEMBERED_CHARS:
            self.known.clear()
        at = self.known.find(keys)
        if len(miss := np.flatnonzero(at < 0)):
            lost = [keys[i] for i in miss.tolist()]
            self._learn(list(dict.fromkeys(lost)))
            at[miss] = self.known.find(lost)
        ids, n = self.known.runs(at)
        upto = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(np.array(sizes, np.int64)))]
        return [ids[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    """The dictionary; empty where the sample, beginnings of the table's first rows, is too small for one."""
    beginnings = docs.where("text IS NOT NULL").select(F.substring("text", 1, 8 * SAMPLE_IDS).alias("text"))
    texts = [r["text"] for r in beginnings.limit(SAMPLE_DOCS).collect()]
    rows = [np.append(x, np.uint32(end))[:SAMPLE_IDS].astype("<u2" if _width(tokenizer) == 2 else "<u4").tobytes() for x in encoder(tokenizer).encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _width(tokenizer: str) -> int:
    return 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int) -> DataFrame:
    """Writes `docs` (doc_id, text) under `path`; the manifest (shard, file, n_docs, n_tokens), in order of shard."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dictionary = train_dictionary(slim, tokenizer, end)
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    digest = xxhash.xxh64_intdigest(dictionary) if dictionary else 0
    if dictionary:
        with fs.open_output_stream(f"{root}/{digest:016x}.dictionary") as f:
            f.write(dictionary)
    width = _width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        shard = TaskContext.get().partitionId()
        name = f"{root}/{shard:08d}.tkid"
        made = f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=True)
        ids, sizes, lengths, f = [], [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            if f is None:
                f = fs.open_output_stream(made)
                f.write(MAGIC + struct.pack("<BQ", width, digest))
            ids += b.column(0).to_pylist()
            for x in encoder(tokenizer).encode(b.column(1).to_pylist()):
                x = np.append(x, np.uint32(end)).astype(f"<u{width}")
                frame = pack.compress(x.tobytes())
                f.write(frame)
                sizes.append(len(frame))
                lengths.append(len(x))
        if f is None:
            return
        at = len(MAGIC) + 9 + np.append(0, np.cumsum(np.array(sizes, np.int64)))
        f.write(np.array([i or 0 for i in ids], "<i8").tobytes())
        f.write(np.array([i is None for i in ids], "u1").tobytes())
        f.write(at.astype("<u8").tobytes())
        f.write(np.array(lengths, "<u8").tobytes())
        f.write(struct.pack("<QQ", len(ids), int(at[-1])))
        f.close()
        fs.move(made, name)
        trim()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{path}/{shard:08d}.tkid"], "n_docs": [len(ids)], "n_tokens": [sum(lengths)]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    sorted_docs = slim.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(sorted_docs.mapInArrow(run, "shard int, file string, n_docs bigint, n_tokens bigint"))


class TokenFile:
    """A token-id file, opened for access to single documents."""

    def __init__(self, file: str, cache: dict | None = None):
        fs, path = filesystem(file)
        self.f = fs.open_input_file(path)
        head = self.f.read_at(14, 0)
        if head[:5] != MAGIC:
            raise ValueError(f"{file} is no token-id file")
        self.width, digest = struct.unpack("<BQ", head[5:])
        n, at = struct.unpack("<QQ", self.f.read_at(16, self.f.size() - 16))
        raw = self.f.read_at(self.f.size() - 16 - at, at)
        self.doc_id = np.frombuffer(raw, "<i8", n)
        self.is_null = np.frombuffer(raw, "u1", n, 8 * n)
        self.offset = np.frombuffer(raw[9 * n : 9 * n + 8 * (n + 1)], "<u8").astype(np.int64)
        self.n_tokens = np.frombuffer(raw[9 * n + 8 * (n + 1) :], "<u8").astype(np.int64)
        cache = {} if cache is None else cache
        if digest and digest not in cache:
            with fs.open_input_stream(f"{path.rpartition('/')[0]}/{digest:016x}.dictionary") as d:
                cache[digest] = d.read()
            if xxhash.xxh64_intdigest(cache[digest]) != digest:
                raise ValueError(f"the dictionary of {file} has another hash")
        given = zstandard.ZstdCompressionDict(cache[digest]) if digest else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=given)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        lo, hi = int(self.offset[i]), int(self.offset[i + 1])
        return np.frombuffer(self.unpack.decompress(self.f.read_at(hi - lo, lo)), f"<u{self.width}")

    def close(self) -> None:
        self.f.close()


def _read(manifest: DataFrame, make, schema: str) -> DataFrame:
    """make(doc_id, start, n_tokens, ids) as a batch, for runs of documents of the manifest's files."""
    small_batches(manifest.sparkSession)
    place = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(place), F.lit(0)))
    files = files.select("file", "start").repartition(partitions(manifest.sparkSession), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = TokenFile(file, cache)
                starts = start + np.append(0, np.cumsum(t.n_tokens)[:-1])
                for lo in range(0, len(t.doc_id), 64):
                    s = slice(lo, min(lo + 64, len(t.doc_id)))
                    ids = [t.ids(i) for i in range(s.start, s.stop)]
                    yield make(pa.array(t.doc_id[s], mask=t.is_null[s].astype(bool)), pa.array(starts[s]), pa.array(t.n_tokens[s]), ids)
                t.close()

    return files.mapInArrow(run, schema)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the manifest's files."""

    def make(doc_id, start, n_tokens, ids: list[np.ndarray]) -> pa.RecordBatch:
        at = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
        lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_id, start, n_tokens, lists], names=["doc_id", "start", "n_tokens", "ids"])

    return _read(manifest, make, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def make(doc_id, start, n_tokens, ids: list[np.ndarray]) -> pa.RecordBatch:
        crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([doc_id, start, n_tokens, crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, make, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
