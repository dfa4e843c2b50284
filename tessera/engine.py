"""The engine: every command, over one append-only cell log under a folder.

A command is a method; `execute("KvPut", key=..., value=...)` calls it by its command name. Every write
is one append of rows that share a commit version. There is one writer for a folder at a time; readers
are many. The log is partitioned by type, so a command reads its own primitive only. What a command
returns is small (a row, a page, a count); whole results are DataFrames, which `frame` gives.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import (
    AlreadyExists, Conflict, ConstraintViolation, InvalidInput, NotFound, NotImplementedHere, TesseraError, TransactionState, WrongDimension,
)
from tessera.functions import jsonpath, recipes, values
from tessera.operators import branching, cells, documents, events, search, vectors
from tessera.operators import graph as graphs
from tessera.session import cut, ship
from tessera.sources import interchange

VERSION = "0.1.0"
MAIN = "default"
SYSTEM = "_system"
#: Entries that wait to be embedded before a batch is made of them.
EMBED_BATCH = 512
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def branch_id(name: str) -> str:
    """A branch's id: nil for the default branch, the name itself where it is a UUID, else a UUID made from it."""
    if name == MAIN:
        return str(uuid.UUID(int=0))
    try:
        return str(uuid.UUID(name))
    except ValueError:
        return str(uuid.uuid5(NAMESPACE, name))


def command_name(method: str) -> str:
    return "".join(p.capitalize() for p in method.split("_"))


class Engine:
    """A database under `root`. clock gives microseconds. Models are functions that the caller gives: embedder (texts to
    vectors), expander (a query to lines of other queries), reranker (a query and texts to lines of ratings), generator
    (a prompt to an answer)."""

    def __init__(
        self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None,
        expander: Callable[[str], str] | None = None, reranker: Callable[[str, list[str]], str] | None = None, generator: Callable[[str], str] | None = None,
    ):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder
        self.expander, self.reranker, self.generator = expander, reranker, generator
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self.branch, self.space = MAIN, "default"
        self.settings: dict[str, str] = {}
        self._txn: dict | None = None
        self._pending: dict[tuple, None] = {}
        self._commands = {command_name(m): m for m in dir(self) if m[0] != "_" and m not in ("execute", "frame") and callable(getattr(type(self), m, None))}
        try:
            self._head = self._raw().agg(F.max("version")).first()[0] or 0
        except TesseraError:
            self._head = 0
            self._append([(SYSTEM, "default", "branch", MAIN, None, False, None, {"parent": None, "fork": 0, "status": "active", "generation": 0})])

    def execute(self, name: str, **args):
        """Runs the command of that name."""
        if name not in self._commands:
            raise InvalidInput(f"there is no command {name}")
        return getattr(self, self._commands[name])(**args)

    # The log

    def _raw(self) -> DataFrame:
        try:
            return self.spark.read.schema(cells.SCHEMA).parquet(self._folder())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise NotFound(self.root) from e
            raise

    def _files(self):
        """(the file system of the root, the class of its paths)."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _turn(self) -> int:
        """How often the log was compacted: the number of the newest pointer current-<n>."""
        fs, path = self._files()
        found = fs.globStatus(path(f"{self.root}/current-*")) or []
        return max((int(f.getPath().getName().partition("-")[2]) for f in found), default=0)

    def _folder(self, turn: int | None = None) -> str:
        turn = self._turn() if turn is None else turn
        return f"{self.root}/cells" + (f"-{turn:08d}" if turn else "")

    def _append(self, rows: list[tuple]) -> int:
        """Appends (branch, space, type, key, value or None, is_tombstone, ttl_ms, json) rows as one commit.

        Within a transaction the rows wait for its commit, but for those of the system branch."""
        if self._txn is not None and rows[0][0] != SYSTEM:
            self._txn["rows"].update({r[:4]: r for r in rows})
            return self._head
        self._head += 1
        out = self._cells(rows, self._head)
        self.spark.createDataFrame(out, cells.SCHEMA).coalesce(1).write.mode("append").partitionBy("type_tag").parquet(self._folder())
        self._queue(rows)
        return self._head

    def _cells(self, rows: list[tuple], version: int) -> list[tuple]:
        now, out = self.clock(), []
        for branch, space, tag, key, value, dead, ttl, doc in rows:
            kind, text = (("json", jsonpath.canonical(doc)) if doc is not None else (None, None)) if value is None and tag != "kv" else values.encode(value)
            out.append((branch, space, tag, key, version, now, dead, ttl, None if dead else kind, None if dead else text))
        return out

    def _branch_row(self, name: str) -> dict | None:
        row = cells.snapshot(self._raw().where((F.col("type_tag") == "branch") & (F.col("key") == name))).first()
        return json.loads(row["value"]) if row else None

    def _lineage(self, name: str) -> list[tuple[str, int]]:
        out, row = [], self._branch_row(name)
        if row is None:
            raise NotFound(f"there is no branch {name}")
        while row and row["parent"]:
            out.append((row["parent"], row["fork"]))
            row = self._branch_row(row["parent"])
        return out

    def _log(self, tag: str | tuple[str, ...], branch: str | None = None) -> DataFrame:
        """The versions of a type, or of several, as the branch sees them."""
        name = branch or self.branch
        start = (self._branch_row(name) or {}).get("born", 0)
        seen = self._raw().where(F.col("type_tag").isin([tag] if isinstance(tag, str) else list(tag)))
        return cells.fork_view(seen.where((F.col("branch") != name) | (F.col("version") >= start)), self._lineage(name), name)

    def frame(self, tag: str, as_of: int | None = None, branch: str | None = None, space: str | None = None) -> DataFrame:
        """The visible cells of a type in a space, now or at a time."""
        log = self._log(tag, branch).where(F.col("space") == (space or self.space))
        if as_of is not None:
            return cells.as_of(log, as_of)
        if self._txn is None:
            return cells.snapshot(log, now_us=self.clock())
        shown = cells.snapshot(log, self._txn["at"], self.clock())
        mine = [r for r in self._txn["rows"].values() if r[:3] == (branch or self.branch, space or self.space, tag)]
        if not mine:
            return shown
        own = self.spark.createDataFrame(self._cells(mine, self._txn["at"] + 1), cells.SCHEMA)
        return cells.overlay(shown, own.where("NOT is_tombstone"), own.where("is_tombstone"))

    def _one(self, tag: str, key: str, as_of: int | None = None):
        log = self._log(tag).where((F.col("space") == self.space) & (F.col("key") == key))
        if as_of is not None:
            return cells.as_of(log, as_of).first()
        if self._txn is None:
            return cells.snapshot(log, now_us=self.clock()).first()
        name = (self.branch, self.space, tag, key)
        if (own := self._txn["rows"].get(name)) is not None:
            names = [f.split()[0] for f in cells.SCHEMA.split(", ")]
            return None if own[5] else dict(zip(names, self._cells([own], self._txn["at"] + 1)[0]))
        row = cells.snapshot(log, self._txn["at"], self.clock()).first()
        self._txn["reads"].setdefault(name, row["version"] if row else 0)
        return row

    def _doc(self, tag: str, key: str, as_of: int | None = None):
        row = self._one(tag, key, as_of)
        return None if row is None else json.loads(row["value"])

    def _put(self, tag: str, entries: dict[str, object]) -> int:
        return self._append([(self.branch, self.space, tag, k, None, False, None, d) for k, d in entries.items()])

    def _kill(self, tag: str, keys: list[str]) -> int:
        return self._append([(self.branch, self.space, tag, k, None, True, None, None) for k in keys])

    @staticmethod
    def _versioned(row) -> dict | None:
        if row is None:
            return None
        return {"value": values.decode(row["value_type"], row["value"]), "version": row["version"], "timestamp": row["ts_us"]}

    def _prefix(self, tag: str, prefix: str) -> DataFrame:
        self._scanned(tag, prefix)
        return cells.prefix_scan(self.frame(tag), prefix)

    def _scanned(self, tag: str, prefix: str = "", start: str = "", as_of: int | None = None) -> None:
        """Notes that a transaction has read all keys of a type that begin so, from a start on."""
        if self._txn is not None and as_of is None:
            self._txn["scans"].add((self.branch, self.space, tag, prefix, start))

    # Key-value cells

    def kv_put(self, key: str, value, ttl_ms: int | None = None) -> int:
        values.check_key(key)
        values.check(value)
        return self._append([(self.branch, self.space, "kv", key, value, False, ttl_ms, None)])

    def kv_get(self, key: str, as_of: int | None = None) -> dict | None:
        return self._versioned(self._one("kv", key, as_of))

    def kv_delete(self, key: str) -> bool:
        there = self.kv_get(key) is not None
        if there:
            self._kill("kv", [key])
        return there

    def kv_list(self, prefix: str = "", cursor: str | None = None, limit: int = 1000, as_of: int | None = None) -> dict:
        self._scanned("kv", prefix, as_of=as_of)
        rows = cells.page(self.frame("kv", as_of), limit, prefix, cursor).orderBy("key").collect()
        keys = [r["key"] for r in rows]
        return {"keys": keys, "has_more": bool(rows) and rows[0]["has_more"], "cursor": keys[-1] if keys else None}

    def kv_scan(self, start: str | None = None, limit: int | None = None) -> list[tuple]:
        self._scanned("kv", start=start or "")
        return [(r["key"], values.decode(r["value_type"], r["value"])) for r in cells.range_scan(self.frame("kv"), start, limit).collect()]

    def kv_batch_put(self, entries: dict[str, object]) -> list[str | None]:
        errors, good = [], []
        for k, v in entries.items():
            try:
                values.check_key(k)
                values.check(v)
                good.append((self.branch, self.space, "kv", k, v, False, None, None))
                errors.append(None)
            except InvalidInput as e:
                errors.append(str(e))
        if good:
            self._append(good)
        return errors

    def _batch(self, keys: list[str]) -> list:
        wanted = self.spark.createDataFrame(list(enumerate(keys)), "position int, key string")
        return cells.batch_get(self.frame("kv"), F.broadcast(wanted)).orderBy("position").collect()

    def kv_batch_get(self, keys: list[str]) -> list[dict | None]:
        return [self._versioned(r) if r["found"] else None for r in self._batch(keys)]

    def kv_batch_exists(self, keys: list[str]) -> list[bool]:
        return [r["found"] for r in self._batch(keys)]

    def kv_batch_delete(self, keys: list[str]) -> list[bool]:
        found = self.kv_batch_exists(keys)
        if gone := list(dict.fromkeys(k for k, f in zip(keys, found) if f)):
            self._kill("kv", gone)
        return found

    def kv_exists(self, key: str) -> bool:
        return self.kv_get(key) is not None

    def _versions(self, tag: str, key: str) -> list[dict]:
        log = self._log(tag).where((F.col("space") == self.space) & (F.col("key") == key)).orderBy(F.desc("version"))
        return [{**self._versioned(r), "deleted": r["is_tombstone"]} for r in log.collect()]

    def kv_getv(self, key: str) -> list[dict]:
        return self._versions("kv", key)

    def kv_count(self, prefix: str = "") -> int:
        return self._prefix("kv", prefix).count()

    def _sample(self, tag: str, prefix: str, count: int) -> dict:
        rows = self._prefix(tag, prefix)
        return {"total": rows.count(), "items": [(r["key"], values.decode(r["value_type"], r["value"])) for r in cells.sample_even(rows, count).orderBy("key").collect()]}

    def kv_sample(self, prefix: str = "", count: int = 5) -> dict:
        return self._sample("kv", prefix, count)

    # JSON documents

    def json_set(self, key: str, path: str, value) -> int:
        values.check_key(key)
        values.check(value)
        doc = self._doc("json", key)
        try:
            return self._put("json", {key: jsonpath.set_at(doc, jsonpath.parse(path), value)})
        except jsonpath.PathError as e:
            raise InvalidInput(str(e)) from e

    def json_get(self, key: str, path: str = "", as_of: int | None = None):
        doc = self._doc("json", key, as_of)
        return jsonpath.get(doc, jsonpath.parse(path))[1] if doc is not None else None

    def json_delete(self, key: str, path: str = "") -> bool:
        doc = self._doc("json", key)
        if doc is None:
            return False
        steps = jsonpath.parse(path)
        if not steps:
            self._kill("json", [key])
            return True
        there = jsonpath.get(doc, steps)[0]
        try:
            self._put("json", {key: jsonpath.delete_at(doc, steps)})
        except jsonpath.PathError as e:
            raise NotFound(str(e)) from e
        return there

    def json_getv(self, key: str) -> list[dict]:
        return self._versions("json", key)

    def json_exists(self, key: str) -> bool:
        return self._one("json", key) is not None

    def json_batch_set(self, entries: list[tuple]) -> list[str | None]:
        """entries (key, path, value), applied in order; one commit for all that succeed."""
        docs: dict[str, object] = {}
        errors = []
        for key, path, value in entries:
            try:
                values.check_key(key)
                old = docs[key] if key in docs else self._doc("json", key)
                docs[key] = jsonpath.set_at(old, jsonpath.parse(path), value)
                errors.append(None)
            except (InvalidInput, jsonpath.PathError) as e:
                errors.append(str(e))
        if docs:
            self._put("json", docs)
        return errors

    def json_batch_get(self, entries: list[tuple]) -> list:
        return [self.json_get(k, p) for k, p in entries]

    def json_batch_delete(self, entries: list[tuple]) -> list[bool]:
        return [self.json_delete(k, p) for k, p in entries]

    def json_list(self, prefix: str = "", cursor: str | None = None, limit: int = 1000, as_of: int | None = None) -> dict:
        self._scanned("json", prefix, as_of=as_of)
        rows = self.frame("json", as_of)
        some = cells.page(rows, limit, prefix) if cursor is None else cells.page_after_member(rows, limit, cursor, prefix)
        got = some.orderBy("key").collect()
        return {"keys": [r["key"] for r in got], "has_more": bool(got) and got[0]["has_more"]}

    def json_count(self, prefix: str = "") -> int:
        return self._prefix("json", prefix).count()

    def json_sample(self, prefix: str = "", count: int = 5) -> dict:
        return self._sample("json", prefix, count)

    def json_create_index(self, name: str, field_path: str, index_type: str) -> None:
        if index_type not in ("numeric", "tag", "text"):
            raise InvalidInput(f"no index type {index_type}")
        if self._doc("index", name) is not None:
            raise AlreadyExists(f"index {name}")
        self._put("index", {name: {"path": field_path, "kind": index_type}})

    def json_drop_index(self, name: str) -> bool:
        there = self._doc("index", name) is not None
        if there:
            self._kill("index", [name])
        return there

    def json_list_indexes(self) -> list[documents.Index]:
        return [documents.Index(r["key"], (d := json.loads(r["value"]))["path"], d["kind"]) for r in self.frame("index").orderBy("key").collect()]

    def json_search(self, flt=None, sort: str | None = None, descending: bool = False, limit: int = 10) -> list[str]:
        """Documents by a filter over indexed fields, in the order of one."""
        docs = self.frame("json").select(F.col("key").alias("doc_id"), F.col("value").alias("doc"))
        return [r["doc_id"] for r in documents.search(docs, self.json_list_indexes(), flt, sort, descending, limit).collect()]

    # Events

    def _event_log(self, as_of: int | None = None) -> DataFrame:
        schema = "seq bigint, event_type string, payload string, ts_us bigint, prev_hash string, hash string"
        rows = self.frame("event", as_of)
        e = F.from_json("value", schema)
        rows = rows.select("branch", "space", e.alias("e")).select("branch", "space", "e.*")
        return rows if as_of is None else rows.where(F.col("ts_us") <= as_of)

    def event_batch_append(self, entries: list[tuple]) -> list:
        """entries (event_type, payload); each one's sequence, or why it was refused."""
        tail = self._event_log().orderBy(F.desc("seq")).first()
        seq, prev = (tail["seq"], tail["hash"]) if tail else (-1, events.GENESIS)
        good, results, now = [], [], self.clock()
        for kind, payload in entries:
            try:
                text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
                if not isinstance(payload, dict) or not kind or not kind.strip() or len(kind.encode()) > 256:
                    raise ValueError("the payload is no object, or the type no name of at most 256 bytes")
                good.append((len(good), kind, text, now))
                results.append(seq + len(good))
            except ValueError as e:
                results.append(str(e))
        if good:
            rows = events.append((seq, prev), self.spark.createDataFrame(good, "position int, event_type string, payload string, ts_us long")).collect()
            self._put("event", {f"{r['seq']:020d}": r.asDict() for r in rows})
        return results

    def event_append(self, event_type: str, payload: dict) -> int:
        result = self.event_batch_append([(event_type, payload)])[0]
        if isinstance(result, str):
            raise InvalidInput(result)
        return result

    @staticmethod
    def _events(rows: DataFrame) -> list[dict]:
        return [{**r.asDict(), "payload": json.loads(r["payload"])} for r in rows.drop("branch", "space").collect()]

    def event_get(self, sequence: int, as_of: int | None = None) -> dict | None:
        return next(iter(self._events(self._event_log(as_of).where(F.col("seq") == sequence))), None)

    def event_exists(self, sequence: int) -> bool:
        return self.event_get(sequence) is not None

    def event_get_by_type(self, event_type: str, limit: int | None = None, after_sequence: int | None = None, as_of: int | None = None) -> list[dict]:
        return self._events(events.by_type(self._event_log(as_of), event_type, after_sequence, limit))

    def event_len(self, as_of: int | None = None) -> int:
        return events.length(self._event_log(as_of)).first()["n"]

    def _event_page(self, rows: Callable[..., DataFrame], limit: int | None) -> dict:
        got = self._events(rows(limit=None if limit is None else limit + 1))
        shown = got if limit is None else got[:limit]
        return {"events": shown, "has_more": len(got) > len(shown), "cursor": f"seq:{shown[-1]['seq']}" if shown else None}

    def event_range(self, start_seq: int, end_seq: int | None = None, limit: int | None = None, direction: str = "forward", event_type: str | None = None) -> dict:
        return self._event_page(lambda limit: events.by_range(self._event_log(), start_seq, end_seq, event_type, direction == "reverse", limit), limit)

    def event_range_by_time(self, start_ts: int, end_ts: int | None = None, limit: int | None = None, direction: str = "forward", event_type: str | None = None) -> dict:
        page = self._event_page(lambda limit: events.by_time(self._event_log(), start_ts, end_ts, event_type, direction == "reverse", limit), limit)
        last = page["events"][-1:]
        return page | {"cursor": f"ts:{last[0]['ts_us']}:seq:{last[0]['seq']}" if last else None}

    def event_list_types(self, as_of: int | None = None) -> list[str]:
        return sorted(r["event_type"] for r in events.types(self._event_log(as_of)).collect())

    def event_list(self, event_type: str | None = None, limit: int | None = None, as_of: int | None = None) -> list[dict]:
        return self._events(events.by_range(self._event_log(as_of), 0, None, event_type, limit=limit))

    def event_verify_chain(self) -> dict:
        return events.verify_chain(self._event_log()).first().asDict()

    # Vectors

    def vector_create_collection(self, collection: str, dimension: int, metric: str = "cosine") -> int:
        self._no_txn()
        values.check_name(collection)
        if not 0 < dimension <= values.MAX_DIMENSION or metric not in vectors.METRICS:
            raise InvalidInput("no such dimension or metric")
        if self._doc("collection", collection) is not None:
            raise AlreadyExists(f"collection {collection}")
        return self._put("collection", {collection: {"dimension": dimension, "metric": metric}})

    def _collection(self, name: str) -> dict:
        found = self._doc("collection", name)
        if found is None:
            raise NotFound(f"collection {name}")
        return found

    def _vectors(self, collection: str, as_of: int | None = None) -> DataFrame:
        self._collection(collection)
        v = F.from_json("value", "v array<float>, m string, c bigint")
        rows = self._scan("vector", f"{collection}/", as_of).select(F.substring_index("key", "/", -1).alias("vec_key"), "version", "ts_us", v.alias("x"))
        return rows.select("vec_key", F.col("x.v").alias("embedding"), F.col("x.m").alias("metadata"), F.coalesce("x.c", "ts_us").alias("created_us"), F.lit(None).cast("bigint").alias("deleted_us"), "version")

    def _scan(self, tag: str, prefix: str, as_of: int | None = None) -> DataFrame:
        return cells.prefix_scan(self.frame(tag, as_of), prefix)

    def vector_upsert(self, collection: str, key: str, vector: list[float], metadata: dict | None = None) -> int:
        return self.vector_batch_upsert(collection, [(key, vector, metadata)])

    def vector_batch_upsert(self, collection: str, entries: list[tuple]) -> int:
        """entries (key, vector, metadata); one bad vector refuses all."""
        dim = self._collection(collection)["dimension"]
        rows = {}
        for key, vector, metadata in entries:
            values.check_key(key)
            try:
                v = vectors.check(vector, dim)
            except vectors.DimensionMismatch as e:
                raise WrongDimension(str(e)) from e
            except ValueError as e:
                raise InvalidInput(str(e)) from e
            rows[f"{collection}/{key}"] = {"v": v, "m": None if metadata is None else jsonpath.canonical(metadata), "c": self.clock()}
        return self._put("vector", rows)

    @staticmethod
    def _vector(doc: dict | None) -> dict | None:
        return None if doc is None else {"embedding": doc["v"], "metadata": json.loads(doc["m"]) if doc["m"] else None}

    def vector_get(self, collection: str, key: str, as_of: int | None = None) -> dict | None:
        return self._vector(self._doc("vector", f"{collection}/{key}", as_of))

    def vector_getv(self, collection: str, key: str) -> list[dict]:
        return self._versions("vector", f"{collection}/{key}")

    def vector_exists(self, collection: str, key: str) -> bool:
        return self.vector_get(collection, key) is not None

    def vector_delete(self, collection: str, key: str) -> bool:
        return self.vector_batch_delete(collection, [key])[0]

    def vector_batch_get(self, collection: str, keys: list[str]) -> list[dict | None]:
        rows = {r["key"]: json.loads(r["value"]) for r in self.frame("vector").where(F.col("key").isin([f"{collection}/{k}" for k in keys])).collect()}
        return [self._vector(rows.get(f"{collection}/{k}")) for k in keys]

    def vector_batch_delete(self, collection: str, keys: list[str]) -> list[bool]:
        found = [v is not None for v in self.vector_batch_get(collection, keys)]
        if gone := list(dict.fromkeys(k for k, f in zip(keys, found) if f)):
            self._kill("vector", [f"{collection}/{k}" for k in gone])
        return found

    def vector_query(self, collection: str, query: list[float], k: int, filter: list[tuple] = (), metric: str | None = None, as_of: int | None = None) -> list[tuple]:
        """(key, score) of the k nearest; the collection's metric counts, whatever `metric` says."""
        info = self._collection(collection)
        if k == 0:
            return []
        rows = self._vectors(collection, as_of)
        try:
            probe = vectors.check(query, info["dimension"])
        except vectors.DimensionMismatch as e:
            raise WrongDimension(str(e)) from e
        return [(r["vec_key"], r["score"]) for r in vectors.nearest(rows, probe, k, info["metric"], filter).collect()]

    def vector_delete_collection(self, collection: str) -> bool:
        self._no_txn()
        if self._doc("collection", collection) is None:
            return False
        rows = self._scan("vector", f"{collection}/").unionByName(self.frame("collection").where(F.col("key") == collection))
        self._commit_actions(self.branch, rows.select("space", "type_tag", "key", F.lit("delete").alias("action"), "value"))
        return True

    def vector_count(self, collection: str) -> int:
        return self._vectors(collection).count()

    def vector_collection_stats(self, collection: str) -> dict:
        info = self._collection(collection)
        n = self.vector_count(collection)
        return {"name": collection, **info, "count": n, "bytes": 4 * info["dimension"] * n}

    def vector_list_collections(self) -> list[dict]:
        return [self.vector_collection_stats(r["key"]) for r in self.frame("collection").where("NOT startswith(key, '_')").orderBy("key").collect()]

    def vector_sample(self, collection: str, count: int = 5) -> list[dict]:
        some = cells.sample_even(self._scan("vector", f"{collection}/"), count).orderBy("key").collect()
        return [{"key": r["key"].partition("/")[2], **self._vector(json.loads(r["value"]))} for r in some]

    # Branches

    def _system(self, tag: str) -> DataFrame:
        return cells.snapshot(self._raw().where((F.col("branch") == SYSTEM) & (F.col("type_tag") == tag)))

    def _system_put(self, tag: str, key: str, doc) -> int:
        return self._append([(SYSTEM, "default", tag, key, None, doc is None, None, doc)])

    def branch_create(self, branch_id: str | None = None, metadata=None, _parent: str | None = None) -> dict:
        self._no_txn()
        name = values.check_name(branch_id or str(uuid.uuid4()))
        if self._branch_row(name) is not None:
            raise AlreadyExists(f"branch {name}")
        log = self._raw().where((F.col("type_tag") == "branch") & (F.col("key") == name) & ~F.col("is_tombstone"))
        generation = log.count()
        self._system_put("branch", name, {"parent": _parent, "fork": self._head if _parent else 0, "status": "active", "generation": generation, "born": self._head + 1, "metadata": metadata})
        return self.branch_get(name)

    def branch_get(self, branch: str | None = None) -> dict | None:
        row = self._branch_row(branch or self.branch)
        return None if row is None else {"name": branch or self.branch, "id": branch_id(branch or self.branch), **row}

    def branch_list(self, state: str | None = None, limit: int | None = None, offset: int = 0) -> list[dict]:
        rows = [{"name": r["key"], "id": branch_id(r["key"]), **json.loads(r["value"])} for r in self._system("branch").orderBy("key").collect()]
        rows = [r for r in rows if state is None or r["status"] == state][offset:]
        return rows if limit is None else rows[:limit]

    def branch_exists(self, branch: str) -> bool:
        return self._branch_row(branch) is not None

    def branch_delete(self, branch: str) -> None:
        self._no_txn()
        if branch == MAIN or branch == self.branch:
            raise ConstraintViolation("neither the default branch nor the current one can be deleted")
        if not self.branch_exists(branch):
            raise NotFound(f"branch {branch}")
        self._system_put("branch", branch, None)

    def branch_fork(self, source: str, destination: str, message: str | None = None, creator: str | None = None) -> dict:
        if not self.branch_exists(source):
            raise NotFound(f"branch {source}")
        return self.branch_create(destination, {"message": message, "creator": creator}, _parent=source)

    def branch_use(self, branch: str) -> None:
        self._no_txn()
        if not self.branch_exists(branch):
            raise NotFound(f"branch {branch}")
        self.branch = branch

    _MERGED = ("kv", "json", "event", "vector", "collection", "graph", "node", "edge", "object_type", "link_type")

    def _snapshot(self, branch: str, version: int | None = None, as_of: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        log = branching.among(self._log(self._MERGED, branch), keys)
        return cells.as_of(log, as_of) if as_of is not None else cells.snapshot(log, version, self.clock())

    def _touched(self, a: str, b: str) -> DataFrame | None:
        """The keys that either branch wrote since they parted; None if they share no past."""
        chains = []
        for name in (a, b):
            chain = {name: self._head}
            for parent, fork in self._lineage(name):
                chain[parent] = min(fork, *chain.values())
            chains.append(chain)
        born = {n: self.branch_get(n).get("born", 0) for n in (a, b)}  # what an earlier branch of that name wrote is not its own
        shared = {n: (born.get(n, 0), min(c[n] for c in chains)) for n in chains[0] if n in chains[1]}
        return branching.touched(self._log(self._MERGED, a), self._log(self._MERGED, b), shared) if shared else None

    def branch_diff(self, branch_a: str, branch_b: str, filter_primitives: list[str] | None = None, filter_spaces: list[str] | None = None, as_of: int | None = None) -> DataFrame:
        keys = self._touched(branch_a, branch_b)
        out = branching.diff(self._snapshot(branch_a, as_of=as_of, keys=keys), self._snapshot(branch_b, as_of=as_of, keys=keys))
        out = out if filter_primitives is None else out.where(F.col("type_tag").isin(filter_primitives))
        return out if filter_spaces is None else out.where(F.col("space").isin(filter_spaces))

    def _merges(self) -> DataFrame:
        rows = [(m["source"], m["target"], m["version"]) for m in (json.loads(r["value"]) for r in self._system("merge").collect())]
        return self.spark.createDataFrame(rows, "source string, target string, version long")

    def branch_merge_base(self, branch_a: str, branch_b: str) -> dict | None:
        rows = [(b["name"], b["parent"], b["fork"]) for b in self.branch_list()]
        lineage = self.spark.createDataFrame(rows, "branch string, parent string, fork_version long")
        row = branching.merge_base(self.spark, lineage, self._merges(), branch_a, branch_b, self._head, self._head).first()
        return row.asDict() if row else None

    def _three(self, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What source and target have in common and what they have now, of the keys that either wrote since the fork."""
        base = self.branch_merge_base(source, target)
        if base is None:
            raise Conflict(f"{source} and {target} have no common past")
        keys = self._touched(source, target)
        return self._snapshot(base["branch"], version=base["version"], keys=keys), self._snapshot(source, keys=keys), self._snapshot(target, keys=keys)

    def branch_diff_three_way(self, branch_a: str, branch_b: str) -> DataFrame:
        return branching.three_way_diff(*self._three(branch_a, branch_b))

    def _commit_actions(self, target: str, actions: DataFrame) -> int:
        """Appends the actions as one commit, without gathering them."""
        self._no_txn()
        self._head += 1
        kind = F.when(F.col("type_tag") == "kv", F.when(F.col("value").startswith('"'), "string").when(F.col("value").startswith("{"), "object").when(F.col("value").startswith("["), "array").when(F.col("value").isin("true", "false"), "bool").when(F.col("value") == "null", "null").when(F.col("value").rlike("^-?[0-9]+$"), "int").otherwise("float")).otherwise("json")
        dead = F.col("action") == "delete"
        for column, given in (("value_type", F.lit(None).cast("string")), ("ttl_ms", F.lit(None).cast("bigint"))):
            if column not in actions.columns:
                actions = actions.withColumn(column, given)
        kind = F.coalesce("value_type", kind)
        rows = actions.select(
            F.lit(target).alias("branch"), "space", "type_tag", "key", F.lit(self._head).cast("bigint").alias("version"), F.lit(self.clock()).alias("ts_us"),
            dead.alias("is_tombstone"), F.when(~dead, F.col("ttl_ms")).alias("ttl_ms"), F.when(~dead, kind).alias("value_type"), F.when(~dead, F.col("value")).alias("value"),
        )
        rows.write.mode("append").partitionBy("type_tag").parquet(self._folder())
        return self._head

    def branch_merge(self, source: str, target: str, strategy: str = "last_writer_wins", message: str | None = None, creator: str | None = None) -> dict:
        self._no_txn()
        anc, src, tgt = self._three(source, target)
        found = branching.classify(anc, src, tgt)
        both = found.where("outcome IN ('source_added', 'target_added', 'both_added_different', 'both_added_same')").groupBy("type_tag").agg(F.count_distinct("outcome").alias("n"))
        if both.where("type_tag = 'event' AND n > 1").count() or found.where("type_tag = 'event' AND outcome = 'both_added_different'").count():
            raise Conflict("both event logs grew since the fork")
        if found.where("type_tag = 'collection' AND outcome IN ('conflict', 'both_added_different')").count():
            raise Conflict("a collection has another dimension or metric on the other branch")
        if not branching.lost_graphs(found).isEmpty():
            raise Conflict("a graph was deleted on one branch and written to on the other")
        try:
            actions = branching.merge(anc, src, tgt, strategy == "strict")
        except branching.MergeConflict as e:
            raise Conflict(str(e)) from e
        conflicts = branching.conflicts(found).count()
        actions = cut(actions)
        self._check_dangling(branching.apply(self._snapshot(target).where("type_tag IN ('node', 'edge')"), actions))
        at = self._head
        version = self._commit_actions(target, actions)
        self._system_put("merge", f"{version:020d}", {"source": source, "target": target, "version": at, "message": message, "creator": creator})
        return {"version": version, "applied": actions.count(), "conflicts": conflicts}

    @staticmethod
    def _check_dangling(merged: DataFrame) -> None:
        part = lambda i: F.split("key", "/")[i]
        nodes = merged.where("type_tag = 'node'").select("space", F.col("key").alias("node"))
        ends = merged.where("type_tag = 'edge'").select("space", F.explode(F.array(F.concat_ws("/", part(0), part(1)), F.concat_ws("/", part(0), part(2)))).alias("node"))
        if not ends.join(nodes, ["space", "node"], "left_anti").isEmpty():
            raise Conflict("an edge would lose a node")

    def branch_revert(self, from_version: int, to_version: int) -> int:
        self._no_txn()
        for tag in self._MERGED:
            log = self._log(tag)
            actions = branching.revert(log, from_version, to_version, cells.alive(self.clock()))
            self._commit_actions(self.branch, actions)
        return self._head

    def branch_cherry_pick(self, source: str, target: str, keys: list[tuple] | None = None, filter_spaces=None, filter_keys=None, filter_primitives=None) -> int:
        self._no_txn()
        if keys is not None:
            actions = branching.cherry_pick(self._snapshot(source), self.spark.createDataFrame(keys, "space string, key string"))
        else:
            actions = branching.pick_actions(branching.merge_actions(branching.classify(*self._three(source, target))), filter_spaces, filter_keys, filter_primitives)
        return self._commit_actions(target, actions)

    def branch_materialize(self, branch: str) -> int:
        """Writes what the branch inherits as rows of its own; it then depends on no parent."""
        snap = self._snapshot(branch).where("origin <> branch").withColumn("action", F.lit("put"))
        self._commit_actions(branch, snap.select("space", "type_tag", "key", "action", *branching.CELL))
        row = self._branch_row(branch)
        return self._system_put("branch", branch, {**row, "parent": None, "fork": 0})

    def branch_export(self, branch_id: str, path: str) -> dict:
        """A folder with the branch's visible cells and a manifest with their count and checksum."""
        snap = self._snapshot(branch_id).drop("origin")
        snap.write.mode("overwrite").parquet(f"{path}/cells")
        manifest = {"branch": branch_id, **self._digest(path)}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        return manifest

    def _digest(self, path: str) -> dict:
        rows = self.spark.read.schema(cells.SCHEMA).parquet(f"{path}/cells")
        r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("space", "type_tag", "key", "value").cast("decimal(38,0)")).alias("s")).first()
        return {"entries": r["n"], "checksum": str(r["s"] or 0)}

    def branch_bundle_validate(self, path: str) -> dict:
        manifest = json.loads(self.spark.read.text(f"{path}/manifest").first()[0])
        found = self._digest(path)
        return {**manifest, "valid": all(manifest[k] == v for k, v in found.items())}

    def branch_import(self, path: str) -> dict:
        info = self.branch_bundle_validate(path)
        if not info["valid"]:
            raise InvalidInput("the bundle's checksum is another")
        self.branch_create(info["branch"])
        rows = self.spark.read.schema(cells.SCHEMA).parquet(f"{path}/cells").withColumn("action", F.lit("put"))
        self._commit_actions(info["branch"], rows.select("space", "type_tag", "key", "action", *branching.CELL))
        return info

    def tag_create(self, name: str, version: int | None = None, message: str | None = None, creator: str | None = None) -> dict:
        doc = {"name": name, "branch": self.branch, "version": self._head if version is None else version, "message": message, "creator": creator, "created": self.clock()}
        self._system_put("tag", f"{self.branch}/{name}", doc)
        return doc

    def _system_doc(self, tag: str, key: str):
        row = self._system(tag).where(F.col("key") == key).first()
        return json.loads(row["value"]) if row else None

    def _system_delete(self, tag: str, key: str) -> bool:
        there = self._system_doc(tag, key) is not None
        if there:
            self._system_put(tag, key, None)
        return there

    def tag_delete(self, name: str) -> bool:
        return self._system_delete("tag", f"{self.branch}/{name}")

    def tag_list(self) -> list[dict]:
        return [json.loads(r["value"]) for r in self._system("tag").where(F.col("key").startswith(f"{self.branch}/")).orderBy("key").collect()]

    def tag_resolve(self, name: str) -> dict | None:
        return self._system_doc("tag", f"{self.branch}/{name}")

    def note_add(self, version: int, message: str, author: str | None = None, metadata=None) -> dict:
        doc = {"version": version, "message": message, "author": author, "metadata": metadata, "created": self.clock()}
        self._system_put("note", f"{self.branch}/{version:020d}", doc)
        return doc

    def note_get(self, version: int | None = None) -> list[dict]:
        prefix = f"{self.branch}/" + ("" if version is None else f"{version:020d}")
        return [json.loads(r["value"]) for r in self._system("note").where(F.col("key").startswith(prefix)).orderBy("key").collect()]

    def note_delete(self, version: int) -> bool:
        return self._system_delete("note", f"{self.branch}/{version:020d}")

    # Transactions: reads see the snapshot and the transaction's own writes. Reads at a time pass it by. What needs
    # whole tables (merges, imports, graph deletion) and what the system branch holds is not part of it.

    def _no_txn(self) -> None:
        if self._txn is not None:
            raise TransactionState("not within a transaction")

    def txn_begin(self, options: dict | None = None) -> None:
        if self._txn is not None:
            raise TransactionState("a transaction is open already")
        self._txn = {"at": self._head, "rows": {}, "reads": {}, "scans": set(), "id": str(uuid.uuid4())}

    def txn_commit(self) -> int:
        """First committer wins: a key that was read, alone or in a scan, and has another version by now aborts. Keys only written never do."""
        if self._txn is None:
            raise TransactionState("no transaction is open")
        txn, self._txn = self._txn, None
        if not txn["rows"]:
            return self._head
        if txn["reads"]:
            seen = self.spark.createDataFrame([(*name, v) for name, v in txn["reads"].items()], "branch string, space string, type_tag string, key string, seen_version long")
            for tag in {name[2] for name in txn["reads"]}:
                if not cells.read_conflicts(seen.where(F.col("type_tag") == tag), cells.snapshot(self._log(tag))).isEmpty():
                    raise Conflict("what the transaction read has changed")
        for branch, space, tag, prefix, start in txn["scans"]:
            log = cells.prefix_scan(self._log(tag, branch), prefix).where((F.col("space") == space) & (F.col("key") >= start))
            newer = log.where(F.col("version") > txn["at"])
            if not newer.join(cells.snapshot(log, txn["at"]), cells.ID, "left_semi").isEmpty():
                raise Conflict("what the transaction scanned has changed")
        return self._append(list(txn["rows"].values()))

    def txn_rollback(self) -> None:
        if self._txn is None:
            raise TransactionState("no transaction is open")
        self._txn = None

    def txn_info(self) -> dict | None:
        return None if self._txn is None else {"id": self._txn["id"], "snapshot": self._txn["at"], "writes": len(self._txn["rows"])}

    def txn_is_active(self) -> bool:
        return self._txn is not None

    # The database

    def retention_apply(self) -> None:
        """Pruning happens in compaction."""

    def retention_stats(self):
        raise NotImplementedHere("RetentionStats")

    def retention_preview(self):
        raise NotImplementedHere("RetentionPreview")

    def ping(self) -> str:
        return VERSION

    def info(self) -> dict:
        return {"version": VERSION, "root": self.root, "head": self._head, "branches": len(self.branch_list())}

    def health(self) -> dict:
        return {"status": "healthy", "log": self._raw().limit(1).count() == 1}

    def metrics(self) -> dict:
        return {"head": self._head, "rows": self._raw().count(), "default_parallelism": self.spark.sparkContext.defaultParallelism}

    def retention_report(self) -> list[dict]:
        """What each branch holds, how much of it other branches see, and what it inherits; deleted branches that others see have no status."""
        live = {b["name"]: b for b in self.branch_list()}
        rows = []
        for name in live:
            bound = self._head
            for parent, fork in self._lineage(name):
                bound = min(bound, fork)
                rows.append((name, parent, bound))
        seen = self.spark.createDataFrame(rows, "branch string, parent string, bound bigint")
        found = cells.retention(self._raw().where(F.col("branch") != SYSTEM), seen).orderBy("branch").collect()
        return [{**r.asDict(), "status": live[r["branch"]]["status"] if r["branch"] in live else None, "inherits": [(p, at) for n, p, at in rows if n == r["branch"]]} for r in found]

    def flush(self) -> None:
        """Every commit is written when it returns; what waits to be embedded is embedded."""
        if not self._pending:
            return
        self._no_txn()
        at = self.branch, self.space
        try:
            for branch, space in dict.fromkeys(name[:2] for name in self._pending):
                names = [name for name in self._pending if name[:2] == (branch, space)]
                if self.branch_exists(branch):
                    self.branch, self.space = branch, space
                    self._embed_rows(self.corpus().where(F.col("doc_ref").isin([ref for *_, ref in names])), "embedded")
                for name in names:
                    del self._pending[name]
        finally:
            self.branch, self.space = at

    def compact(self, floor: int | None = None, max_versions: int | None = None) -> int:
        """Rewrites the log without what pruning drops, in few files. What forks and merges see stays.

        The new log is a folder of its own, which counts from when its pointer is made, in one step; a run that
        breaks off before leaves the old log as it was. The old folder stays until the next compaction, for readers.
        """
        self._no_txn()
        bounds, inheriting = set(), []
        seen = [(b["name"], None) for b in self.branch_list()]
        seen += [(m["source"], m["version"]) for m in (json.loads(r["value"]) for r in self._system("merge").collect())]
        for name, at in seen:
            if at is not None:
                bounds.add((name, at))
            elif self._lineage(name):
                inheriting.append(name)
            for parent, fork in self._lineage(name) if self.branch_exists(name) else []:
                at = fork if at is None else min(at, fork)
                bounds.add((parent, at))
        raw, turn = self._raw(), self._turn()
        mine = raw.where(F.col("branch") != SYSTEM)
        kept = cells.prune(mine, self._head if floor is None else floor, max_versions, self.clock(), sorted(bounds), inheriting)
        kept = kept.unionByName(raw.where(F.col("branch") == SYSTEM))
        fs, path = self._files()
        fs.delete(path(self._folder(turn + 1)), True)  # left by a run that broke off
        kept.write.partitionBy("type_tag").parquet(self._folder(turn + 1))
        fs.createNewFile(path(f"{self.root}/current-{turn + 1}"))
        if turn:
            fs.delete(path(self._folder(turn - 1)), True)
        return self._raw().count()

    def describe(self) -> DataFrame:
        return cells.describe(self._log(self._MERGED))

    def time_range(self) -> dict:
        return cells.time_range(self._raw().where(F.col("branch") == self.branch)).first().asDict()

    def configure_model(self, endpoint: str, model: str, api_key: str | None = None, timeout_ms: int | None = None) -> None:
        self.settings |= {"model.endpoint": endpoint, "model.name": model, "model.timeout_ms": str(timeout_ms or 5000)}

    def config_get(self) -> dict[str, str]:
        return dict(self.settings)

    def configure_set(self, key: str, value: str) -> None:
        self.settings[key] = value

    def configure_get_key(self, key: str) -> str | None:
        return self.settings.get(key)

    def config_set_auto_embed(self, enabled: bool) -> None:
        self.settings["auto_embed"] = str(enabled).lower()

    def auto_embed_status(self) -> bool:
        return self.settings.get("auto_embed") == "true"

    def durability_counters(self) -> dict:
        return {"commits": self._head}

    # Import and export

    def db_export(self, primitive: str, format: str, path: str, prefix: str = "", limit: int | None = None, collection: str | None = None, graph: str | None = None) -> int:
        if primitive == "kv" or primitive == "json":
            rows = cells.prefix_scan(self.frame(primitive), prefix).select(F.col("key").alias("doc_id"), F.col("value").alias("doc"))
            rows = rows if limit is None else rows.orderBy("doc_id").limit(limit)
            out = interchange.kv_table(documents.flatten_export(rows)) if format == "csv" else rows.select(F.col("doc_id").alias("key"), F.col("doc").alias("value"))
        elif primitive == "event":
            out = self._event_log().drop("branch", "space")
        elif primitive == "vector":
            out = self._vectors(collection).select(F.col("vec_key").alias("key"), "embedding" if format != "csv" else F.to_json("embedding").alias("embedding"), "metadata")
        else:
            out = self._edges(graph).select("src", "dst", "edge_type", "weight")
        out = out if limit is None or primitive in ("kv", "json") else out.limit(limit)
        interchange.write(out, path, format)
        return out.count()

    def arrow_import(self, file_path: str, target: str, key_column: str | None = None, value_column: str | None = None, collection: str | None = None, format: str | None = None) -> dict:
        rows = interchange.read(self.spark, file_path, format)
        skipped = interchange.skipped(rows, key_column).first()[0]
        if target == "vector":
            v = interchange.to_vectors(rows, key_column, value_column)
            if self._doc("collection", collection) is None:
                self.vector_create_collection(collection, v.select(F.max(F.size("embedding"))).first()[0])
            body = F.to_json(F.struct(F.col("embedding").alias("v"), F.col("metadata").alias("m"), F.lit(self.clock()).alias("c")))
            actions = v.select(F.concat(F.lit(f"{collection}/"), "vec_key").alias("key"), body.alias("value"))
        elif target == "json":
            actions = interchange.to_documents(rows, key_column, value_column).select("key", F.col("doc").alias("value"))
        else:
            kv = interchange.to_kv(rows, key_column, value_column)
            text = isinstance(kv.schema["value"].dataType.simpleString(), str) and kv.schema["value"].dataType.simpleString() == "string"
            actions = kv.select("key", (F.regexp_replace(F.to_json(F.struct("value")), r'^\{"value":|\}$', "") if text else F.col("value").cast("string")).alias("value"))
        rows = actions.select(F.lit(self.space).alias("space"), F.lit(target).alias("type_tag"), "key", F.lit("put").alias("action"), "value")
        self._commit_actions(self.branch, rows)
        return {"imported": rows.count(), "skipped": skipped}

    # Search

    def corpus(self, as_of: int | None = None) -> DataFrame:
        """(doc_ref, text): what can be found. The reference is kind:key."""
        kv = self.frame("kv", as_of).where("value_type NOT IN ('null', 'bool', 'bytes')").select(F.concat(F.lit("kv:"), "key").alias("doc_ref"), F.when(F.col("value_type") == "string", F.from_json(F.concat(F.lit('{"s":'), "value", F.lit("}")), "s string")["s"]).otherwise(F.col("value")).alias("text"))
        docs = self.frame("json", as_of).select(F.concat(F.lit("json:"), "key").alias("doc_ref"), F.col("value").alias("text"))
        log = self._event_log(as_of).select(F.concat(F.lit("event:"), F.col("seq").cast("string")).alias("doc_ref"), F.concat_ws(" ", "event_type", "payload").alias("text"))
        nodes = self.frame("node", as_of).select(F.concat(F.lit("graph:"), "key").alias("doc_ref"), F.concat_ws(" ", F.substring_index("key", "/", -1), F.col("value")).alias("text"))
        return kv.unionByName(docs).unionByName(log).unionByName(nodes)

    def _lists(self, query: str, plan: dict, weight: float, as_of: int | None, collection: str | None, kinds: tuple[str, ...] = ("bm25", "vector")) -> dict:
        """The ranked lists of one pass of a search, by name, each with its weight."""
        out, weights = {}, plan.get("fusion", {}).get("weights", {})
        b = plan["retrieve"].get("bm25")
        if b is not None and "bm25" in kinds:
            hits = search.bm25(self.corpus(as_of), query, b["k"], b["k1"], b["b"], stem=b.get("stemmer") == "porter")
            out[f"bm25:{query}"] = (hits, weight * weights.get("bm25", 1.0))
        if "vector" in plan["retrieve"] and "vector" in kinds and collection is not None and self.embedder is not None:
            near = vectors.nearest(self._vectors(collection, as_of), self.embedder([query])[0], 50, self._collection(collection)["metric"])
            out[f"vector:{query}"] = (search.ranked(near.select(F.concat(F.lit("vector:"), "vec_key").alias("doc_ref"), "score"), 50), weight)
        return out

    def search(
        self, query: str, recipe: str = "keyword", k: int | None = None, as_of: int | None = None, collection: str | None = None,
        between: tuple[int, int] | None = None, diff: tuple[int, int] | None = None, depth: int = 0,
    ) -> list[dict]:
        """The best hits: doc_ref, score, rank.

        between: of what was last written within the two times. diff: how the result changed between two times.
        depth: so many of the newest versions of each key-value or document hit. A recipe with expansion asks the
        engine's expander unless the first hit stands out; one with rerank asks its reranker.
        """
        if diff is not None:
            a, b = (self._hits(query, recipe, k, t, collection, None) for t in diff)
            return [r.asDict() for r in search.difference(a, b).orderBy("doc_ref").collect()]
        hits = self._hits(query, recipe, k, as_of, collection, between)
        rows = [r.asDict() for r in hits.orderBy("rank").collect()]
        if depth:
            for r in rows:
                kind, _, key = r["doc_ref"].partition(":")
                r["versions"] = self._versions(kind, key)[:depth] if kind in ("kv", "json") else []
        return rows

    def _hits(self, query: str, recipe: str, k: int | None, as_of: int | None, collection: str | None, between: tuple[int, int] | None) -> DataFrame:
        plan = self.recipe_get(recipe)
        if plan is None:
            raise NotFound(f"recipe {recipe}")
        limit, rrf_k = k or plan.get("transform", {}).get("limit", 10), plan.get("fusion", {}).get("k", search.RRF_K)
        lists = self._lists(query, plan, 1.0, as_of, collection)
        more = plan.get("expansion")
        if lists and more and self.expander is not None:
            first = [r["score"] for r in search.rrf(lists, 2, rrf_k).orderBy("rank").collect()]
            if not recipes.strong_signal(first, more["strong_signal_threshold"], more["strong_signal_gap"]):
                lists = self._lists(query, plan, more["original_weight"], as_of, collection)
                for kind, text in recipes.parse_expansion(self.expander(query), query):
                    lists |= self._lists(text, plan, 1.0, as_of, collection, {"lex": ("bm25",), "vec": ("bm25", "vector"), "hyde": ("vector",)}[kind])
        if not lists:
            return self.spark.createDataFrame([], "doc_ref string, score double, rank int")
        top = plan.get("rerank")
        hits = search.rrf(lists, max(limit, top["top_n"]) if top else limit, rrf_k)
        if between is not None:
            hits = self._written_between(hits, *between)
        if top and self.reranker is not None:
            hits = self._rerank(query, hits, top)
        return search.ranked(hits.select("doc_ref", "score"), limit)

    def _written_between(self, hits: DataFrame, start: int, end: int) -> DataFrame:
        """Hits whose newest version lies within the times; events pass."""
        parts = [self.frame(tag).select(F.concat(F.lit(f"{tag if tag != 'node' else 'graph'}:"), "key").alias("doc_ref"), "ts_us") for tag in ("kv", "json", "node")]
        times = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("ts_us").between(start, end))
        events_ = hits.where(F.col("doc_ref").startswith("event:"))
        return hits.join(times.select("doc_ref"), "doc_ref", "left_semi").unionByName(events_)

    def _rerank(self, query: str, hits: DataFrame, top: dict) -> DataFrame:
        some = hits.join(self.corpus(), "doc_ref", "left").orderBy("rank").limit(top["top_n"]).collect()
        if len(some) < top["min_candidates"]:
            return hits
        found = recipes.parse_ratings(self.reranker(query, [r["text"] or "" for r in some]))
        rows = [(some[i - 1]["doc_ref"], v) for i, v in found.items() if 1 <= i <= len(some)]
        tiers = top["blending"]
        return search.blend(hits, self.spark.createDataFrame(rows, "doc_ref string, relevance double"), (tiers["rank_1_3"], tiers["rank_4_10"], tiers["rank_11_plus"]))

    def answer(self, question: str, recipe: str = "rag", collection: str | None = None) -> dict:
        """A generator's answer from the best hits, and the hits that it cites."""
        if self.generator is None:
            raise NotImplementedHere("no generator was given")
        plan = self.recipe_get(recipe)
        hits = [r["doc_ref"] for r in self.search(question, recipe, plan.get("rag_context_hits", 5), collection=collection)]
        texts = {r["doc_ref"]: r["text"] for r in self.corpus().where(F.col("doc_ref").isin(hits)).collect()}
        text = self.generator(recipes.prompt(question, [texts.get(h, "") for h in hits], plan.get("prompt", "")))
        return {"answer": text, "citations": [hits[i - 1] for i in recipes.citations(text, len(hits))]}

    def recipe_set(self, name: str, recipe_json: str) -> None:
        recipe = json.loads(recipe_json)
        if "retrieve" not in recipe:
            raise InvalidInput("a recipe must say what it retrieves")
        self._system_put("recipe", name, recipe)

    def recipe_get(self, name: str) -> dict | None:
        return self._system_doc("recipe", name) or recipes.BUILT_IN.get(name)

    def recipe_get_default(self) -> dict:
        return self.recipe_get("default")

    def recipe_list(self) -> list[str]:
        return sorted({r["key"] for r in self._system("recipe").collect()} | set(recipes.BUILT_IN))

    def recipe_delete(self, name: str) -> bool:
        return self._system_delete("recipe", name)

    def recipe_seed(self) -> int:
        for name, recipe in recipes.BUILT_IN.items():
            self._system_put("recipe", name, recipe)
        return len(recipes.BUILT_IN)

    # Spaces

    def space_list(self) -> list[str]:
        return sorted(r["space"] for r in cells.spaces(cells.snapshot(self._raw().where(F.col("branch") == self.branch))).collect())

    def space_create(self, space: str) -> None:
        self._append([(self.branch, values.check_name(space), "space", space, None, False, None, {})])

    def space_exists(self, space: str) -> bool:
        return space in self.space_list()

    def space_use(self, space: str) -> None:
        self.space = values.check_name(space)

    def space_delete(self, space: str, force: bool = False) -> None:
        if space == "default":
            raise ConstraintViolation("the default space stays")
        rows = cells.snapshot(self._raw().where((F.col("branch") == self.branch) & (F.col("space") == space)))
        if not force and not rows.where("type_tag <> 'space'").isEmpty():
            raise ConstraintViolation(f"space {space} is not empty")
        self._commit_actions(self.branch, rows.select("space", "type_tag", "key", F.lit("delete").alias("action"), "value"))

    # Models: an embedder is given by the caller, generators are not part of the engine

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if self.embedder is None:
            raise NotImplementedHere("no embedder was given")
        return self.embedder(texts)

    def models_list(self) -> list[str]:
        return []

    def models_local(self) -> list[str]:
        return []

    def models_pull(self, name: str):
        raise NotImplementedHere("models are given by the caller")

    def generate(self, model: str, prompt: str, **options) -> str:
        if self.generator is None:
            raise NotImplementedHere("no generator was given")
        return self.generator(prompt)

    def generate_unload(self, model: str) -> bool:
        return False

    def tokenize(self, model: str, text: str, add_special_tokens: bool = False) -> list[int]:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(model).encode(text, add_special_tokens=add_special_tokens).ids

    def detokenize(self, model: str, ids: list[int]) -> str:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(model).decode(ids)

    def _queue(self, rows: list[tuple]) -> None:
        """With auto-embedding, what was committed waits until EMBED_BATCH entries do, or flush is called."""
        if not self.auto_embed_status() or self.embedder is None:
            return
        for branch, space, tag, key, _, dead, *_ in rows:
            if branch != SYSTEM and tag in ("kv", "json", "event") and not dead:
                self._pending[(branch, space, f"{tag}:{int(key) if tag == 'event' else key}")] = None
        if len(self._pending) >= EMBED_BATCH:
            self.flush()

    def embed_status(self) -> dict:
        return {"auto_embed": self.auto_embed_status(), "pending": len(self._pending), "batch_size": EMBED_BATCH}

    def reindex_embeddings(self, collection: str = "embedded") -> int:
        """Embeds everything that can be found, as one collection."""
        return self.vector_count(collection) if self._embed_rows(self.corpus(), collection) else 0

    def _embed_rows(self, corpus: DataFrame, collection: str) -> bool:
        embed, now = self.embedder, self.clock()
        if corpus.isEmpty():
            return False
        if self._doc("collection", collection) is None:
            self.vector_create_collection(collection, len(self.embed("a")))
        ship(self.spark)

        @F.pandas_udf("string")
        def cell(texts: pd.Series) -> pd.Series:
            found = embed([recipes.embedding_text(t) for t in texts])
            return pd.Series([jsonpath.canonical({"v": v, "m": None, "c": now}) for v in found])

        key = F.concat(F.lit(f"{collection}/"), F.translate("doc_ref", "/", ":"))
        rows = corpus.select(F.lit(self.space).alias("space"), F.lit("vector").alias("type_tag"), key.alias("key"), F.lit("put").alias("action"), cell("text").alias("value"))
        self._commit_actions(self.branch, rows)
        return True

    # Graphs

    def graph_create(self, graph: str, cascade_policy: str = "ignore") -> None:
        if cascade_policy not in ("cascade", "detach", "ignore"):
            raise InvalidInput(f"no policy {cascade_policy}")
        if self._doc("graph", values.check_name(graph)) is not None:
            raise AlreadyExists(f"graph {graph}")
        self._put("graph", {graph: {"cascade_policy": cascade_policy, "ontology": "none"}})

    def graph_get_meta(self, graph: str) -> dict | None:
        return self._doc("graph", graph)

    def _graph(self, graph: str) -> dict:
        found = self._doc("graph", graph)
        if found is None:
            raise NotFound(f"graph {graph}")
        return found

    def graph_list(self) -> list[str]:
        return [r["key"] for r in self.frame("graph").orderBy("key").collect()]

    def graph_delete(self, graph: str) -> None:
        self._no_txn()
        self._graph(graph)
        rows = None
        for tag in ("node", "edge", "object_type", "link_type"):
            part = self._scan(tag, f"{graph}/")
            rows = part if rows is None else rows.unionByName(part)
        rows = rows.unionByName(self.frame("graph").where(F.col("key") == graph))
        self._commit_actions(self.branch, rows.select("space", "type_tag", "key", F.lit("delete").alias("action"), "value"))

    def _nodes(self, name: str, as_of: int | None = None) -> DataFrame:
        self._graph(name)
        v = F.from_json("value", "object_type string, properties string, entity_ref string")
        return self._scan("node", f"{name}/", as_of).select(F.split("key", "/")[1].alias("node_id"), v.alias("v")).select("node_id", "v.*")

    def _edges(self, name: str, as_of: int | None = None) -> DataFrame:
        self._graph(name)
        v = F.from_json("value", "weight double, properties string")
        part = lambda i: F.split("key", "/")[i]
        rows = self._scan("edge", f"{name}/", as_of).select(part(1).alias("src"), part(2).alias("dst"), part(3).alias("edge_type"), v.alias("v"))
        return rows.select("src", "dst", "edge_type", "v.*")

    def _types(self, name: str, tag: str) -> DataFrame:
        v = F.from_json("value", "source string, target string, properties string")
        rows = self._scan(tag, f"{name}/").select(F.split("key", "/")[1].alias("name"), v.alias("v"))
        return rows.select("name", "v.*")

    def _check_node(self, graph_name: str, node_id: str, object_type: str | None, properties: dict | None) -> None:
        values.check_name(node_id, values.MAX_KEY)
        if self._graph(graph_name)["ontology"] == "frozen" and object_type is not None:
            kind = self._doc("object_type", f"{graph_name}/{object_type}")
            if kind is None:
                raise ConstraintViolation(f"no object type {object_type}")
            names = {"string": str, "number": (int, float), "boolean": bool}
            for p, rule in json.loads(kind["properties"] or "{}").items():
                value = (properties or {}).get(p)
                if value is None and rule.get("required"):
                    raise ConstraintViolation(f"{p} is missing")
                if value is not None and rule.get("type") in names and not isinstance(value, names[rule["type"]]):
                    raise ConstraintViolation(f"{p} is no {rule['type']}")

    def graph_add_node(self, graph: str, node_id: str, entity_ref: str | None = None, properties: dict | None = None, object_type: str | None = None) -> bool:
        self._check_node(graph, node_id, object_type, properties)
        new = self._doc("node", f"{graph}/{node_id}") is None
        self._put("node", {f"{graph}/{node_id}": {"object_type": object_type, "properties": jsonpath.canonical(properties or {}), "entity_ref": entity_ref}})
        return new

    def graph_get_node(self, graph: str, node_id: str, as_of: int | None = None) -> dict | None:
        self._graph(graph)
        return self._doc("node", f"{graph}/{node_id}", as_of)

    def graph_remove_node(self, graph: str, node_id: str) -> None:
        edges = self._scan("edge", f"{graph}/").where((F.split("key", "/")[1] == node_id) | (F.split("key", "/")[2] == node_id))
        rows = self.frame("node").where(F.col("key") == f"{graph}/{node_id}").unionByName(edges)
        self._commit_actions(self.branch, rows.select("space", "type_tag", "key", F.lit("delete").alias("action"), "value"))

    def _bound_nodes(self, refs: list[str]) -> DataFrame:
        """(node_id: graph/node, entity_ref, policy, value) of the nodes of all graphs that stand for one of the entities."""
        policy = F.get_json_object("value", "$.cascade_policy").alias("policy")
        graphs_ = self.frame("graph").select(F.col("key").alias("graph"), policy)
        nodes = self.frame("node").select(F.col("key").alias("node_id"), F.split("key", "/")[0].alias("graph"), F.get_json_object("value", "$.entity_ref").alias("entity_ref"), "value")
        return nodes.where(F.col("entity_ref").isin(refs)).join(graphs_, "graph", "left").na.fill("ignore", ["policy"])

    def graph_nodes_for_entity(self, entity_ref: str) -> list[tuple[str, str]]:
        return [tuple(r["node_id"].split("/")) for r in self._bound_nodes([entity_ref]).orderBy("node_id").collect()]

    def graph_entities_deleted(self, refs: list[str]) -> int:
        """Entities went: their nodes go with their edges, lose the reference, or stay, as the policy of each graph says."""
        self._no_txn()
        nodes = cut(self._bound_nodes(refs))
        wanted = self.spark.createDataFrame([(r,) for r in refs], "entity_ref string")
        gone = graphs.cascade(nodes.where("policy = 'cascade'"), wanted, "cascade")[0]
        freed = nodes.join(graphs.cascade(nodes.where("policy = 'detach'"), wanted, "detach")[1], "node_id", "left_semi")
        part = lambda i: F.concat_ws("/", F.split("key", "/")[0], F.split("key", "/")[i])
        edges = self.frame("edge").select("key", F.explode(F.array_distinct(F.array(part(1), part(2)))).alias("node_id"))
        edges = edges.join(gone, "node_id", "left_semi").select("key").distinct()
        v = F.from_json("value", "object_type string, properties string")
        free = F.to_json(F.struct(F.lit(None).cast("string").alias("entity_ref"), v["object_type"].alias("object_type"), v["properties"].alias("properties")), {"ignoreNullFields": "false"})
        row = lambda rows, tag, key, action, value: rows.select(F.lit(self.space).alias("space"), F.lit(tag).alias("type_tag"), F.col(key).alias("key"), F.lit(action).alias("action"), value.alias("value"))
        none = F.lit(None).cast("string")
        actions = row(gone, "node", "node_id", "delete", none).unionByName(row(edges, "edge", "key", "delete", none)).unionByName(row(freed, "node", "node_id", "put", free))
        self._commit_actions(self.branch, actions)
        return nodes.count()

    def graph_list_nodes(self, graph: str, as_of: int | None = None) -> list[str]:
        return [r["node_id"] for r in self._nodes(graph, as_of).orderBy("node_id").collect()]

    def graph_list_nodes_paginated(self, graph: str, limit: int, cursor: str | None = None) -> dict:
        rows = cells.page(self._nodes(graph).withColumnRenamed("node_id", "key"), limit, "", cursor).orderBy("key").collect()
        return {"nodes": [r["key"] for r in rows], "has_more": bool(rows) and rows[0]["has_more"]}

    def graph_add_edge(self, graph: str, src: str, dst: str, edge_type: str, weight: float | None = None, properties: dict | None = None) -> None:
        for end in (src, dst):
            if self.graph_get_node(graph, end) is None:
                raise NotFound(f"node {end}")
        values.check_name(edge_type)
        if self._graph(graph)["ontology"] == "frozen":
            link = self._doc("link_type", f"{graph}/{edge_type}")
            kinds = [self.graph_get_node(graph, e)["object_type"] for e in (src, dst)]
            if link is None or any(k is not None and k != link[e] for k, e in zip(kinds, ("source", "target"))):
                raise ConstraintViolation(f"no link {edge_type} between {kinds[0]} and {kinds[1]}")
        self._put("edge", {f"{graph}/{src}/{dst}/{edge_type}": {"weight": 1.0 if weight is None else weight, "properties": jsonpath.canonical(properties or {})}})

    def graph_remove_edge(self, graph: str, src: str, dst: str, edge_type: str) -> bool:
        key = f"{graph}/{src}/{dst}/{edge_type}"
        there = self._doc("edge", key) is not None
        if there:
            self._kill("edge", [key])
        return there

    def graph_neighbors(self, graph: str, node_id: str, direction: str = "outgoing", edge_type: str | None = None, as_of: int | None = None) -> list[tuple]:
        return [tuple(r) for r in graphs.neighbors(self._edges(graph, as_of), node_id, direction, edge_type).orderBy("node_id", "edge_type").collect()]

    def graph_bulk_insert(self, graph: str, nodes: list[dict] = (), edges: list[dict] = (), chunk_size: int | None = None) -> dict:
        """Nodes, then edges, whose ends need not exist."""
        self._no_txn()
        self._graph(graph)
        if nodes:
            self._put("node", {f"{graph}/{values.check_name(n['node_id'], 1024)}": {"object_type": n.get("object_type"), "properties": jsonpath.canonical(n.get("properties") or {}), "entity_ref": n.get("entity_ref")} for n in nodes})
        if edges:
            self._put("edge", {f"{graph}/{e['src']}/{e['dst']}/{e['edge_type']}": {"weight": e.get("weight", 1.0), "properties": jsonpath.canonical(e.get("properties") or {})} for e in edges})
        return {"nodes": len(nodes), "edges": len(edges)}

    def graph_bfs(self, graph: str, start: str, max_depth: int = 100, max_nodes: int | None = 10_000, edge_types: list[str] | None = None, direction: str = "outgoing") -> list[tuple]:
        return [tuple(r) for r in graphs.bfs(self._edges(graph), start, max_depth, max_nodes, edge_types, direction).orderBy("depth", "node_id").collect()]

    def _define(self, tag: str, graph: str, definition: dict) -> None:
        meta = self._graph(graph)
        if meta["ontology"] == "frozen":
            raise ConstraintViolation("the ontology is frozen")
        name = values.check_name(definition["name"])
        doc = {"source": definition.get("source"), "target": definition.get("target"), "properties": jsonpath.canonical(definition.get("properties") or {})}
        self._put(tag, {f"{graph}/{name}": doc})
        if meta["ontology"] == "none":
            self._put("graph", {graph: {**meta, "ontology": "draft"}})

    def _undefine(self, tag: str, graph: str, name: str) -> bool:
        if self._graph(graph)["ontology"] == "frozen":
            raise ConstraintViolation("the ontology is frozen")
        there = self._doc(tag, f"{graph}/{name}") is not None
        if there:
            self._kill(tag, [f"{graph}/{name}"])
        return there

    def graph_define_object_type(self, graph: str, definition: dict) -> None:
        self._define("object_type", graph, definition)

    def graph_get_object_type(self, graph: str, name: str) -> dict | None:
        return self._doc("object_type", f"{graph}/{name}")

    def graph_list_object_types(self, graph: str) -> list[str]:
        return [r["name"] for r in self._types(graph, "object_type").orderBy("name").collect()]

    def graph_delete_object_type(self, graph: str, name: str) -> bool:
        return self._undefine("object_type", graph, name)

    def graph_define_link_type(self, graph: str, definition: dict) -> None:
        self._define("link_type", graph, definition)

    def graph_get_link_type(self, graph: str, name: str) -> dict | None:
        return self._doc("link_type", f"{graph}/{name}")

    def graph_list_link_types(self, graph: str) -> list[str]:
        return [r["name"] for r in self._types(graph, "link_type").orderBy("name").collect()]

    def graph_delete_link_type(self, graph: str, name: str) -> bool:
        return self._undefine("link_type", graph, name)

    def graph_freeze_ontology(self, graph: str) -> None:
        errors = [r["error"] for r in graphs.freeze_errors(self._types(graph, "object_type"), self._types(graph, "link_type")).collect()]
        if errors:
            raise ConstraintViolation("; ".join(errors))
        self._put("graph", {graph: {**self._graph(graph), "ontology": "frozen"}})

    def graph_ontology_status(self, graph: str) -> str:
        return self._graph(graph)["ontology"]

    def graph_ontology_summary(self, graph: str) -> DataFrame:
        return graphs.ontology_summary(self._nodes(graph), self._edges(graph), self._types(graph, "object_type"), self._types(graph, "link_type"))

    def graph_list_ontology_types(self, graph: str) -> list[str]:
        return sorted([*self.graph_list_object_types(graph), *self.graph_list_link_types(graph)])

    def graph_nodes_by_type(self, graph: str, object_type: str) -> list[str]:
        return [r["node_id"] for r in self._nodes(graph).where(F.col("object_type") == object_type).orderBy("node_id").collect()]

    def _groups(self, labels: DataFrame, label: str, top_n: int, include_all: bool) -> dict:
        out = {"groups": [r.asDict() for r in graphs.group_summary(labels, label, top_n).orderBy(F.desc("size"), label).collect()]}
        return out | ({"all": labels} if include_all else {})

    def graph_wcc(self, graph: str, top_n: int = 10, include_all: bool = False) -> dict:
        return self._groups(graphs.wcc(self._nodes(graph), self._edges(graph)), "component", top_n, include_all)

    def graph_cdlp(self, graph: str, max_iterations: int, direction: str = "outgoing", top_n: int = 10, include_all: bool = False) -> dict:
        return self._groups(graphs.cdlp(self._nodes(graph), self._edges(graph), max_iterations, direction), "label", top_n, include_all)

    def _scores(self, scores: DataFrame, column: str, top_n: int, include_all: bool, ascending: bool = False) -> dict:
        order = F.asc(column) if ascending else F.desc(column)
        top = [tuple(r) for r in scores.orderBy(order, "node_id").limit(top_n).collect()]
        return {"top": top, "distribution": graphs.score_distribution(scores, column).first().asDict()} | ({"all": scores} if include_all else {})

    def graph_pagerank(self, graph: str, damping: float = 0.85, max_iterations: int = 20, tolerance: float = 1e-6, top_n: int = 10, include_all: bool = False) -> dict:
        rank, n = graphs.pagerank(self._nodes(graph), self._edges(graph), damping, max_iterations, tolerance)
        return {"iterations": n, "converged": n < max_iterations} | self._scores(rank, "rank", top_n, include_all)

    def graph_lcc(self, graph: str, top_n: int = 10, include_all: bool = False) -> dict:
        found = graphs.lcc(self._nodes(graph), self._edges(graph))
        row = found.agg(F.avg("lcc").alias("mean"), F.count_if(F.col("lcc") == 0).alias("zero")).first()
        return {"global": row["mean"], "zero_count": row["zero"]} | self._scores(found, "lcc", top_n, include_all)

    def graph_sssp(self, graph: str, source: str, direction: str = "outgoing", top_n: int = 10, include_all: bool = False) -> dict:
        return self._scores(graphs.sssp(self._edges(graph), source, direction), "distance", top_n, include_all, ascending=True)
