"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the request, the response (or a revisit that refers to the response
with the same payload) and metadata. Request and response name each other's capture through
WARC-Concurrent-To: the request points to the response, the metadata to the request.

Archives are gzip files with a member for each record, of FILE_BYTES of payload or a little more.
Files are written under a task's own name and then renamed, so that a task that runs again
replaces its files.

A response that others refer to is named by its page and payload, so that each revisit knows its
record id. Where several rows have the smallest page_id of a payload none is the one referred to:
the revisits then give the page in their metadata and the payload's digest only.

Null html is an empty payload, a null url gives no target. Rows without page_id are written, and
are responses. Rows that share page_id and payload are all responses if theirs is the smallest
page_id of the payload, else revisits. An empty table makes no archives. Only page_id, url and html
are read, so that other columns may have any names. A very long payload is held by one task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, partitions, small_batches

FILE_BYTES = 64 << 20
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "record_id string, kind string, concurrent_to string, target_uri string, payload_bytes bigint, payload_digest string, "
    "refers_to string, fields map<string,string>, payload binary"
)


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _capture(place: str, page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, sole: bool) -> bytes:
    """first: the smallest page of a payload that several pages have; sole: whether one row alone has that page."""
    name = f"urn:capture:{'' if page is None else page}:{place}"
    known = f"urn:capture:{first}:{digest}:answer" if sole else None
    own = known if known and page == first else f"{name}:answer"
    target = [("WARC-Target-URI", _clean(url))] if url else []
    digests = [("WARC-Payload-Digest", f"sha256:{digest}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http_type = [("Content-Type", "application/http; msgtype=response")]
    if first is None or page is None or page <= first:
        fields = ""
        answer = _record("response", own, [*target, *digests, *http_type], http + payload)
    else:
        fields = f"refersToPage: {first}\r\n"
        refers = [("WARC-Profile", REVISIT_PROFILE), *([("WARC-Refers-To", f"<{known}>")] if known else [])]
        answer = _record("revisit", own, [*target, *digests, *refers, *http_type], http)
    request = _record(
        "request", f"{name}:request", [*target, ("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/http; msgtype=request")],
        f"GET {_clean(url or '/')} HTTP/1.1\r\n\r\n".encode(),
    )
    fields += f"pageId: {'' if page is None else page}\r\npayloadLength: {len(payload)}\r\n"
    about = _record("metadata", f"{name}:metadata", [("WARC-Concurrent-To", f"<{name}:request>"), ("Content-Type", "application/warc-fields")], fields.encode())
    return request + answer + about


def write_warc(pages: DataFrame, path: str, min_bytes: int = 100) -> DataFrame:
    """Writes a capture for every row of `pages` (page_id, url, html); one row (file, n_captures) an archive.

    Of rows with equal payloads of at least min_bytes bytes all but that with the smallest page_id are revisits.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("payload"))
    slim = slim.withColumn("digest", F.sha2("payload", 256))
    shared = (
        slim.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
        .groupBy("digest").agg(F.min(F.struct("page_id", "n")).alias("low"), F.max("page_id").alias("last")).where("low.page_id < last")
        .select("digest", F.col("low.page_id").alias("first"), (F.col("low.n") == 1).alias("sole"))
    )
    marked = slim.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", "first", F.coalesce("sole", F.lit(False)).alias("sole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        shard, made, out = TaskContext.get().partitionId(), f"{root}/.{uuid.uuid4().hex}", []
        f, held, rows, at = None, 0, 0, 0

        def close() -> None:
            f.close()
            name = f"{shard:06d}-{len(out):04d}.warc.gz"
            fs.move(made, f"{root}/{name}")
            out.append((f"{path}/{name}", rows))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if f is None:
                    f, held, rows = fs.open_output_stream(made), 0, 0
                f.write(_capture(f"{shard}-{at}", *row))
                held, rows, at = held + len(row[2]), rows + 1, at + 1
                if held >= FILE_BYTES:
                    close()
                    f = None
        if f is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["file", "n_captures"])

    return cut(marked.mapInArrow(run, "file string, n_captures bigint"))


def archives(spark, glob: str) -> DataFrame:
    """(file) of the archives that a path or pattern names."""
    return spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"))


def _parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an open archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives (file), gzipped or plain: RECORD. Digests are those of the payloads read;
    a revisit, which has none, keeps the one that its header gives."""
    small_batches(files.sparkSession)
    spec = files.select("file").repartition(partitions(files.sparkSession), "file")
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()])))

    def rows(file: str) -> Iterator[tuple]:
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
            for head, block in _parse(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)):
                kind, payload, fields = head.get("warc-type"), block, None
                if head.get("content-type", "").startswith("application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                elif head.get("content-type") == "application/warc-fields":
                    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
                    fields = list(dict(fields).items())
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if kind == "revisit":
                    size, digest = None, head.get("warc-payload-digest", "").rpartition(":")[2] or None
                bare = [head.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")]
                yield bare[0], kind, bare[1], head.get("warc-target-uri"), size, digest, bare[2], fields, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for b in batches:
            for file in b.column(0).to_pylist():
                for r in rows(file):
                    held.append(r)
                    weight += len(r[8] or b"")
                    if len(held) >= 1000 or weight >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return spec.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id (its response's or revisit's record id), request, response, metadata.

    A record belongs to the response that it is concurrent to, or that the request it is concurrent
    to belongs to. Of several requests or metadata records of a capture the smallest id counts;
    records that lead to no response make no capture.
    """
    answers = records.where("kind IN ('response', 'revisit')").withColumn("anchor", F.col("record_id"))
    requests = records.where("kind = 'request'").withColumn("anchor", F.col("concurrent_to"))
    about = records.where("kind = 'metadata'")
    via = requests.select(F.col("record_id").alias("concurrent_to"), F.col("anchor").alias("by_request"))
    # Sizes after Python are guesses from the list of files; merge hints keep those guesses from choosing a broadcast.
    about = about.join(via.hint("merge"), "concurrent_to", "left").withColumn("anchor", F.coalesce("by_request", "concurrent_to"))
    whole = F.struct("record_id", "kind", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload")
    fields = F.struct("record_id", F.map_entries("fields").alias("fields"))

    def one(df: DataFrame, value, name: str) -> DataFrame:
        return df.where("anchor IS NOT NULL").groupBy("anchor").agg(F.min_by(value, "record_id").alias(name))

    joined = (
        one(answers, whole, "response")
        .join(one(requests, whole, "request").hint("merge"), "anchor", "left")
        .join(one(about, fields, "m").hint("merge"), "anchor", "left")
    )
    metadata = F.struct(F.col("m.record_id").alias("record_id"), F.map_from_entries("m.fields").alias("fields"))
    return joined.select(F.col("anchor").alias("capture_id"), "request", "response", F.when(F.col("m").isNotNull(), metadata).alias("metadata"))
