"""WARC archives: a deterministic sharded writer and a reader that checks digests.

Records are in the order of page id, url and payload digest, and a shard begins
wherever the bytes before it in that order pass a multiple of ``shard_bytes``.
So shards depend on the data alone, not on how Spark happens to deal rows, and
are of like size however ids are spread; only rows alike in all three columns
stay together.  Within a shard files roll when their compressed size reaches
``roll_bytes``; one record never spans files.  Headers and digests are
generated anew for every record.

Each task writes to names with an id of the attempt and reports its files; when
all are written, tasks move the files of successful attempts to their final
names, and then the manifest is written, also by a move.  Readers take only files that the manifest
lists, so a lost executor or a broken run leaves nothing that is read.

Edge cases: null html is an empty payload; a null url leaves out the target; a
null page id leaves out the id, and such a record is a revisit only if its
payload has a record with an id.  Rows that repeat id and payload are all
responses if their id is the largest.  An empty table gives an archive without
files.  A payload of any length is one record, held as a whole by the task that
writes it.  Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, scratch, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "manifest.json"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A whole record; refers_to: the page whose response holds the same payload."""
    sha1 = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    heads = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha1)), ("WARC-Date", DATE)]
    if url is not None:
        heads.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if refers_to is None:
        block += payload
    else:
        heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        heads.append(("X-Page", str(page_id)))
    heads += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("X-Payload-Bytes", str(len(payload))),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record at the head of each file."""
    block = b"format: WARC File Format 1.1\r\n"
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream; a broken record raises ValueError."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        heads: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            heads[key.lower()] = value.strip()
        size = int(heads["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield heads, block


def _order(page: int | None, url: str | None, body: str) -> tuple:
    """Sorts as Spark sorts: nulls first, texts by code points."""
    return page is not None, page or 0, url is not None, url or "", body


def shard_bounds(keyed: DataFrame, shard_bytes: int) -> list[tuple]:
    """The least record, by _order, of each shard but the first; as many rows come to the driver as there are shards and partitions."""
    names = ["page_id", "url", "body"]
    rows = keyed.select(*names, (F.octet_length("html") + 600).cast("long").alias("size"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names).withColumn("part", F.spark_partition_id())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            total = before + size.cumsum()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), batch.column("part"), pa.array(total - size), pa.array(size)], [*names, "part", "before", "size"])
            before = int(total[-1]) if len(total) else before

    rows = table(rows.mapInArrow(summed, "page_id long, url string, body string, part int, before long, size long"), "order")
    base, total = {}, 0
    for r in rows.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():
        base[r["part"]], total = total, total + r["size"]
    if total <= shard_bytes:
        return []
    offsets = F.broadcast(keyed.sparkSession.createDataFrame(list(base.items()), "part int, base long"))  # a row for each partition
    first = rows.join(offsets, "part").groupBy(F.floor((F.col("base") + F.col("before")) / shard_bytes).alias("shard")).agg(F.min(F.struct(*names)).alias("k"))
    return sorted({_order(*r["k"]) for r in first.collect()})[1:]


def write_archive(pages: DataFrame, path: str, shard_bytes: int = 1 << 25, roll_bytes: int = 1 << 25, least_revisit: int = 0) -> list[dict]:
    """Writes a record for each row of pages below path, a folder that executors share; returns the manifest's files."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("body", F.sha2("html", 256))
    same = keyed.where(F.octet_length("html") >= least_revisit).groupBy("body").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    same = table(same.select("body", "first"), "payloads")
    bounds = shard_bounds(keyed, shard_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "body")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, _order(*k)) for k in keys], pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    dealt = keyed.mapInArrow(deal, "shard int, page_id long, url string, html string, body string")
    dealt = dealt.join(same, "body", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    dealt = dealt.select("shard", "page_id", "url", "html", "refers_to").repartition("shard").sortWithinPartitions("shard", "page_id", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        attempt, out, done = uuid.uuid4().hex, None, []
        at, number, written, held, sha = None, 0, 0, 0, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done[-1] |= {"bytes": written, "records": held, "sha256": sha.hexdigest()}
                out = None

        for batch in batches:
            for shard, page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at or written >= roll_bytes:
                    close()
                    at, number = shard, number + 1 if shard == at else 0
                if out is None:
                    name = f"{shard:06d}-{number:05d}.warc.gz"
                    done.append({"name": name, "temporary": f"_{attempt}-{name}"})
                    out = store.open_output_stream(f"{folder}/_{attempt}-{name}", compression=None)
                    data = member(info(name))
                    sha, written, held = hashlib.sha256(data), len(data), 0
                    out.write(data)
                data = member(record(page, url, html.encode(), refers))
                out.write(data)
                sha.update(data)
                written, held = written + len(data), held + 1
        close()
        keys = ("name", "temporary", "bytes", "records", "sha256")
        if done:
            yield pa.RecordBatch.from_pylist([{k: d[k] for k in keys} for d in done])

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    written = table(dealt.mapInArrow(write, "name string, temporary string, bytes long, records long, sha256 string"), "files")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if store.get_file_info(f"{folder}/{temporary}").type != fs.FileType.NotFound:  # else an attempt before this one has moved it
                    store.move(f"{folder}/{temporary}", f"{folder}/{name}")
            yield batch

    moved = written.mapInArrow(move, written.schema).drop("temporary")
    files = sorted((r.asDict() for r in moved.collect()), key=lambda f: f["name"])  # one row for each file
    with store.open_output_stream(f"{folder}/_{MANIFEST}") as out:
        out.write(json.dumps({"files": files}, indent=1).encode())
    store.move(f"{folder}/_{MANIFEST}", f"{folder}/{MANIFEST}")
    return files


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files that the manifest lists; see READ.  Digests that do not hold raise."""
    prepare(spark)
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
        files = json.loads(f.read())["files"]
    if not files:
        return spark.createDataFrame([], READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))) as stream:
                    for heads, block in records(stream):
                        if heads["warc-type"] == "warcinfo":
                            continue
                        payload, sha1 = block.partition(b"\r\n\r\n")[2], heads["warc-payload-digest"].removeprefix("sha1:")
                        whole = heads["warc-type"] == "revisit" or (digest(payload) == sha1 and len(payload) == int(heads["x-payload-bytes"]))
                        if not whole or digest(block) != heads["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a record does not have its digest")
                        page, refers = heads.get("x-page"), heads.get("x-refers-to-page")
                        rows.append((page and int(page), int(heads["x-payload-bytes"]), sha1, heads["warc-type"], refers and int(refers), heads.get("warc-target-uri"), name.rpartition("/")[2]))
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    found = spark.read.format("binaryFile").load([f"{path}/{f['name']}" for f in files])
    return found.select("path", "content").mapInArrow(read, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as an archive in the shared folder and reads it back."""
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
