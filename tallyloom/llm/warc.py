"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records, then a seek table in
a skippable frame at the end (compressed and uncompressed size of every frame, then the number of frames,
a descriptor and a magic number). An index row maps a record to (bundle, frame, offset within the uncompressed
frame, length), so one record is read with one small read and one frame's decompression.

Rows with equal payloads of at least `min_bytes` bytes are written once: the row with the largest page_id is the
response, the others revisit it. Rows that repeat both page_id and payload are all responses if theirs is the
largest page_id. Null page_ids count as smaller than all; where a payload has null page_ids only, all its rows are
responses. A null payload is an empty one. Null urls give records without a target. An empty table gives no bundle.

Bundles go to a folder given as a URI that all executors share. A task names its files by stage attempt, and
only the index rows of tasks that succeeded are kept. Index rows are shuffled by record, not in turn, so a map task that
runs again after its output is lost sends each record to where it was before. So retried and speculative tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

READ_FRAMES = 64
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tallyloom/warc")
INDEX = "page_id long, record_id string, bundle string, frame int, at int, length int"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {payload_digest}')}"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """The record's id and bytes. refers_to: the page_id of the response if this is a revisit."""
    sha = digest(payload)
    rid = record_id(page_id, sha)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", len(payload))]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "%" + c.encode().hex("%").upper() for c in url)))
    if refers_to is None:
        block = HTTP_HEAD + payload
        fields.append(("Content-Type", "application/http;msgtype=response"))
    else:
        block = b""
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, sha)}>"), ("X-Refers-To-Page-ID", refers_to)]
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return rid, head.encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    n = int(fields["X-Payload-Length"]) if payload is None else len(payload)
    if payload is not None and digest(payload) != sha:
        raise ValueError("the payload doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": sha, "payload_bytes": n, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_TABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of every frame of a seekable file."""
    size = file.size()
    n, descriptor, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEK_TABLE_MAGIC:
        raise ValueError("no seek table at the end")
    each = 12 if descriptor & 0x80 else 8
    raw, at, out = file.read_at(n * each, size - 9 - n * each), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * each)
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(pages: DataFrame, uri: str, min_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27, level: int = 3) -> DataFrame:
    """Write pages (page_id, url, html) under uri; the index, which must be kept as it is evaluated only once."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("_n", F.octet_length("html"))
    # who revisits whom is decided on digests alone; payloads are joined by page, so equal ones don't meet in one task
    keys = rows.filter(F.col("_n") >= min_bytes).select("page_id", "_sha")
    top = keys.groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_low"), F.count("*").alias("_all"), F.count("page_id").alias("_known"))
    top = top.filter((F.col("_low") < F.col("refers_to")) | (F.col("_known") > 0) & (F.col("_known") < F.col("_all"))).select("_sha", "refers_to")
    revisits = keys.distinct().join(top, "_sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_page"), F.col("_sha").alias("_same"), "refers_to")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_same")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        task, press, n_files = TaskContext.get(), zstandard.ZstdCompressor(level=level), 0
        out, name, frames, index, plain, waiting, written = None, "", [], [], [], 0, 0

        def end_frame():
            nonlocal waiting, written
            if plain:
                packed = press.compress(b"".join(plain))
                out.write(packed)
                frames.append((len(packed), waiting))
                written += len(packed)
                plain.clear()
                waiting = 0

        def end_bundle():
            nonlocal out
            if out is not None:
                end_frame()
                out.write(seek_table(frames))
                out.close()
                out = None
                done = [dict(x, bundle=name) for x in index]
                index.clear()
                frames.clear()
                for i in range(0, len(done), 10000):
                    yield pa.RecordBatch.from_pylist(done[i : i + 10000], schema)

        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int32()), ("length", pa.int32())])
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(c)[i].as_py() for c in ("page_id", "url", "html", "refers_to")}
                rid, data = encode_record(x["page_id"], x["url"], x["html"].encode(), x["refers_to"])
                if out is None:
                    name, written = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{n_files:04d}.warc.zst", 0
                    out, n_files = fs.open_output_stream(f"{root}/{name}", compression=None), n_files + 1
                index.append({"page_id": x["page_id"], "record_id": rid, "frame": len(frames), "at": waiting, "length": len(data)})
                plain.append(data)
                waiting += len(data)
                if waiting >= frame_bytes:
                    end_frame()
                if written >= bundle_bytes:
                    yield from end_bundle()
        yield from end_bundle()

    return rows.mapInArrow(write, INDEX)


def dealt(index: DataFrame) -> DataFrame:
    """Index rows in few partitions by record: where a row goes doesn't change with the attempt that wrote its bundle."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8
    return index.repartition(max(4, n), "record_id")


def read_bundles(index: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, frame by frame. Each task has whole runs of READ_FRAMES frames of a bundle."""
    index = index.withColumn("run", F.floor(F.col("frame") / READ_FRAMES))
    n_runs = index.select("bundle", "run").distinct().count()
    frames = index.repartition(max(1, n_runs), "bundle", "run").groupBy("bundle", "run", "frame").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("records"))
    names = [x.split()[0] for x in RECORD.split(", ")][: None if with_payload else -1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        unpress, name, file, table = zstandard.ZstdDecompressor(), None, None, []
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", ")) if n in names])
        for b in batches:
            for x in b.to_pylist():
                if x["bundle"] != name:
                    name, file = x["bundle"], fs.open_input_file(f"{root}/{x['bundle']}")
                    table = read_seek_table(file)
                at, packed, plain = table[x["frame"]]
                data = unpress.decompress(file.read_at(packed, at), max_output_size=plain)
                found = [decode_record(data[r["at"] : r["at"] + r["length"]]) for r in x["records"]]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in found], schema)

    schema = ", ".join(x for x in RECORD.split(", ") if x.split()[0] in names)
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(read, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import few, fresh_path, table, written

    uri = fresh_path(spark, "warc")
    index = written(spark, dealt(write_bundles(table(spark, sf_dir, "pages"), uri)), "warc-index")
    return few(read_bundles(index, uri, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(1, 41), lambda i:
    (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])
    [strpos('0123456789abcdef', substr(hex, CAST(i AS BIGINT), 1))]), '') AS b FROM p),
coded AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * CAST(substr(b, CAST(5 * i + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(b, CAST(5 * i + 2 AS BIGINT), 1) AS INTEGER)
      + 4 * CAST(substr(b, CAST(5 * i + 3 AS BIGINT), 1) AS INTEGER) + 2 * CAST(substr(b, CAST(5 * i + 4 AS BIGINT), 1) AS INTEGER)
      + CAST(substr(b, CAST(5 * i + 5 AS BIGINT), 1) AS INTEGER), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS top FROM bits)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top OR top IS NULL THEN NULL ELSE top END AS refers_to
FROM coded
"""
