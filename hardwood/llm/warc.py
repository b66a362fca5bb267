"""WARC archives: a writer, and a splittable reader of archives compressed record by record.

**Writing.** Each task writes one archive, a gzip member a record, to a name of its own and returns a manifest row; only archives
in the manifest count, so a lost or repeated task leaves at most a file that nothing reads.

**Reading.** Files are cut into byte ranges. A task scans its range for the gzip magic, validates a candidate by
decoding its header (it must inflate, to ``WARC/``, and its checksum must hold at its end) and owns the records
that start inside the range, which it follows beyond the range's end. What lies inside a record is skipped. A range
that begins within a record can meet whole WARC members stored in that record's payload; the index of
positions tells them by the end of the records of earlier ranges and leaves them out. The records then
are read at their positions.

Defined cases: null payloads are written as empty; null urls, dates and references are left out of the header; line breaks in a
header value are escaped as in urls; a file without records, or of plain text, gives no rows; bytes that are no
valid member are skipped. A payload must fit in a row (2 GB). Archives must lie where ``pyarrow.fs`` reaches
them: a mounted folder, S3, GCS or HDFS.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialize, remove, shared_dir

MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: The profile that the format's standard names for revisits of equal payloads.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 18
MANIFEST = "file string, bytes long, records long"
_RECORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
                        T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("digest", T.StringType()),
                        T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())])


def _fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _header(name: str, value: str | None) -> str:
    return "" if value is None else f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def member(record_id: str, record_type: str, payload: bytes | None, digest: str | None, target_uri: str | None = None, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only and names the record that it refers to."""
    payload = payload or b""
    http = _HTTP % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = "WARC/1.1\r\n" + "".join(_header(k, v) for k, v in (
        ("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", target_uri),
        ("WARC-Payload-Digest", digest and f"sha256:{digest}"), ("WARC-Profile", _PROFILE if record_type == "revisit" else None), ("WARC-Refers-To", refers_to and f"<{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))))
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + b"\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write_warc(records: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Write ``(record_id, record_type, payload, digest, target_uri, refers_to)`` and return the manifest, a table in the shared folder."""

    def go(batches):
        where, n, size, out = None, 0, 0, None
        for batch in batches:
            cols = [batch.column(c) for c in ("record_id", "record_type", "payload", "digest", "target_uri", "refers_to")]
            for row in range(batch.num_rows):
                if out is None:
                    system, root = _fs(path)
                    system.create_dir(root, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    where, out = f"{path.rstrip('/')}/{name}", system.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                data = member(*[c[row].as_py() for c in cols], level=level)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([size]), pa.array([n])], names=["file", "bytes", "records"])

    return materialize(records.select("record_id", "record_type", F.col("payload").cast("binary").alias("payload"), "digest", "target_uri", "refers_to").mapInArrow(go, MANIFEST))


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes)`` of the archives that a path or pattern names, listed by Spark."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class _Bytes:
    """A file from a position on, read step by step."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, pos: int, most: int) -> bytes:
        """Some bytes from ``pos`` on, up to ``most``; none at the end."""
        if not self.at <= pos < self.at + len(self.held):
            self.at, self.held = pos, self.file.read_at(min(_STEP, max(self.size - pos, 0)), pos) if pos < self.size else b""
        return self.held[pos - self.at : pos - self.at + most]


def _candidate(data: _Bytes, start: int, end: int) -> int:
    """The first place from ``start``, before ``end``, at which the magic stands, or -1."""
    pos = start
    while pos < end:
        piece = data.get(pos, _STEP)
        if 0 < len(piece) < len(MAGIC) and pos + len(piece) < data.size:
            piece += data.get(pos + len(piece), _STEP)
        found = piece.find(MAGIC)
        if found >= 0:
            return pos + found if pos + found < end else -1
        if pos + len(piece) >= data.size:
            return -1
        pos += max(1, len(piece) - len(MAGIC) + 1)
    return -1


def _inflate(data: _Bytes, start: int, sink=None) -> int:
    """The end of the WARC member at ``start``, or -1 where there is none; ``sink`` gets what it holds."""
    unpack, pos, head = zlib.decompressobj(31), start, b""
    try:
        while not unpack.eof:
            piece = data.get(pos, _STEP)
            if not piece:
                return -1
            pos += len(piece)
            while piece and not unpack.eof:
                out = unpack.decompress(piece, _STEP)
                piece = unpack.unconsumed_tail
                if len(head) < 5:
                    head += out[: 5 - len(head)]
                    if not b"WARC/".startswith(head):
                        return -1
                if sink:
                    sink(out)
        return pos - len(unpack.unused_data) if len(head) == 5 else -1
    except zlib.error:
        return -1


def record_index(files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """``(file, range, start, end)`` of every record, a table in the shared folder."""

    def scan(batches):
        for batch in batches:
            for file, size, lo in zip(*[batch.column(c).to_pylist() for c in ("file", "bytes", "range")], strict=True):
                system, name = _fs(file)
                starts, ends = [], []
                with system.open_input_file(name) as f:
                    data, hi = _Bytes(f, size), min(lo + split_bytes, size)
                    pos = _candidate(data, lo, hi)
                    while pos >= 0:
                        end = _inflate(data, pos)
                        if end >= 0:
                            starts.append(pos)
                            ends.append(end)
                        pos = _candidate(data, end if end >= 0 else pos + 1, hi)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts), pa.string()), pa.array([lo] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                                                 names=["file", "range", "start", "end"])

    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("range"))
    count = ranges.count()
    found = materialize(ranges.repartition(max(1, min(count, 100_000))).mapInArrow(scan, "file string, range long, start long, end long"))
    reach = found.groupBy("file", "range").agg(F.max("end").alias("reach"))
    before = F.max("reach").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    reach = reach.select("file", "range", before.alias("before"))
    index = materialize(found.join(reach, ["file", "range"]).where("before is null or start >= before").drop("before"))
    discard(found)
    return index


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    size = fields.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives ``(file, bytes)``: where it starts, ids, type, url, digest, all headers (names in lower case), payload."""
    index = record_index(files, split_bytes)

    def bare(x: str | None) -> str | None:
        return x.removeprefix("<").removesuffix(">") if x is not None else None

    def load(batches):
        opened, data = None, None
        rows, held = [], 0
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                if opened != file:
                    system, name = _fs(file)
                    f = system.open_input_file(name)
                    opened, data = file, _Bytes(f, f.size())
                raw = []
                if _inflate(data, start, raw.append) < 0:
                    raise OSError(f"{file} has changed since it was indexed")
                fields, payload = _parse(b"".join(raw))
                digest = fields.get("warc-payload-digest")
                rows.append((file, start, bare(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")),
                             digest and digest.rpartition(":")[2], list(fields.items()), payload))
                held += len(payload)
                if held > batch_bytes or len(rows) >= 5000:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)

    def pack(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_RECORD.names)

    ranges = index.select("file", "range").distinct().count()
    return index.repartition(max(1, min(ranges, 100_000)), "file", "range").sortWithinPartitions("file", "start").select("file", "start").mapInArrow(load, _RECORD)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 100, id_col: str = "page_id", url: str = "url", payload: str = "html", level: int = 6) -> DataFrame:
    """Write one record a page and return the manifest. Equal payloads of ``least_bytes`` or more are stored once, with the smallest id.

    Rows that share that smallest id and the payload are responses all; null ids come after all others and,
    if there is no other, are responses.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"))
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    records = rows.join(first, "digest", "left").select(name(F.col("key")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
                                                        "payload", "digest", "target_uri", F.when(again, name(F.col("first"))).alias("refers_to"))
    return write_warc(records, path, level)


def archived_pages(files: DataFrame, id_type: str = "long", split_bytes: int = 16 << 20) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of archives that :func:`archive_pages` wrote.

    Responses are measured from the payload read back, and must agree with their digest; revisits take both from the response they refer to.
    """
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*):[0-9a-f]{64}$", 1), F.lit("null")).cast(id_type)
    read = read_warc(files, split_bytes).select("record_id", "record_type", "refers_to", "digest", F.sha2("payload", 256).alias("read_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    read = materialize(read)
    response = read.where("record_type = 'response'").withColumn("payload_digest", F.when(F.col("digest").eqNullSafe(F.col("read_digest")), F.col("read_digest"))
                                                                 .otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id"))))
    target = response.groupBy(F.col("record_id").alias("target")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisit = read.where("record_type = 'revisit'").select("record_id", "record_type", "refers_to").join(target, F.col("refers_to") == F.col("target"), "left")
    cols = [page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")]
    return response.select(*cols).unionByName(revisit.select(*cols))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder, read the archives back and delete them; one row per page."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = archive_pages(pages, path)
    out = materialize(archived_pages(manifest.select("file", "bytes"), dict(pages.dtypes)["page_id"]))
    remove(spark, path)
    discard(manifest)
    return out


#: The round trip's result in SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
