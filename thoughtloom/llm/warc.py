"""Web pages as WARC archives, and a reader that splits them.

Writing: every task writes its pages into archives of its own, a gzip member for each record, rolled over at
``archive_bytes``. Names hold a random part, so a second attempt of a task never meets the files of the
first, and only files whose task ended are listed in the manifest. Of equal payloads the one of smallest
page_id is a response; others are revisits, which carry its digest and length but no payload. Which payload is
repeated is found from their hashes alone; pages are joined with those hashes only.

Reading: an archive is cut into byte ranges, each a row that Spark deals out. A task looks for gzip's magic
number from the start of its range, decodes a candidate's beginning, and takes it for a member if a WARC
version line and a header with a length follow and the rest decodes with a right checksum. It owns the
records of members that start in its range, and reads the last one to its end beyond it. A member that
lies within another one (an archive that was stored as a payload) can be taken for a member by a task whose
range starts inside; so the lengths of members must fill each file, and files where they do not are read
again as one range, from the first byte on. Bytes that no member explains are skipped.

Both use Arrow's file systems by URI, so archives can lie wherever these reach; the pages themselves are
read by Spark. Null html is an empty payload. Rows of the smallest page_id that repeat it with an equal payload are
all responses; a null page_id is larger than any. An empty table makes no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, scratch_path, table

#: The format's version line, the profile of a revisit, gzip's magic number with the deflate method.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES, SPLIT_BYTES = 1 << 28, 1 << 24
#: Bytes that are read at once, and within which a record's header must end.
PIECE, HEADER = 1 << 20, 1 << 16

_SPACE = uuid.UUID("9a4c1f0e-6f0d-4f43-9d55-8c1e6f1f7a10")
_FILES = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI and the path on it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    """The same in every attempt, and known to a revisit without a look at the response."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with the payload, or a revisit of the page ``refers_to`` with its HTTP header alone."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = _record_id(page_id, digest) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _record_id(refers_to, digest) if revisit else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Page-ID", None if page_id is None else str(page_id)),
    ]
    return _record(fields, http if revisit else http + payload)


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _writer(folder: str, archive_bytes: int, level: int, date: str):
    """Writes the pages of a task into archives and tells their names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _opened(folder)
        out, told = None, []
        path, size, records = "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns):
                if out is not None and size >= archive_bytes:
                    out.close()
                    told.append((path, size, records))
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(at, recursive=True)
                    out, path, size, records = fs.open_output_stream(f"{at}/{name}", compression=None), f"{folder}/{name}", 0, 0
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(_member(info, level))
                record = page_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                out.write(_member(record, level))
                size, records = out.tell(), records + 1
        if out is not None:
            out.close()
            told.append((path, size, records))
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), _FILES)], schema=_FILES)

    return write


def with_roles(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", body: str = "html") -> DataFrame:
    """``pages`` with ``refers_to``: the smallest page_id of an equal payload, or null for a response."""
    digest, first, refers = fresh([*pages.columns], "digest", "first", "refers_to")
    hashed = pages.withColumn(digest, F.sha2(F.coalesce(F.col(body), F.lit("")), 256))
    long = F.octet_length(F.coalesce(F.col(body), F.lit(""))) >= min_bytes
    repeated = hashed.where(long).groupBy(F.col(digest).alias(digest + "_")).agg(F.min(page_id).alias(first), F.count("*").alias(first + "_")).where(F.col(first + "_") > 1).drop(first + "_")
    joined = hashed.join(repeated, (F.col(digest) == F.col(digest + "_")) & long, "left")
    other = F.when(~F.col(page_id).eqNullSafe(F.col(first)), F.col(first))
    return joined.withColumn(refers, other).drop(digest, digest + "_", first)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 6, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Writes a record for each row of ``pages`` under ``folder``; returns the manifest (path, bytes, records)."""
    read = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(body).alias("html"))
    rows = with_roles(read, min_bytes).select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), "refers_to")
    rows.mapInArrow(_writer(f"{folder}/archives", archive_bytes, level, date), "path string, bytes bigint, records bigint").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


class _Bytes:
    """A file read in pieces, of which the last is kept."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.piece = file, size, 0, b""

    def read(self, begin: int, least: int = 1) -> bytes:
        """What is known from ``begin`` on: ``least`` bytes or more, fewer only at the end of the file."""
        if not self.at <= begin or begin + min(least, self.size - begin) > self.at + len(self.piece):
            self.at, self.piece = begin, self.file.read_at(max(PIECE, least), begin) if begin < self.size else b""
        return self.piece[begin - self.at :]

    def find(self, begin: int, end: int) -> int:
        """Where the magic number starts first in [begin, end), or -1."""
        while begin < end:
            piece = self.read(begin, len(MAGIC))
            hit = piece.find(MAGIC)
            if hit >= 0:
                return begin + hit if begin + hit < end else -1
            begin += max(1, len(piece) - len(MAGIC) + 1)
        return -1


def _decoded(data: _Bytes, begin: int) -> tuple[bytes, int] | None:
    """The content of the member at ``begin`` and where it ends; None if there is none with WARC records."""
    unpacker, out, at, sure = zlib.decompressobj(31), bytearray(), begin, False
    try:
        while not unpacker.eof:
            piece = data.read(at)
            if not piece:
                return None
            out += unpacker.decompress(piece if sure else piece[:4096])
            at += len(piece if sure else piece[:4096])
            if not sure and (len(out) >= HEADER or unpacker.eof or b"\r\n\r\n" in out):
                if _header(out, 0) is None:
                    return None
                sure = True
    except zlib.error:
        return None
    return bytes(out), at - len(unpacker.unused_data)


def _header(data: bytes | bytearray, at: int) -> tuple[dict[str, str], int] | None:
    """The named fields (lower case) of the record at ``at``, and where its block starts."""
    end = data.find(b"\r\n\r\n", at, at + HEADER)
    if end < 0 or not data.startswith(b"WARC/", at):
        return None
    lines = bytes(data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]
    fields: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdecimal() else None


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a member: fields and block. One that is cut off is left out."""
    at = 0
    while (head := _header(content, at)) is not None:
        fields, begin = head
        end = begin + int(fields["content-length"])
        if end > len(content):
            return
        yield fields, content[begin:end]
        at = end
        while content.startswith(b"\r\n", at):
            at += 2


def _http(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and payload of a block; a block without HTTP is its own payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}, payload


_READ = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
_READ_DDL = "path string, offset bigint, length bigint, record_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, payload_bytes bigint, intact boolean, fields map<string,string>, payload binary"


def _row(path: str, offset: int, length: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A record as a row. A revisit tells digest and length of the payload that it does not carry."""
    http, payload = _http(fields, block)
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = fields.get("warc-type", "")
    if kind == "revisit":
        size, digest, intact = http.get("content-length", ""), told, None
        size = int(size) if size.isdecimal() else None
    else:
        size, digest = len(payload), sha1_base32(payload)
        intact = None if told is None else told == digest
    return path, offset, length, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, intact, list(fields.items()), payload if payloads and kind != "revisit" else None


def _scan(payloads: bool):
    """Records of the members that start in the given ranges; ``length`` stands at a member's first record."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                fs, at = _opened(row["path"])
                with fs.open_input_file(at) as file:
                    data, pos = _Bytes(file, row["bytes"]), row["begin"]
                    while (pos := data.find(pos, row["end"])) >= 0:
                        member = _decoded(data, pos)
                        if member is None:
                            pos += 1
                            continue
                        content, end = member
                        for k, (fields, block) in enumerate(_records(content)):
                            rows.append(_row(row["path"], pos, 0 if k else end - pos, fields, block, payloads))
                            held += len(block)
                        pos = end
                        if held > 1 << 24 or len(rows) > 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return scan


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def _ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """(path, bytes, begin, end): the byte ranges of files, dealt out one by one."""
    step = F.lit(split_bytes).cast("bigint")
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, step))
    cut = files.where("bytes > 0").select("path", "bytes", begin.alias("begin")).withColumn("end", F.least(F.col("begin") + step, F.col("bytes")))
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / step)), F.lit(0))).head()[0]
    return cut.repartition(max(1, min(int(n), 100_000)))


def read_archives(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of ``files`` (path, bytes), read in ranges, stored under ``folder``; see ``_READ`` for the columns.

    ``payload_digest`` and ``payload_bytes`` are those of the payload that was read, and of a revisit those
    that it tells; ``intact`` says if the digest that was told is right. Without ``payloads`` the column is null.
    """
    spark = files.sparkSession
    _ranges(files, split_bytes).mapInArrow(_scan(payloads), _READ_DDL).write.parquet(f"{folder}/read")
    rows = spark.read.parquet(f"{folder}/read")
    filled = rows.groupBy("path").agg(F.sum("length").alias("filled"))
    broken = files.join(filled, "path", "left").where("not bytes <=> filled").select("path", "bytes")
    broken.write.parquet(f"{folder}/broken")
    broken = spark.read.parquet(f"{folder}/broken")
    if not broken.head(1):
        return rows
    whole = broken.withColumn("begin", F.lit(0).cast("bigint")).withColumn("end", F.col("bytes")).where("bytes > 0")
    whole.repartition("path").mapInArrow(_scan(payloads), _READ_DDL).write.parquet(f"{folder}/again")
    return rows.join(broken.select("path"), "path", "left_anti").unionByName(spark.read.parquet(f"{folder}/again"))


def resolved(records: DataFrame) -> DataFrame:
    """``records`` of pages with ``page_id`` and, for a revisit, the ``refers_to`` page of the record that it names."""
    pages = records.where("record_type in ('response', 'revisit')").withColumn("page_id", F.col("fields")["page-id"].cast("bigint"))
    named = pages.where("record_type = 'response'").groupBy(F.col("record_id").alias("named")).agg(F.min("page_id").alias("refers_to"))
    return pages.join(named, pages.refers_to_id == F.col("named"), "left").drop("named")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    rows = resolved(read_archives(files, folder, payloads=False))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4)::INTEGER)) & 31), 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h
"""
