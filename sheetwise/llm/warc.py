"""WARC archives: one gzip member per record, written and read back in sequence.

Writing: each task writes its pages to archives of its own in a shared folder and returns their
names. A task that runs again writes new files; only the names that the finished table lists are
read, so a lost executor leaves no half archive in the result. An archive is closed at
``ARCHIVE_BYTES``. Payloads of at least ``REVISIT_BYTES`` bytes that occur more than once are
stored once, with the page of the smallest id; other pages refer to that record (``revisit``) and
carry only the HTTP header, whose Content-Length is the length of the payload.

Reading: an archive is decompressed in pieces of 64 KiB and never held whole. A record is framed by
its Content-Length, has to end where its gzip member ends, and its payload has to have the digest
that its header states; anything else raises.

Defined results:

* null html is the empty payload. Null url: no target in the record.
* equal payloads: the smallest page id is the response. Rows that repeat that id are responses,
  too. A null id is never the smallest unless all are null; then all are responses.
* one payload at a time is held whole while it is written or read, so a very long page has to fit into a task.
* an empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import stored
from sheetwise.session import scratch_path

ARCHIVE_BYTES = 1 << 30
REVISIT_BYTES = 100
PIECE = 1 << 16
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the WARC format.
VERSION, END, GZIP = b"WARC/1.1\r\n", b"\r\n\r\n", 31


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _target(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_bytes(page, url, payload: bytes, digest: str, refers_to, revisit: bool, level: int) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    header = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        header.append(f"WARC-Target-URI: {_target(url)}")
    if revisit:
        header.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        header.append(f"WARC-Refers-To: {_name(refers_to)}")
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    head = VERSION + "\r\n".join(header).encode() + END
    return packer.compress(head) + packer.compress(block) + packer.compress(END) + packer.flush()


def _writer(folder: str, level: int):
    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = None

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": name, "records": records}])

        for batch in batches:
            names = ("page_id", "url", "payload", "payload_digest", "refers_to")
            for row in zip(*(batch.column(c) for c in names), strict=True):
                page, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = record_bytes(page, url, payload.encode(), digest, refers_to, refers_to is not None, level)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write ``pages(page_id, url, html)``; returns ``(archive, records)``, one row per file."""
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    first = stored(
        hashed.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
        .filter("pages > 1")
        .select("digest", "first"),
        "first_pages",
    )
    joined = hashed.join(first, F.col("payload_digest") == F.col("digest"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))
    return stored(rows.mapInArrow(_writer(folder, level), "archive string, records bigint"), "manifest")


class _Stream:
    """Bytes of one gzip member after the other."""

    def __init__(self, source):
        self.source, self.raw, self.data = source, b"", b""
        self.member = None

    def _more(self) -> bool:
        """Add decompressed bytes of the present member; False at its end."""
        if self.member.eof:
            return False
        piece = self.raw or self.source.read(PIECE)
        if not piece:
            raise ValueError("the archive ends within a record")
        self.data += self.member.decompress(piece)
        self.raw = self.member.unused_data
        return True

    def next_member(self) -> bool:
        self.raw = self.raw or self.source.read(PIECE)
        if not self.raw:
            return False
        self.member, self.data = zlib.decompressobj(GZIP), b""
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.data:
            if not self._more():
                raise ValueError("a header does not end")
        found, _, self.data = self.data.partition(mark)
        return found

    def pieces(self, length: int):
        while length:
            if not self.data and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.data = self.data[:length], self.data[length:]
            length -= len(piece)
            if piece:
                yield piece

    def end(self) -> None:
        while self._more():
            pass
        if self.data != END:
            raise ValueError("a record does not end with its gzip member")


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def read_records(source):
    """Records of one open archive, in order, as (header fields, payload bytes, payload)."""
    stream = _Stream(source)
    while stream.next_member():
        header = stream.until(END)
        if not header.startswith(VERSION):
            raise ValueError("not a WARC record")
        fields = _fields(header)
        http = stream.until(END)
        length = int(_fields(http)["content-length"])
        stored_bytes = int(fields["content-length"]) - len(http) - len(END)
        digest, parts = hashlib.sha256(), []
        for piece in stream.pieces(stored_bytes):
            digest.update(piece)
            parts.append(piece)
        stream.end()
        stated = fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-type"] == "response" and (length != stored_bytes or digest.hexdigest() != stated):
            raise ValueError(f"the payload of {fields['warc-record-id']} is not what its header states")
        yield fields, length, b"".join(parts)


def _reader(folder: str, payloads: bool, batch_bytes: int = 1 << 24):
    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for fields, length, payload in read_records(source):
                        revisit = fields["warc-type"] == "revisit"
                        row = {
                            "page_id": _page(fields["warc-record-id"]),
                            "payload_bytes": length,
                            "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
                            "record_type": fields["warc-type"],
                            "refers_to": _page(fields["warc-refers-to"]) if revisit else None,
                        }
                        if payloads:
                            row["payload"] = None if revisit else payload.decode()
                        rows.append(row)
                        held += 200 + len(payload) * payloads
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS + _PAYLOAD * payloads))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS + _PAYLOAD * payloads))

    return read


_FIELDS = [
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
]
_PAYLOAD = [("payload", pa.string())]


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the listed archives; null payload for a revisit."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    # as many partitions as archives: the planner would put these few bytes into one task
    dealt = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return dealt.mapInArrow(_reader(folder, payloads), schema + (", payload string" if payloads else ""))


def archive_folder(spark) -> str:
    """A new shared folder with its scheme, as Spark's own writers would complete it: a path without one is on the default
    file system of the cluster."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "warc"))
    qualified = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", qualified)
