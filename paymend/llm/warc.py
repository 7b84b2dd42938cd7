"""WARC archives, index first.

Tasks write one archive file each to shared storage and return, per record, file, offset,
length, url and digest. That index is stored before anything is read. A read picks index rows,
sorts them by file and offset, and joins neighbouring byte ranges into one request.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from paymend.llm.batches import chunks, emit, raw
from paymend.sources.scratch import materialise, scratch_dir

#: Bytes between two records that are read rather than skipped, and the largest request.
GAP, REQUEST = 64 * 1024, 8 * 1024 * 1024
#: An archive file is closed beyond this size.
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """(one gzip member, payload digest). A revisit has no payload; its header still tells size and digest."""
    name = digest(payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), f"WARC-Date: {DATE}".encode()]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode())
    if url is not None:
        # Everything but printable ASCII is escaped, so no url can break a header line.
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''), errors='surrogatepass')}".encode())
    head += [f"WARC-Payload-Digest: sha1:{name}".encode(), f"X-Payload-Length: {len(payload)}".encode()]
    if revisit:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>".encode())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush(), name


def parse(data: bytes) -> dict:
    """The fields of one gzip member. ``intact``: lengths, and for a response the digest, agree with the content."""
    content = zlib.decompress(data, 31)
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.decode().split(": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, name, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    page = re.fullmatch(r"<urn:page:(-?\d*)>", fields["WARC-Record-ID"])[1]
    to = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    whole = rest[len(block) :] == b"\r\n\r\n" and (kind == "revisit" or (len(payload) == size and digest(payload) == name))
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": int(page) if page else None, "url": None if url is None else unquote(url, errors="surrogatepass"), "record_type": kind,
        "refers_to": int(to[1]) if to else None, "payload_bytes": size, "payload_digest": name, "payload": payload if kind == "response" else None, "intact": whole,
    }


def _planned(pages: DataFrame, smallest: int) -> DataFrame:
    """Adds ``revisit`` and ``refers_to``. Only groups of two rows or more come out of the count."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    # Two digests of the payload, and its length, stand for it; only they are counted and shuffled.
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html"))
    known = rows.where(F.col("size") >= smallest).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    out = rows.join(known.where("copies > 1").drop("copies"), "sha", "left")
    # Rows that repeat the largest page_id all stay responses; a null page_id is the smallest.
    revisit = F.coalesce(F.col("size") >= smallest, F.lit(False)) & F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, smallest: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder``; returns the stored index.

    Of rows with equal payloads of at least ``smallest`` bytes the one with the largest page_id
    is a response and the others revisit it. Null html is an empty payload. A null url gives a
    record without target. A task that is run again writes a new file; the index only names
    files of tasks that ended well. Other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, path, offset = None, "", 0
        try:
            for batch in chunks(batches, "html"):
                if out is None or offset > FILE_BYTES:
                    if out is not None:
                        out.close()
                    path, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(path, compression=None)
                rows = []
                for page, url, html, revisit, to in zip(*(batch.column(c).to_pylist() if c != "html" else raw(batch, c) for c in ("page_id", "url", "html", "revisit", "refers_to"))):
                    data, name = record(page, url, html, to, revisit)
                    out.write(data)
                    rows.append((page, url, path, offset, len(data), name, "revisit" if revisit else "response"))
                    offset += len(data)
                yield emit(_INDEX, **dict(zip(_INDEX.names, zip(*rows))))
        finally:
            if out is not None:
                out.close()

    rows = _planned(pages, smallest).mapInArrow(write, "page_id long, url string, file string, offset long, length long, digest string, record_type string")
    return materialise(rows, "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` rows point to, payload and all, read in coalesced ranges."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            spans = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            at = 0
            while at < len(spans):
                file, start, length = spans[at]
                stop, upto = start + length, at + 1
                while upto < len(spans) and spans[upto][0] == file and spans[upto][1] - stop <= GAP and spans[upto][1] + spans[upto][2] - start <= REQUEST:
                    stop, upto = max(stop, spans[upto][1] + spans[upto][2]), upto + 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(file)
                data = source.read_at(stop - start, start)
                rows = [parse(data[o - start : o - start + n]) for _, o, n in spans[at:upto]]
                yield emit(_RECORD, **{f: [r[f] for r in rows] for f in _RECORD.names})
                at = upto
        if source is not None:
            source.close()

    # Ranges of (file, offset) put neighbours into one task; a large file is shared among several.
    order = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return order.mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean")


def round_trip(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write all rows of ``pages`` to archives in shared storage and read every record back."""
    folder = scratch_dir(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    return read_records(write_archives(pages, folder, smallest), folder)
