"""WARC archives: write, normalise whole-file gzip streams, read by offset.

Archives often come as one gzip stream over a whole file, which can only be
read from its start.  The normaliser inflates such a stream once, rewrites every
record as a gzip member of its own and writes an index of offsets beside it;
from then on any record is one seek away.

Files live in a folder that all executors share.  A task writes under a name
of its own and the driver goes on with the names of finished tasks only, so a
task that is run again leaves nothing half-written in the result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import stored
from ledgerline.session import scratch_path

#: Payloads of fewer bytes are never made revisits.
MIN_REVISIT = 0
LEVEL = 4
#: Bytes of an archive beyond which its task goes on with another.
ARCHIVE_BYTES = 256 << 20
_CHUNK = 1 << 20
_DATE = "1970-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, original_digest: str | None = None
) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but the digest and length of the full one."""
    digest = original_digest or base32_sha1(payload)
    revisit = refers_to is not None
    content = b"" if revisit else payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}:{digest}')}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Fields", json.dumps({"page_id": page_id, "url": url, "refers_to": refers_to})),
        ("Content-Length", str(len(content))),
    ]
    if revisit:
        headers.insert(1, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    return head.encode("utf-8") + b"\r\n" + content + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    content = rest[: int(headers["Content-Length"])]
    if len(content) != int(headers["Content-Length"]) or not head.startswith(b"WARC/"):
        raise ValueError("broken WARC record")
    return headers, content


def _inflated(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a bounded piece at a time.

    Zero bytes after a member are padding.  A member that ends before its
    checksum, or does not match it, is an error.
    """
    inflate = None
    data = stream.read(_CHUNK)
    while data:
        if inflate is None:
            data = data.lstrip(b"\0") or stream.read(_CHUNK)
            if not data or data[0] == 0:
                continue
            inflate = zlib.decompressobj(31)
        piece = inflate.decompress(data, _CHUNK)
        if piece:
            yield piece
        if inflate.eof:
            data, inflate = inflate.unused_data or stream.read(_CHUNK), None
        else:
            data = inflate.unconsumed_tail or stream.read(_CHUNK)
    if inflate is not None:
        # What is left inside goes out a piece at a time, too: only the end may need no more input.
        while piece := inflate.decompress(b"", _CHUNK):
            yield piece
        if not inflate.eof:
            raise ValueError("gzip stream ends early")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream; no more than one record and one piece is held."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (head := held.find(b"\r\n\r\n", at)) >= 0:
            length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", held[at:head])
            if not length:
                raise ValueError("WARC record without a length")
            end = head + 8 + int(length[1])
            if len(held) < end:
                break
            yield bytes(held[at:end])
            at = end
        del held[:at]
    if bytes(held).strip():
        raise ValueError("WARC stream ends inside a record")


def normalise_file(source: str, target: str) -> list[tuple[int, int]]:
    """Rewrite one archive record by record; (offset, length) of every member.

    The source may be one gzip stream or many members.  The index is written
    beside the target as lines of ``offset length record-id``.
    """
    places: list[tuple[int, int]] = []
    lines = []
    fs_in, path_in = _open(source)
    fs_out, path_out = _open(target)
    with fs_in.open_input_stream(path_in, compression=None) as stream, fs_out.open_output_stream(path_out, compression=None) as out:
        offset = 0
        for data in split_records(_inflated(stream)):
            member = gzip.compress(data, LEVEL, mtime=0)
            out.write(member)
            places.append((offset, len(member)))
            lines.append(f"{offset} {len(member)} {parse(data)[0]['WARC-Record-ID']}\n")
            offset += len(member)
    with fs_out.open_output_stream(path_out + ".idx", compression=None) as index:
        index.write("".join(lines).encode())
    return places


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with payload (bytes) and refers_to.

    Of equal payloads of ``min_bytes`` or more the row with the smallest page_id
    is the response, the others refer to it.  Payloads meet by digest and
    length: one row per payload is joined back, so copies never gather.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("n"))
    first = narrow.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    first = first.where((F.col("rows") > 1) & (F.col("n") >= min_bytes)).select("sha", "n", "first")
    rows = rows.withColumns({"sha": F.sha1("payload"), "n": F.length("payload")})
    joined = rows.join(first, ["sha", "n"], "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (page_id, url, payload, refers_to) as whole-file gzip streams; (path, records) per file.

    A task writes one file after the other, each of about ``ARCHIVE_BYTES`` at most.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def closed():
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": n}])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to")]
            for row in zip(*columns, strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    files, name = _open(path)
                    files.create_dir(name.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(name, compression=None)
                data = deflate.compress(record(*row))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(records.mapInArrow(write, "path string, records long"), "archives")


def one_file_a_task(rows: DataFrame) -> DataFrame:
    """``rows`` (path, ...) in as many partitions as files, in ranges of path; the number is given, so few bytes stay in many tasks."""
    return rows.repartitionByRange(max(1, rows.select("path").distinct().count()), "path")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each file of ``archives`` (path): (path, offset, length) of every record in the new files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                files, name = _open(folder)
                files.create_dir(name, recursive=True)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                places = normalise_file(source, target)
                for a in range(0, len(places), 50_000):
                    part = places[a : a + 50_000]
                    yield pa.RecordBatch.from_pydict(
                        {"path": [target] * len(part), "offset": [o for o, _ in part], "length": [n for _, n in part]}
                    )

    return stored(one_file_a_task(archives.select("path")).mapInArrow(run, "path string, offset long, length long"), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) by seeking to each indexed member.

    A response whose payload does not match its digest is an error; revisits
    have a null html.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stream = None, None
        for batch in batches:
            rows = []
            size = 0
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in ("path", "offset", "length")), strict=True):
                if path != held:
                    files, name = _open(path)
                    held, stream = path, files.open_input_file(name)
                headers, content = parse(gzip.decompress(stream.read_at(length, offset)))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                response = headers["WARC-Type"] == "response"
                if response and base32_sha1(content) != digest:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                row = json.loads(headers["X-Fields"])
                row |= {"payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": digest}
                row |= {"record_type": headers["WARC-Type"], "html": content.decode("utf-8") if response else None}
                rows.append(row)
                size += len(content)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _READ)

    ordered = one_file_a_task(index.select("path", "offset", "length")).sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("html", pa.string()),
    ]
)


def _with_scheme(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark resolves it by, so that tasks write where Spark would."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    written = stored(spark.range(1), "warc-root").inputFiles()[0]
    scheme, _, rest = written.partition(":")
    host = rest[2:].partition("/")[0] if rest.startswith("//") else ""
    return f"{scheme}://{host}/{folder.lstrip('/')}"


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` as archives, normalise them and read them back: one row per page, see ``read_records``.

    A null html is an empty payload; equal empty payloads are revisits too.  A
    null page_id never is the smallest.  Rows that repeat the smallest page_id
    and its payload are all responses.  An empty table writes no file and gives
    an empty result.  Other columns are ignored.  ``folder`` is the shared
    scratch folder unless named; it gets ``raw`` and ``records``.  Without a scheme
    it lies in the file system where Spark writes its scratch tables.
    """
    folder = _with_scheme(pages.sparkSession, folder or scratch_path(pages.sparkSession, "warc"))
    written = write_archives(record_types(pages, min_bytes), f"{folder}/raw")
    return read_records(normalise_archives(written, f"{folder}/records"))
