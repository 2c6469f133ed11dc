"""Operator 10. Monolithic gzip normaliser for WARC.

A WARC file that is one gzip stream can't be read from the middle. ``normalise`` inflates each such file once, as a
stream, rewrites every record as a gzip member of its own, and writes a sidecar index ``<file>.cdxj`` beside it, one JSON
line for each record with its offset and compressed length. One task reads one file, in pieces of bounded size whatever
the size of a record; files are the unit of parallelism. Output names carry a random part and reach the result only from the
attempt that Spark accepts, so a lost executor or a second attempt leaves no half-written file in it.

``write_monolithic`` makes such files from pages, and ``fetch`` reads single records by offset.

Defined cases: a NULL url gives a record without WARC-Target-URI; NULL html an empty payload; a NULL page_id a record
without a page id; repeated rows are records of their own; members concatenated in a file are read as one stream; a
record whose stream ends early, whose Content-Length is missing or no number, or whose header has no end within ``HEAD`` bytes raises
an error; other columns take no part; an empty table gives no file and an empty index.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import scratch_path, small_batches, written

PIECE = 1 << 20
#: The longest header of a record.
HEAD = 1 << 20
LEVEL = 6
FILES = "path string, records bigint, raw_bytes bigint"
INDEX = "page_id bigint, url string, record_type string, file string, record bigint, offset bigint, length bigint, payload_bytes bigint"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Each partition of ``pages`` as one WARC file in one gzip stream; (path, records, raw_bytes) of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, raw, path = None, 0, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            if out is None and len(b):
                fs, p = _fs(path)
                fs.create_dir(p.rpartition("/")[0], recursive=True)
                out, gz = fs.open_output_stream(p, compression=None), zlib.compressobj(LEVEL, wbits=31)
            for page_id, url, html in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                r = _record(page_id, url, html)
                n, raw = n + 1, raw + len(r)
                out.write(gz.compress(r))
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "raw_bytes": [raw]})

    small_batches(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return written(slim.mapInArrow(run, FILES), "warc-files")


class _Inflated:
    """A stream of inflated bytes, read by header and by length. What is read moves a mark; the buffer is cut a piece at a time."""

    def __init__(self, source):
        self.source, self.z, self.buffer, self.at = source, zlib.decompressobj(31), bytearray(), 0
        self.rest, self.began, self.done = b"", False, False

    def _more(self) -> bool:
        while not self.done:
            data = self.rest or self.source.read(PIECE)
            self.rest = b""
            if not data:
                if self.began and not self.z.eof:
                    raise EOFError("the gzip stream ends early")
                self.done = True
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.began = True
            got = self.z.decompress(data, PIECE)
            self.rest = self.z.unconsumed_tail or self.z.unused_data
            if got:
                if self.at >= PIECE or self.at == len(self.buffer):
                    del self.buffer[: self.at]
                    self.at = 0
                self.buffer += got
                return True
        return False

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", self.at + max(0, seen - 3))) < 0:
            seen = len(self.buffer) - self.at
            if seen > HEAD:
                raise ValueError(f"a record's header has no end within {HEAD} bytes")
            if not self._more():
                if self.buffer[self.at :].strip():
                    raise EOFError("a record's header ends early")
                return None
        out, self.at = bytes(self.buffer[self.at : end + 4]), end + 4
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.buffer) and not self._more():
                raise EOFError("a record ends early")
            piece = bytes(self.buffer[self.at : self.at + n])
            self.at += len(piece)
            n -= len(piece)
            yield piece


def _length(fields: dict[str, str]) -> int:
    n = fields.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        raise ValueError(f"a record without a valid Content-Length: {n!r}")
    return int(n)


def records(source) -> Iterator[tuple[bytes, dict[str, str], Callable[[], Iterator[bytes]]]]:
    """(header bytes, header fields by lower-case name, reader of the payload and its end) of each record of an inflated stream."""
    s = _Inflated(source)
    while (raw := s.head()) is not None:
        raw = raw.lstrip(b"\r\n")
        fields = {}
        for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            if k:
                fields[k.strip().lower()] = v.strip()
        yield raw, fields, lambda n=_length(fields): s.take(n + 4)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite the files in column ``path`` record by record; the index rows of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, p = _fs(path)
                name = f"{folder}/{p.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                to, q = _fs(name)
                to.create_dir(q.rpartition("/")[0], recursive=True)
                rows: list[tuple] = []
                at = n = 0
                with fs.open_input_stream(p, compression=None) as source, to.open_output_stream(q, compression=None) as out, to.open_output_stream(q + ".cdxj", compression=None) as side:
                    for raw, fields, payload in records(source):
                        gz = zlib.compressobj(LEVEL, wbits=31)
                        size = 0
                        for piece in itertools.chain((raw,), payload()):
                            c = gz.compress(piece)
                            out.write(c)
                            size += len(c)
                        c = gz.flush()
                        out.write(c)
                        size += len(c)
                        page = fields.get("warc-record-id", "").removeprefix("<urn:page:").removesuffix(">")
                        row = (int(page) if page.lstrip("-").isdigit() else None, fields.get("warc-target-uri"), fields.get("warc-type"), name, n, at, size, _length(fields))
                        side.write((json.dumps({"url": row[1], "type": row[2], "offset": at, "length": size}) + "\n").encode())
                        rows.append(row)
                        at, n = at + size, n + 1
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                if rows:
                    yield _rows(rows)

    # a task for each file, however small the table of their names is
    spread = files.select("path").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, INDEX)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4]
    out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in INDEX.split(", ")])
    rows.clear()
    return out


def fetch(index: DataFrame) -> DataFrame:
    """(page_id, url, html) of index rows, each read at its offset alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            page, url, html = b.column("page_id").to_pylist(), b.column("url").to_pylist(), []
            for name, at, n in zip(*[b.column(c).to_pylist() for c in ("file", "offset", "length")]):
                if name not in opened:
                    fs, p = _fs(name)
                    opened = {name: fs.open_input_file(p)}
                raw = zlib.decompress(opened[name].read_at(n, at), wbits=31)
                html.append(raw[raw.index(b"\r\n\r\n") + 4 : -4].decode())
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(html, pa.string())], ["page_id", "url", "html"])

    return index.mapInArrow(run, "page_id bigint, url string, html string")


def normalised_pages(pages: DataFrame) -> DataFrame:
    """Pages written as monolithic WARC files, then normalised: the index of all records."""
    spark = pages.sparkSession
    files = write_monolithic(pages, scratch_path(spark, "warc-mono"))
    return written(normalise(files, scratch_path(spark, "warc")), "warc-index")
