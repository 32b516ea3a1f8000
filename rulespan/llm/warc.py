"""Operator 7: WARC archives, and a normaliser of monolithic gzip.

Archives are first written as one gzip stream a file, in scan order, with no
shuffle of payloads.  Which records repeat an earlier payload is decided on
slim rows.  The normaliser then inflates each file's stream once, rewrites
every record as a gzip member of its own (a revisit without its payload), and
writes a sidecar index of offsets, through which records are read back one
by one.

Files go through :mod:`pyarrow.fs` to a folder that all executors share.  A
task attempt writes files of its own name and only those of the attempt that
succeeds are named in the (staged) rows, so retries do no harm.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import shared_dir, stage

LEAST_PAYLOAD = 100
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value: str | None) -> str:
    return " ".join((value or "").split())


def record(kind: str, name: str, page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; its block is an HTTP response, without a body if
    ``payload`` is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:rulespan:{name}>", f"WARC-Date: {DATE}"]
    if _line(url):
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}"]
    if kind == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            head.append(f"Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece."""
    engine = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            out = engine.decompress(chunk, CHUNK)
            if out:
                yield out
            chunk = engine.unconsumed_tail
            if engine.eof:
                chunk, engine = engine.unused_data, zlib.decompressobj(31)
    tail = engine.flush()
    if tail:
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of bytes into whole records; memory is that of one record."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        while (end := buffer.find(b"\r\n\r\n")) >= 0:
            mark = buffer.find(b"\r\nContent-Length: ", 0, end + 2)
            size = end + 4 + int(buffer[mark + 18 : buffer.find(b"\r\n", mark + 2)]) + 4
            if len(buffer) < size:
                break
            yield bytes(buffer[:size])
            del buffer[:size]
    if buffer:
        raise ValueError("the archive ends within a record")


def _chunks(stream) -> Iterator[bytes]:
    while data := stream.read(CHUNK):
        yield data


def write_monolithic(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as single-stream archives.

    Returns a row for each record: file, seq, page_id, size, digest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        name, stream, engine, seq, room, files = "", None, None, 0, 0, 0

        def close() -> None:
            if stream is not None:
                stream.write(engine.flush())
                stream.close()

        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if stream is None or room <= 0:
                    close()
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{files}"
                    stream, engine = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    files, seq, room = files + 1, 0, file_bytes
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                data = record("response", f"{name}:{seq}", page_id, url, len(payload), digest, payload)
                stream.write(engine.compress(data))
                rows.append((name, seq, page_id, len(payload), digest))
                seq, room = seq + 1, room - len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["file", "seq", "page_id", "size", "digest"])
        close()

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(write, "file string, seq int, page_id long, size long, digest string")


def revisits(made: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(file, seq, refers_to) of records whose payload an earlier page has.

    Of equal payloads that of the least page id stays; a missing id comes
    last, and rows of one id follow the order of the archive.
    """
    rows = made.filter(F.col("size") >= least)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "seq")
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    later = rows.join(first, "digest").filter("file != first.file or seq != first.seq")
    return later.select("file", "seq", F.col("first.page_id").alias("refers_to"))


def dealt(files: DataFrame) -> DataFrame:
    """``files`` (staged, a row each) dealt in turn to as many tasks as rows, up
    to ``MOST_TASKS``, whatever their names hash to."""
    return files.repartition(min(MOST_TASKS, max(1, files.count())))


def normalise(made: DataFrame, again: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each file of ``source`` record by record; a row for each file.

    Files are dealt out one to a task; a task holds the revisit list of its
    file, which ``FILE_BYTES`` bounds.
    """
    per_file = again.groupBy("file").agg(F.collect_list(F.struct("seq", "refers_to")).alias("revisits"))
    files = dealt(stage(made.groupBy("file").agg(F.count("*").alias("n")).join(per_file, "file", "left"), "listed"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(source)
        out_store, out_base = fs.FileSystem.from_uri(target)
        out_store.create_dir(out_base)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            done = []
            for name, _, listed in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "revisits"))):
                known = {x["seq"]: x["refers_to"] for x in listed or []}
                out, index, at, seq = f"{name}-{attempt}", [], 0, -1
                with store.open_input_stream(f"{base}/{name}.warc.gz", compression=None) as stream, out_store.open_output_stream(f"{out_base}/{out}.warc.gz", compression=None) as to:
                    for seq, data in enumerate(records(inflate(_chunks(stream)))):
                        if seq in known:
                            fields, _ = parse(data)
                            page = fields.get("Page-Id")
                            data = record("revisit", f"{name}:{seq}", page and int(page), fields.get("WARC-Target-URI"), int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None, known[seq])
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        to.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                with out_store.open_output_stream(f"{out_base}/{out}.idx.json", compression=None) as to:
                    to.write(json.dumps({"archive": f"{out}.warc.gz", "members": index}).encode())
                done.append((out, seq + 1))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64()))], names=["file", "n"])

    return files.select("file", "n", "revisits").mapInArrow(rewrite, "file string, n long")


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """One row for each record of normalised archives, found through their index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "member_offset"]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{base}/{name}.idx.json", compression=None) as stream:
                    members = json.loads(stream.read())["members"]
                rows = []
                with store.open_input_file(f"{base}/{name}.warc.gz") as archive:
                    for at, size in members:
                        archive.seek(at)
                        fields, payload = parse(zlib.decompress(archive.read(size), 31))
                        page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
                        if fields["WARC-Type"] == "response":
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        else:
                            n, digest = int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        rows.append((page and int(page), n, digest, fields["WARC-Type"], refers and int(refers), name, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select("file").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member_offset long")


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_PAYLOAD, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as normalised archives and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to,
    archive, member_offset.  A null html is an empty payload; missing urls and
    ids are left out of the header; an empty table makes no archive and gives
    an empty result; other columns are not read.
    """
    folder = folder or shared_dir(pages.sparkSession)
    made = stage(write_monolithic(pages, f"{folder}/monolithic", file_bytes), "records")
    files = stage(normalise(made, revisits(made, least), f"{folder}/monolithic", f"{folder}/archives"), "files")
    return read_back(dealt(files), f"{folder}/archives")
