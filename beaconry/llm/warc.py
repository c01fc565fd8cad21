"""WARC archives: one gzip member per record, written by tasks and read back sequentially and incrementally.

Archives are read and written through Arrow's file systems, so a folder may be in any store that those open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import batches, cut, shared_folder, table

CHUNK = 1 << 20
ARCHIVE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"  # of every record, so reruns agree
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
FILES = "path string, records long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the payload's length and digest alone."""
    digest = digest_text(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"<{ID}{'' if page_id is None else page_id}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_text(hashlib.sha1(block).digest())}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A record whose framing or digest is wrong."""


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The members of a gzip stream, decompressed as the chunks come. At most one member is held."""
    inflate, out, begun = zlib.decompressobj(wbits=31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            out.append(inflate.decompress(chunk))
            if not inflate.eof:
                break
            yield b"".join(out)
            chunk, inflate, out, begun = inflate.unused_data, zlib.decompressobj(wbits=31), [], False
    if begun:
        raise BadRecord("the archive ends within a record")


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(text: str | None) -> int | None:
    """The page of a record id that this module wrote; ids of other writers name none."""
    name = (text or "").strip("<>")
    return int(name.removeprefix(ID)) if name.startswith(ID) and name.removeprefix(ID).lstrip("-").isdigit() else None


def _verify(stated: str | None, content: bytes, what: str) -> None:
    """A digest is optional, and one of another kind than base32 SHA-1 can't be held against the content."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1" and len(value) == 32 and digest_text(hashlib.sha1(content).digest()) != value.upper():
        raise BadRecord(f"{what} digest")


def parse(record: bytes) -> tuple:
    """A record as RECORDS has it; framing is verified, and so are digests and lengths where they are stated.

    Responses and revisits hold HTTP messages, whose body is the payload; of other types (``resource``, ``warcinfo``,
    ``request``, ``metadata``, ...) it is the whole block. A revisit has no payload of its own: its length and digest are
    those stated, null where nothing is.
    """
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = _fields(lines)
    if not gap or not version.startswith(b"WARC/") or not fields.get("content-length", "").isdigit() or not fields.get("warc-type"):
        raise BadRecord("no WARC header")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadRecord("content length and record differ")
    _verify(fields.get("warc-block-digest"), block, "block")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest")
    payload, length = block, size
    if kind == "revisit" or kind == "response" and block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = _fields(http.split(b"\r\n")[1:]).get("content-length", "")
        length = int(stated) if stated.isdigit() else None if kind == "revisit" else len(payload)
        if kind == "response" and length != len(payload):
            raise BadRecord("HTTP length and payload differ")
    if kind == "revisit":
        payload = None
    else:
        _verify(digest, payload, "payload")
        digest = digest or "sha1:" + digest_text(hashlib.sha1(payload).digest())
    return (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")),
            length, digest and digest.partition(":")[2], payload)


def read_chunks(path: str) -> Iterator[bytes]:
    store, name = _open(path)
    with store.open_input_stream(name, compression=None) as f:
        while chunk := f.read(CHUNK):
            yield chunk


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives at ``path``; an archive is read in turn by one task, chunk by chunk."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("payload", pa.binary())])
        for b in source:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                for m in members(read_chunks(path)):
                    r = parse(m)
                    rows.append(r if payloads else (*r[:-1], None))
                    held += len(r[-1] or b"") if payloads else 0
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.select("path").mapInArrow(run, RECORDS)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to, revisit) rows; returns the written list of archives.

    A task's archives carry a name of their own attempt, and only those of the attempt that Spark commits are
    listed, so a repeated or lost task leaves no doubled record.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, size, count, done = None, 0, 0, []

        def close():
            nonlocal out, size, count
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}-{len(done):05d}.warc.gz", count))
            out, size, count = None, 0, 0

        for b in batches(source, "payload"):
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}-{len(done):05d}.warc.gz", compression=None)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = deflate.compress(record_bytes(row[0], row[1], row[2] or b"", row[3], row[4])) + deflate.flush()
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         names=["path", "records"])

    return cut(records.mapInArrow(run, FILES))


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): of equal payloads the largest page_id is the response.

    A null html is the empty payload. Rows repeating the largest page_id of their payload are all responses, since a
    record can't revisit itself; null ids come before all others, and payloads under ``least_bytes`` are responses.
    Groups are formed by digest and length with partial aggregation; only groups of several pages are joined back.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.when(F.length("payload") >= least_bytes, F.sha1("payload")))
    groups = cut(keyed.filter("digest is not null").groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last"))
    joined = keyed.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(with_revisits(table(spark, sf_dir, "pages")), shared_folder(spark))
    dealt = files.repartition(max(1, min(files.count(), 4096)))  # one archive a task, as far as tasks go
    return read_archives(dealt, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
