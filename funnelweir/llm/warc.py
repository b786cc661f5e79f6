"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each partition becomes one archive of gzip members, one member per record, under a
name of its own; the list of archives that it returns holds those of successful tasks only,
so files that a lost or repeated task left behind are never read. Of records with equal
payloads the ones with the smallest page id are ``response``, the others ``revisit`` that
name it and carry no payload.

Reader: archives are cut into byte ranges, and each task takes ranges. It scans its range for
the gzip magic, decodes the start of every candidate member and takes it for a record only if
a WARC header comes out. A record belongs to the range that its first byte lies in; its task
reads on past the end of the range as far as the record goes. The writer makes sure that no
member holds inside it what the reader would take for another one.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelweir.llm.common import cut, shared_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: Bytes that are read at once, and decoded bytes that show whether a member is a record.
BLOCK, PEEK = 1 << 20, 16
PAGE = "WARC-Page-Id"

RECORD = "page_id {kind}, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to {kind}, payload binary, digest_ok boolean, archive string, start long"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def member(data: bytes) -> bytes:
    """``data`` as one gzip member in which no other record seems to start."""
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY), (6, zlib.Z_FIXED)):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31, 9, strategy)
        out = packer.compress(data) + packer.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and not starts_record(out[at : at + 512]):
            at = out.find(MAGIC, at + 1)
        if at < 0:
            return out
    raise ValueError("no way found to pack a record without what looks like another record")


def starts_record(head: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(head, PEEK).startswith(VERSION[:5])
    except zlib.error:
        return False


def record(kind: str, page: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record; the block is an HTTP response, without its body in a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    named = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}").urn
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{named(page)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(' ' if c in SPLITS else c for c in url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"{PAGE}: {page}"] if page is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{named(refers_to)}>", f"WARC-Refers-To-Page-Id: {refers_to}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters that would end a header line; a target URI has blanks in their place.
SPLITS = "\r\n"


def with_roles(pages: DataFrame, min_revisit_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, digest (hexadecimal), first (page id of the response).

    A null page id is a response only where no record of the same payload has an id; rows
    that repeat the smallest id are all responses.
    """
    html = F.coalesce(F.col(html_column), F.lit(""))
    facts = pages.select(F.col(id_column).alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), F.encode(html, "UTF-8").alias("payload"))
    facts = facts.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    # only payloads that occur again are joined; the checkpoint leaves two plain shuffles, which Spark can split where one payload is hot
    groups = facts.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest")
    again = cut(groups.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return facts.join(again, "digest", "left")


def write_archives(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Writes archives below ``folder``; returns their list (archive, bytes, records), already written itself."""
    rows = with_roles(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        size = records = 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                for row in range(batch.num_rows):
                    page, url, payload, length, digest, first = (batch.column(k)[row].as_py() for k in range(6))
                    revisit = first is not None and page != first
                    packed = member(record("revisit" if revisit else "response", page, url, None if revisit else payload, length, base32_sha1(digest), first))
                    out.write(packed)
                    size += len(packed)
                    records += 1
        if records:
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [records]})

    return cut(rows.select("page_id", "url", "payload", "payload_bytes", "digest", "first").mapInArrow(run, "archive string, bytes long, records long"))


class Window:
    """Bytes of a file from any place on, held only as far as they are needed."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def get(self, at: int, length: int) -> bytes:
        if not (self.start <= at and at + length <= self.start + len(self.data)):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(length, BLOCK))
        return self.data[at - self.start : at - self.start + length]


def decode_member(window: Window, at: int) -> tuple[bytes, int] | None:
    """The whole member that starts at ``at`` and where it ends, or None if it is none."""
    unpacker, out = zlib.decompressobj(31), []
    try:
        while not unpacker.eof and at < window.size:
            part = window.get(at, min(BLOCK // 8, window.size - at))
            out.append(unpacker.decompress(part))
            at += len(part)
    except zlib.error:
        return None
    return (b"".join(out), at - len(unpacker.unused_data)) if unpacker.eof else None


def records_from(file, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Place and decoded bytes of the records that begin in [start, stop)."""
    window, at = Window(file, size), start
    while at < stop:
        # the magic may lie across the end of the range, its first byte may not
        step = min(BLOCK // 8, stop - at)
        found = window.get(at, min(step + len(MAGIC) - 1, size - at)).find(MAGIC)
        if found < 0:
            at += step
            continue
        at += found
        data = decode_member(window, at) if starts_record(window.get(at, min(512, size - at))) else None
        if data is None:
            at += 1
            continue
        yield at, data[0]
        at = data[1]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.decode().split(": ", 1) if ": " in line.decode() else (line.decode().rstrip(":"), "") for line in head.split(b"\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(archives: DataFrame, split_bytes: int = 8 << 20, id_type: str = "long") -> DataFrame:
    """Records of the archives listed as (archive, bytes), by byte ranges of ``split_bytes``.

    ``payload`` is null in revisits, whose size and digest come from their headers;
    ``digest_ok`` says whether a response's payload has the digest that its header names.
    """
    import hashlib

    spark = archives.sparkSession
    ranges = archives.filter("bytes > 0").select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive", "start")
    whole = id_type not in ("string",)
    number = lambda x: None if x is None else int(x) if whole else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        kinds = [pa.int64() if whole else pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64() if whole else pa.string(), pa.binary(), pa.bool_(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for archive, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store, path = open_store(archive)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for at, data in records_from(file, size, start, min(size, start + split_bytes)):
                        fields, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = fields["WARC-Type"] == "response"
                        length = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        good = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == length if response else None
                        rows.append((number(fields.get(PAGE)), fields["WARC-Type"], fields["WARC-Target-URI"], length, digest, number(fields.get("WARC-Refers-To-Page-Id")), payload if response else None, good, archive, at))
                        held += len(data)
                        if held > 8 * BLOCK:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return dealt.select("archive", "bytes", "start").mapInArrow(run, RECORD.format(kind=id_type))


def round_trip(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads all records back."""
    folder = shared_folder(spark, "warc")
    return read_archives(write_archives(pages, folder, **columns))
