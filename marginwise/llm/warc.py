"""WARC records in ZIP-packaged archives, read in place.

An archive is a ZIP file whose members are stored, not deflated: records as concatenated gzip
members, and an index with the place of each record. The reader finds the central directory from
the end of the file, by way of the ZIP64 records where there are any, locates the members, streams
the index and reads each record by its range. Nothing is extracted and no archive is read whole.

Of records with equal payloads the one with the largest page id is the response, the others are
revisits of it without payload. The aggregation that decides moves ids and digests only, and a
payload that a third of all pages share is one row of its result; the join back moves the payloads, unless
that result is small enough to be broadcast.

Edge cases: a NULL page is an empty payload, and empty payloads are equal; repeated rows of a page
are records of their own; a NULL page id never is the largest one, and where there is no other every
record is a response; columns other than the three named are not read, so their names cannot
clash; pages of any length up to Spark's 2 GB for a value are written whole; an empty table writes no archive.
"""

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginwise.llm import files
from marginwise.llm.text import whole
from marginwise.session import stored

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 64 << 20
STORED = 0
ID = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Writing


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record with its HTTP header; a revisit has no payload, but its length in the header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{quote(page_id or '', safe='')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe='/:?&=#%+,;@~!$()*')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[4:4] = [f"WARC-Refers-To: <{ID}{quote(refers_to, safe='')}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_responses(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, refers_to): the page whose record holds the payload, NULL for that one."""
    html = whole(F.col(html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Written, so that the join below can split a payload that many pages share.
    largest = stored(
        keyed.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "responses",
    )
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return keyed.join(largest, "digest", "left").select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes the pages as archives below ``folder``; (path, records) per archive.

    The result is a plan: store it once, as every run of it writes the archives anew.
    """
    rows = with_responses(pages, id_col, url_col, html_col).select(
        F.col("page_id").cast("string"), F.coalesce(F.col("url").cast("string"), F.lit("")), "html", F.col("refers_to").cast("string")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = stream = archive = member = None
        index: list[str] = []
        at = 0

        def finish() -> pa.RecordBatch:
            member.close()
            archive.writestr(INDEX, "".join(index))
            archive.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(index)])], names=["path", "records"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(column.to_pylist() for column in batch.columns)):
                if member is not None and at > ARCHIVE_BYTES:
                    yield finish()
                    member = None
                if member is None:
                    uri, stream = files.create(folder, ".wacz")
                    archive, index, at = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), [], 0
                    member = archive.open(RECORDS, "w", force_zip64=True)
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
                member.write(packed)
                entry = {"url": url, "digest": f"sha1:{digest}", "offset": at, "length": len(packed), "filename": RECORDS}
                index.append(f"{quote(url, safe='/:?&=')} 20240101000000 {json.dumps(entry)}\n")
                at += len(packed)
        if member is not None:
            yield finish()

    return rows.mapInArrow(run, "path string, records bigint")


# Reading


def directory(reader: files.Reader, uri: str) -> list[tuple[str, int, int, int, int]]:
    """(name, method, place of the local header, stored bytes, bytes) of each member of an archive."""
    size = reader.open(uri)
    tail_at = max(0, size - 22 - 65_535)
    tail = reader.read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError(f"{uri} is not a ZIP archive")
    count, length, begin = struct.unpack_from("<10xHII", tail, end)
    end_at = tail_at + end
    if end_at >= 20 and (locator := reader.read(end_at - 20, 20))[:4] == b"PK\x06\x07":
        record_at = struct.unpack_from("<8xQ", locator)[0]
        count, length, begin = struct.unpack_from("<32xQQQ", reader.read(record_at, 56))
    found, at = [], 0
    entries = reader.file.read_at(length, begin)
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError(f"{uri}: broken central directory")
        method, packed, plain, name, extra, comment, place = struct.unpack_from("<10xH8xIIHHH8xI", entries, at)
        label = entries[at + 46 : at + 46 + name].decode("utf-8", "replace")
        more = entries[at + 46 + name : at + 46 + name + extra]
        # The ZIP64 field holds those of the three numbers that did not fit, in this order.
        k = 0
        while k + 4 <= len(more):
            kind, n = struct.unpack_from("<HH", more, k)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", more, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            k += 4 + n
        found.append((label, method, place, packed, plain))
        at += 46 + name + extra + comment
    return found


def content_at(reader: files.Reader, place: int) -> int:
    """Where the bytes of a member begin; the local header may be longer than the central one."""
    name, extra = struct.unpack_from("<26xHH", reader.read(place, 30))
    return place + 30 + name + extra


def index_lines(reader: files.Reader, at: int, length: int, step: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    for begin in range(at, at + length, step):
        *lines, rest = (rest + reader.read(begin, min(step, at + length - begin))).split(b"\n")
        yield from lines
    if rest:
        yield rest


def locations(archives: DataFrame) -> DataFrame:
    """(path, offset, length) of every record that the indexes of the archives (path) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = files.Reader()

        def pack(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "offset", "length"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                members = {name: (method, place, packed) for name, method, place, packed, _ in directory(reader, path)}
                begins = {n: content_at(reader, place) for n, (method, place, _) in members.items() if method == STORED}
                rows: list[tuple[str, int, int]] = []
                for name in begins:
                    if not name.startswith("indexes/"):
                        continue
                    for line in index_lines(reader, begins[name], members[name][2]):
                        entry = json.loads(line.split(b" ", 2)[2])
                        rows.append((path, begins[entry["filename"]] + int(entry["offset"]), int(entry["length"])))
                        if len(rows) == 50_000:
                            yield pack(rows)
                            rows = []
                yield pack(rows)
        reader.close()

    return archives.select("path").mapInArrow(run, "path string, offset bigint, length bigint")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC header, the HTTP header and the payload of a record."""

    def header(block: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = header(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, header(http), payload


def page_of(urn: str | None) -> str | None:
    return unquote(urn.strip("<>").removeprefix(ID)) or None if urn else None


FIELDS = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload string"


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (path); the payload of a response is checked against its digest."""
    placed = locations(archives)
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Neighbours stay together: a task reads ranges of some archives from front to back.
    dealt = placed.repartition(n, "path", F.expr(f"offset div {RANGE_BYTES}")).sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = files.Reader()
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                reader.open(path)
                warc, http, payload = parse(zlib.decompress(reader.read(offset, length), 31))
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if warc["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{path}, {offset}: payload and digest differ")
                rows.append(
                    (
                        page_of(warc["warc-record-id"]), unquote(warc["warc-target-uri"]), int(http["content-length"]), digest,
                        warc["warc-type"], page_of(warc.get("warc-refers-to")), payload.decode() if warc["warc-type"] == "response" else None,
                    )
                )
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        reader.close()

    return dealt.mapInArrow(run, FIELDS)
