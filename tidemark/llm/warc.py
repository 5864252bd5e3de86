"""WARC records in ZIP-packaged archives: written with stored members, read by range through the directories."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_filter, materialize, slot_of

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.cdx"
#: An archive is closed at about this many bytes of records.
ARCHIVE_BYTES = 8 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None, url: str | None) -> bytes:
    return b"<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{url}")).encode() + b">"


def _uri(url: str | None) -> bytes:
    return (url or "").encode().replace(b"\r", b"").replace(b"\n", b"")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, refers_uri: str | None = None) -> bytes:
    """One WARC record; a revisit (refers_to given) has HTTP headers only and names the record that it repeats."""
    kind = b"response" if payload is not None else b"revisit"
    block = HTTP % size + (payload or b"")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: " + record_id(page_id, url),
        b"WARC-Target-URI: " + _uri(url),
        b"WARC-Date: 2000-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Page-Id: " + (b"" if page_id is None else str(page_id).encode()),
        b"X-Payload-Length: " + str(size).encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if payload is None:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To: " + record_id(refers_to, refers_uri))
        head.append(b"WARC-Refers-To-Target-URI: " + _uri(refers_uri))
        head.append(b"X-Refers-To-Page-Id: " + (b"" if refers_to is None else str(refers_to).encode()))
    head.append(b"Content-Length: " + str(len(block)).encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def zip_archive(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, with ZIP64 sizes, offsets and end records."""
    out, directory, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra))
        wide = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        directory.append(
            struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(wide), 0, 0, 0, 0, 0xFFFFFFFF)
            + raw + wide
        )
        out += [local, raw, extra, data]
        at += len(local) + len(raw) + len(extra) + len(data)
    size = sum(map(len, directory))
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), size, at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return b"".join([*out, *directory, end64, locator, end])


class ZipRanges:
    """Members of a ZIP file through `read(offset, length)`: only the directories and what is asked for is read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - (65535 + 22))
        tail = bytes(read(tail_at, size - tail_at))
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("not a ZIP file")
        n, length, start = struct.unpack_from("<10xHII", tail, at)
        if 0xFFFF == n or 0xFFFFFFFF in (length, start):
            place = tail_at + at - 20
            sign, where = struct.unpack("<4s4xQ4x", bytes(read(place, 20)))
            if sign != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            sign, n, length, start = struct.unpack("<4s28xQQQ", bytes(read(where, 56)))
            if sign != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
        self.members: dict[str, tuple[int, int, int]] = {}
        listing, at = bytes(read(start, length)), 0
        for _ in range(n):
            sign, method, packed, plain, a, b, c, offset = struct.unpack_from("<4s6xH8xIIHHH8xI", listing, at)
            if sign != b"PK\1\2":
                raise ValueError("broken central directory")
            name = listing[at + 46 : at + 46 + a].decode()
            extra, k = listing[at + 46 + a : at + 46 + a + b], 0
            while k + 4 <= len(extra):
                tag, width = struct.unpack_from("<HH", extra, k)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                k += 4 + width
            self.members[name] = (method, offset, packed)
            at += 46 + a + b + c

    def span(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes lie in the file: (offset, length)."""
        method, offset, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        sign, a, b = struct.unpack("<4s22xHH", bytes(self.read(offset, 30)))
        if sign != b"PK\3\4":
            raise ValueError("broken local header")
        return offset + 30 + a + b, size

    def member(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        at, size = self.span(name)
        return bytes(self.read(at + start, size - start if length is None else length))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload (the HTTP body) of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """One WARC record per page, packed into ZIP archives: (archive, bytes), one row per archive.

    Of pages with equal payloads of at least `least` bytes, the one with the smallest id is a response and the
    others are revisits of it. Only digests are shuffled to find that out. The payloads of pages that are surely
    first stay where they are read; those that a bucket filter of fixed size can't tell apart from revisits go
    through a join on the id and the digest.

    Edge cases: null html is an empty payload; null urls are written empty; a null id is a record without an id, and
    sorts first among equals; rows that repeat id and payload are all responses if their id comes first; rows that
    share an id but not a payload are judged each by its own payload; an empty table gives no archives; other columns are ignored.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("body"))
    thin = base.select("id", "url", F.length("body").cast("long").alias("size"), F.unhex(F.sha1("body")).alias("digest"))
    thin = materialize(thin)
    firsts = materialize(
        thin.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "url")).alias("first")).where("n > 1")
    )
    revisits = thin.where(F.col("size") >= least).join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first.id")))
    revisits = materialize(revisits.select("id", "url", "size", "digest", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_uri")))
    told = in_filter(base, slot_of("id"), revisits, slot_of("id"), "maybe")
    unsure = told.where("maybe").drop("maybe").withColumn("digest", F.unhex(F.sha1("body")))
    unsure = unsure.join(revisits.select("id", "digest").distinct(), ["id", "digest"], "left_anti").drop("digest")
    responses = told.where(~F.col("maybe")).drop("maybe").unionByName(unsure)
    rows = responses.withColumns({"size": F.lit(None).cast("long"), "digest": F.lit(None).cast("binary"), "refers_to": F.lit(None).cast("long"), "refers_uri": F.lit(None).cast("string")})
    rows = rows.unionByName(revisits.withColumn("body", F.lit(None).cast("binary")))

    def run(batches):
        import pyarrow as pa

        records, index, held = [], [], 0

        def close():
            data = zip_archive([(WARC_MEMBER, b"".join(records)), (INDEX_MEMBER, b"".join(index))])
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())], ["archive", "bytes"])

        for batch in batches:
            for row in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                body, plain = row["body"], row["body"] is not None
                digest = sha1_base32(body) if plain else base64.b32encode(row["digest"]).decode()
                raw = record(row["id"], row["url"], body, digest, len(body) if plain else row["size"], row["refers_to"], row["refers_uri"])
                index.append(b"%s %d %d\n" % (b"-" if row["id"] is None else str(row["id"]).encode(), held, len(raw)))
                records.append(raw)
                held += len(raw)
                if held >= ARCHIVE_BYTES:
                    yield close()
                    records, index, held = [], [], 0
        if records:
            yield close()

    return rows.select("id", "url", "body", "size", "digest", "refers_to", "refers_uri").mapInArrow(run, "archive string, bytes binary")


def read_archives(archives: DataFrame, bytes_col: str = "bytes") -> DataFrame:
    """Every record of ZIP-packaged archives, found through the directories and the index and read by range:
    page_id, payload_bytes, payload_digest (of the bytes read, or as a revisit states them), record_type, refers_to, url.

    Edge cases: a null archive has no records; a file that isn't such an archive, or whose member is compressed,
    fails with ValueError rather than being skipped; an empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        number = lambda x: int(x) if x else None
        for batch in batches:
            for cell in batch.column(0):
                if not cell.is_valid:
                    continue
                view = memoryview(cell.as_buffer())
                archive = ZipRanges(lambda at, n, view=view: view[at : at + n], len(view))
                rows = []
                for line in archive.member(INDEX_MEMBER).splitlines():
                    _, offset, length = line.split(b" ")
                    headers, payload = parse_record(archive.member(WARC_MEMBER, int(offset), int(length)))
                    first = headers["warc-type"] == "response"
                    rows.append(
                        (
                            number(headers["x-page-id"]),
                            len(payload) if first else int(headers["x-payload-length"]),
                            sha1_base32(payload) if first else headers["warc-payload-digest"].removeprefix("sha1:"),
                            headers["warc-type"],
                            number(headers.get("x-refers-to-page-id")),
                            headers["warc-target-uri"],
                        )
                    )
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select(F.col(bytes_col)).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    )
