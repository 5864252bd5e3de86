"""Media columns: ISO media containers written from bytes and walked without decoding their payload."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

#: One media sample is a block of 64 bytes (64 one-byte PCM samples at 8000 Hz); every 16th block is a sync sample.
BLOCK, RATE, SYNC_EVERY, BLOCKS_PER_CHUNK = 64, 8000, 16, 256
#: Containers of about so many bytes are read at a time.
CHUNK_BYTES = 4 << 20
MEDIA_FIELDS = (
    "codec string, timescale long, duration long, duration_s double, n_samples long, n_chunks long, n_sync long, "
    "payload_offset long, payload_bytes long, keyframes array<struct<start: long, end: long>>"
)


#: The identity matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def mux(payload: bytes) -> bytes:
    """An ISO media file whose only track holds `payload` (a positive multiple of 64 bytes) as unsigned 8-bit PCM."""
    import numpy as np

    blocks = len(payload) // BLOCK
    chunks = -(-blocks // BLOCKS_PER_CHUNK)
    last = blocks - (chunks - 1) * BLOCKS_PER_CHUNK
    runs = [(1, BLOCKS_PER_CHUNK)] * (chunks > 1) + ([(chunks, last)] if last != BLOCKS_PER_CHUNK or chunks == 1 else [])
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHH4xI", 1, 1, 8, RATE << 16))
    sync = np.arange(1, blocks + 1, SYNC_EVERY, dtype=">u4")
    head = box(b"ftyp", b"isom\0\0\2\0isommp42")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=">u8") * (BLOCK * BLOCKS_PER_CHUNK)
        wide = first + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, blocks, BLOCK)),
            full_box(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, n, 1) for a, n in runs]),
            full_box(b"stsz", struct.pack(">II", BLOCK, blocks)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        long = len(payload) >= 1 << 32  # durations of 64 bits are version 1
        head_box = lambda kind, flags, *parts: box(kind, struct.pack(">I", (long << 24) | flags), *parts)
        span = struct.pack(">Q" if long else ">I", len(payload))
        times = bytes(16 if long else 8)
        mdia = box(
            b"mdia",
            head_box(b"mdhd", 0, times, struct.pack(">I", RATE), span, struct.pack(">HH", 0x55C4, 0)),
            full_box(b"hdlr", bytes(4), b"soun", bytes(13)),
            box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), stbl),
        )
        tkhd = head_box(b"tkhd", 7, times, struct.pack(">II", 1, 0), span, bytes(8), struct.pack(">HHH", 0, 0, 0x0100), bytes(2), MATRIX, bytes(8))
        mvhd = head_box(b"mvhd", 0, times, struct.pack(">I", RATE), span, struct.pack(">IH", 0x00010000, 0x0100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    at = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(1 << 33 if len(payload) >= 1 << 31 else 0))
    return head + moov(len(head) + size + at) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int):
    """(kind, body start, body end) of the boxes in a range; a box that doesn't fit raises ValueError."""
    while start < end:
        if start + 8 > end:
            raise ValueError("truncated box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("box does not fit")
        yield kind, body, start + size
        start += size


def tracks(data: bytes) -> list[dict]:
    """The sample tables of every track: byte ranges of all samples, sync samples, codec and duration. Reads only
    headers and tables, never the payload."""
    import numpy as np

    view, found = memoryview(data), []

    def table(kind: str, at: int, n: int):
        return np.frombuffer(view, kind, n, at).astype(np.int64)

    def u32(at: int) -> int:
        return struct.unpack_from(">I", view, at)[0]

    def walk(start: int, end: int, track: dict | None) -> None:
        for kind, a, b in boxes(view, start, end):
            if kind == b"trak":
                found.append(own := {"sync": None})
                walk(a, b, own)
            elif kind in (b"moov", b"mdia", b"minf", b"stbl"):
                walk(a, b, track)
            elif track is None:
                continue
            elif kind == b"mdhd":
                wide = view[a] == 1
                track["timescale"] = u32(a + (20 if wide else 12))
                track["duration"] = struct.unpack_from(">Q" if wide else ">I", view, a + (24 if wide else 16))[0]
            elif kind == b"stsd":
                track["codec"] = bytes(view[a + 12 : a + 16]).decode("latin-1") if u32(a + 4) else None
            elif kind == b"stts":
                track["stts"] = table(">u4", a + 8, 2 * u32(a + 4)).reshape(-1, 2)
            elif kind == b"stss":
                track["sync"] = table(">u4", a + 8, u32(a + 4)) - 1
            elif kind == b"stsc":
                track["stsc"] = table(">u4", a + 8, 3 * u32(a + 4)).reshape(-1, 3)
            elif kind == b"stsz":
                same, n = u32(a + 4), u32(a + 8)
                track["sizes"] = np.full(n, same, np.int64) if same else table(">u4", a + 12, n)
            elif kind in (b"stco", b"co64"):
                track["chunks"] = table(">u4" if kind == b"stco" else ">u8", a + 8, u32(a + 4))

    walk(0, len(view), None)
    for t in found:
        chunk, sizes = t["chunks"], t["sizes"]
        first = t["stsc"][:, 0] - 1
        per = np.repeat(t["stsc"][:, 1], np.diff(np.append(first, len(chunk))))
        of = np.repeat(np.arange(len(chunk)), per)[: len(sizes)]
        ends = np.cumsum(sizes)
        lead = np.concatenate(([0], np.cumsum(per)[:-1])).clip(max=max(len(sizes) - 1, 0))
        begin = (ends - sizes) - (ends - sizes)[lead][of] + chunk[of] if len(sizes) else sizes
        t["start"], t["end"] = begin, begin + sizes
        t["sync"] = np.arange(len(sizes)) if t["sync"] is None else t["sync"]
    return found


def read_payload(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, adjacent samples read as one range."""
    import numpy as np

    a, b = track["start"], track["end"]
    breaks = np.flatnonzero(a[1:] != b[:-1]) + 1
    return b"".join(data[x:y] for x, y in zip(a[np.append(0, breaks)], b[np.append(breaks - 1, len(b) - 1)], strict=True)) if len(a) else b""


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a media column: id, n_bytes (UTF-8 length, unpadded), media (the container's bytes).

    Edge cases: null text counts as empty, and empty text is stored as one block of zeros; a very long text makes one
    long container (64-bit boxes and offsets beyond 4 GB); repeated rows stay; an empty table gives an empty
    result; other columns are ignored.
    """
    import pyarrow as pa

    from tidemark.llm.common import text_chunks

    picked = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")

    def run(batches):
        for part, texts in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(pad(x)) for x in texts], pa.binary())],
                ["id", "n_bytes", "media"],
            )

    out = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def probe_media(table: DataFrame, media_col: str = "media", digest: bool = False) -> DataFrame:
    """Add to each row what its container's boxes say of the first track: codec, timescale, duration, sample, chunk
    and sync counts and the keyframes' byte ranges (MEDIA_FIELDS). With `digest`, also digests of the payload as
    read back from the byte ranges, and of the stored form; the media column itself is dropped.

    Edge cases: a null or broken container, or one without tracks, gives nulls in all added columns; repeated rows
    stay; an added name that the input has already replaces nothing: the input's column is dropped.
    """
    import hashlib
    import zlib

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    digests = ", payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string" if digest else ""
    added = StructType.fromDDL(MEDIA_FIELDS + digests)
    taken = {f.name for f in added} | {media_col}
    picked = table.select(*[f"`{c}`" for c in table.columns if c not in taken], f"`{media_col}`")
    schema = StructType([f for f in picked.schema if f.name != media_col] + list(added))
    arrow = to_arrow_schema(schema)

    def probe(data: bytes | None) -> dict:
        try:
            t = tracks(data)[0]
            keys = t["sync"]
            row = {
                "codec": t["codec"], "timescale": t["timescale"], "duration": int(t["stts"].prod(axis=1).sum()),
                "duration_s": float(t["stts"].prod(axis=1).sum()) / max(t["timescale"], 1), "n_samples": len(t["sizes"]),
                "n_chunks": len(t["chunks"]), "n_sync": len(keys), "payload_offset": int(t["start"][0]) if len(t["start"]) else None,
                "payload_bytes": int(t["sizes"].sum()), "keyframes": (t["start"][keys], t["end"][keys]),
            }
            if digest:
                payload = read_payload(data, t)
                row |= {"payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
            return row
        except (TypeError, ValueError, KeyError, IndexError, struct.error):
            return {}

    def ranges(rows: list[dict]) -> pa.Array:
        import numpy as np

        pairs = [r.get("keyframes") for r in rows]
        sizes = [0 if p is None else len(p[0]) for p in pairs]
        held = [p for p in pairs if p is not None]
        flat = [np.concatenate([p[i] for p in held]) if held else np.zeros(0, np.int64) for i in (0, 1)]
        kind = arrow.field("keyframes").type
        items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], fields=list(kind.value_type))
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        mask = pa.array([p is None for p in pairs], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=kind, mask=mask)

    def run(batches):
        for part, data in _binary_chunks(batches):
            rows = [probe(x) for x in data]
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            columns += [ranges(rows) if f.name == "keyframes" else pa.array([r.get(f.name) for r in rows], arrow.field(f.name).type) for f in added]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def _binary_chunks(batches):
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            start, held = 0, 0
            for i, n in enumerate(sizes):
                held += n
                if held >= CHUNK_BYTES or i + 1 == len(sizes):
                    part = batch.slice(start, i + 1 - start)
                    yield part, part.column(part.num_columns - 1).to_pylist()
                    start, held = i + 1, 0

    return picked.mapInArrow(run, schema)
