"""Media column: 8-bit samples in Ogg pages, written and read back.

`write_ogg` stores a binary column as an Ogg file of several logical streams; `read_ogg` verifies
every page checksum, demultiplexes the streams by serial number, reassembles packets from lacing
values and derives times from granule positions.  Both are row-wise, so neither shuffles.

Defined results: a null payload is stored as an empty one.  A page whose checksum, version or length is
wrong is counted in `bad_pages` and skipped, reading goes on at the next capture pattern, and the packets it
carried are missing from `payload`; `lost_pages` counts gaps in the page numbers.  Bytes that hold no page at all,
and null media, give zero counts and an empty payload.  A column that has the name of an output is replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


RATE = 8000  # samples (bytes) per second of one logical stream
BLOCK = 4032  # bytes per packet
STREAMS = 2
MAGIC = b"PCM8"
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<4sHHIIQ")  # magic, stream, streams, rate, packet bytes, unpadded bytes
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 0x04c11db7, most significant bit first, no inversion).

    zlib has the same polynomial with bits mirrored; mirroring each byte and the result turns one into the other.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _stream_pages(serial: int, ident: bytes, packets: list[bytes]) -> list[tuple[int, bytes]]:
    """(granule position, page) of one logical stream: an identification page, then the packets in pages of at most 255 segments."""
    pages = [(0, _page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(ident)]), ident))]
    lacing, body, done, carried = bytearray(), bytearray(), -1, False
    samples = 0
    for at, packet in enumerate(packets):
        left, sent = [255] * (len(packet) // 255) + [len(packet) % 255], 0
        while left:
            take = left[: 255 - len(lacing)]
            left = left[len(take) :]
            lacing += bytes(take)
            body += packet[sent : sent + sum(take)]
            sent += sum(take)
            if not left:
                samples += len(packet)
                done = samples
            end = at == len(packets) - 1 and not left
            if len(lacing) == 255 or end:
                flags = CONTINUED * carried | LAST * end
                pages.append((samples, _page(flags, done, serial, len(pages), bytes(lacing), bytes(body))))
                lacing, body, done, carried = bytearray(), bytearray(), -1, bool(left)
    return pages


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload's blocks dealt in turn to STREAMS logical streams, whose pages are then interleaved by time."""
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    pages = []
    for s in range(STREAMS):
        ident = _IDENT.pack(MAGIC, s, STREAMS, RATE, BLOCK, n_bytes)
        pages += [(n > 0, granule, s, n, page) for n, (granule, page) in enumerate(_stream_pages(s + 1, ident, blocks[s::STREAMS]))]
    pages.sort(key=lambda x: x[:4])  # all identification pages come first
    return b"".join(x[4] for x in pages)


def decode(media: bytes) -> dict:
    """Pages, packets and times of an Ogg file; see the module's text for damaged input."""
    at, size = media.find(b"OggS"), len(media)
    streams: dict[int, dict] = {}
    pages = bad = lost = 0
    while at >= 0 and at + 27 <= size:
        _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        start = at + 27 + segments
        lacing = media[at + 27 : start]
        end = start + sum(lacing)
        if version or len(lacing) < segments or end > size or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            bad += 1
            at = media.find(b"OggS", at + 4)
            continue
        pages += 1
        s = streams.setdefault(serial, {"next": number, "part": None, "packets": [], "ident": None, "granule": 0})
        gap = number != s["next"]
        lost += max(0, number - s["next"])
        s["next"] = number + 1
        if gap or not flags & CONTINUED:
            s["part"] = None  # what a lost page began can't be completed
        skip = bool(flags & CONTINUED) and s["part"] is None
        packet, place, ended = s["part"] or [], start, []
        for n in lacing:
            packet.append(media[place : place + n])
            place += n
            if n < 255:
                if not skip:
                    ended.append(b"".join(packet))
                packet, skip = [], False
        s["part"] = packet if lacing and lacing[-1] == 255 else None
        if flags & FIRST and ended:
            s["ident"] = ended.pop(0)
        until = granule  # the page's granule position is the end of its last complete packet
        timed = []
        for p in reversed(ended):
            timed.append((until - len(p), until, p))
            until -= len(p)
        s["packets"] += reversed(timed)
        if granule > 0:
            s["granule"] = max(s["granule"], granule)
        at = media.find(b"OggS", end)
    packets, n_bytes, rate = [], 0, RATE
    for serial, s in streams.items():
        order = serial
        if s["ident"] and len(s["ident"]) == _IDENT.size and s["ident"][:4] == MAGIC:
            _, order, _, rate, _, n_bytes = _IDENT.unpack(s["ident"])
        packets += [(a, order, b, serial, p) for a, b, p in s["packets"]]
    packets.sort(key=lambda x: x[:3])
    micro = lambda g: g * 1_000_000 // max(1, rate)
    return {
        "n_bytes": n_bytes, "streams": len(streams), "pages": pages, "bad_pages": bad, "lost_pages": lost,
        "duration_us": micro(max((s["granule"] for s in streams.values()), default=0)),
        "packets": [{"serial": serial, "start_us": micro(a), "end_us": micro(b), "bytes": len(p)} for a, _, b, serial, p in packets],
        "payload": b"".join(p for *_, p in packets),
    }


def write_ogg(df: DataFrame, payload: str = "payload", n_bytes: str = "n_bytes", media: str = "media") -> DataFrame:
    """`df` with the binary column `payload` replaced by `media`, an Ogg file of it; `n_bytes` (kept) is stored in the file too."""
    df = df.drop(media)
    schema = T.StructType([f for f in df.schema.fields if f.name != payload] + [T.StructField(media, T.BinaryType())])
    keep = [f.name for f in df.schema.fields if f.name != payload]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names = b.schema.names
            cells, sizes = b.column(names.index(payload)), b.column(names.index(n_bytes))
            out = pa.array([encode(x.as_py() or b"", n.as_py() or 0) for x, n in zip(cells, sizes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(names.index(k)) for k in keep] + [out], [*keep, media])

    return df.mapInArrow(batches, schema)


READ = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("streams", T.IntegerType()),
        T.StructField("pages", T.IntegerType()),
        T.StructField("bad_pages", T.IntegerType()),
        T.StructField("lost_pages", T.IntegerType()),
        T.StructField("duration_us", T.LongType()),
        T.StructField(
            "packets",
            T.ArrayType(
                T.StructType([T.StructField("serial", T.LongType()), T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("bytes", T.LongType())])
            ),
        ),
        T.StructField("payload", T.BinaryType()),
    ]
)
_READ_ARROW = pa.struct(
    [
        ("n_bytes", pa.int64()), ("streams", pa.int32()), ("pages", pa.int32()), ("bad_pages", pa.int32()), ("lost_pages", pa.int32()), ("duration_us", pa.int64()),
        ("packets", pa.list_(pa.struct([("serial", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("bytes", pa.int64())]))),
        ("payload", pa.binary()),
    ]
)


def read_ogg(df: DataFrame, media: str = "media", out: str = "ogg") -> DataFrame:
    """`df` with a struct column `out`: what `decode` finds in `media`."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, READ)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names = b.schema.names
            got = pa.array([decode(x.as_py() or b"") for x in b.column(names.index(media))], _READ_ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*names, out])

    return df.mapInArrow(batches, schema)


def ogg_packets(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per packet: the other columns of `df`, serial, start_us, end_us, bytes."""
    keep = [c for c in df.columns if c != media]
    return read_ogg(df, media).select(*keep, F.explode("ogg.packets").alias("_p")).select(*keep, "_p.*")
