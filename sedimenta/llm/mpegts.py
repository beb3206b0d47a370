"""MPEG transport streams as a media column.

Writing: a payload is cut into access units; each becomes a packetised
elementary stream (PES) packet with a presentation time, cut into transport
packets of 188 bytes. The first packet of a unit carries a clock reference and
marks a random-access point; program tables precede the first unit and recur.

Reading: tables give the program's map and the elementary stream's id;
continuity counters are checked; PES packets are reassembled, and their times
are kept with the place of each random-access point.

Defined results: a null text counts as empty and is padded like any other;
equal texts give equal values; repeated rows and null ids stay; a damaged
stream raises ValueError; further columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID = 188, 0x47, 0x0000
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000
# Choices of this writer.
PROGRAM, PMT_PID, ES_PID = 1, 0x0100, 0x0101
#: Bytes of an access unit, its duration in ticks of the 90 kHz clock, units between program tables.
UNIT, TICKS, TABLES_EVERY = 8192, 3600, 32
ALIGN = 192


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, not reflected, no final inversion."""
    crc = 0xFFFFFFFF
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section_packet(pid: int, table: int, number: int, body: bytes) -> bytearray:
    """A packet with one table section; its counter is set later."""
    section = bytes([table, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return bytearray(bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section.ljust(PACKET - 5, b"\xff"))


PAT = section_packet(PAT_PID, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section_packet(PMT_PID, 0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def timestamp(pts: int) -> bytes:
    """Five bytes of a 33-bit time with markers."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        if k % TABLES_EVERY == 0:
            for x in (PAT, PMT):
                packet = bytearray(x)
                packet[3] |= tables & 15
                out.append(bytes(packet))
            tables += 1
        pts, data = k * TICKS & (1 << 33) - 1, payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(pts) + data
        # First packet: 8 bytes of adaptation field (clock reference, random access), 176 of PES at most; the others hold 184.
        clock = bytes([0x50, pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0])
        head = pes[:176]
        field = clock + b"\xff" * (176 - len(head))
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter & 15, len(field)]) + field + head)
        counter += 1
        full, rest = divmod(len(pes) - len(head), 184)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, len(head)).reshape(full, 184)
            out.append(packets.tobytes())
            counter += full
        if rest:
            stuffing = 183 - rest
            field = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter & 15]) + field + pes[-rest:])
            counter += 1
    return b"".join(out)


def table_entries(packet: np.ndarray) -> bytes:
    """The body of the table section in a packet, its checksum proved."""
    raw = packet.tobytes()
    at = 4 + (raw[4] + 1 if raw[3] & 0x20 else 0)
    at += raw[at] + 1
    size = (raw[at + 1] & 15) << 8 | raw[at + 2]
    section = raw[at : at + 3 + size]
    if crc32_mpeg(section):
        raise ValueError("a program table is damaged")
    return section[8:-4]


def demux(media: bytes) -> dict:
    """payload, times (90 kHz) and byte offsets of random-access points, packets and continuity errors of a stream."""
    if len(media) % PACKET or not media:
        raise ValueError("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    found = np.flatnonzero(pid == PAT_PID)
    if not len(found):
        raise ValueError("no program association table")
    body = table_entries(p[found[0]])
    programs = {body[i] << 8 | body[i + 1]: (body[i + 2] & 31) << 8 | body[i + 3] for i in range(0, len(body), 4)}
    maps = np.flatnonzero(pid == next(v for k, v in programs.items() if k))
    if not len(maps):
        raise ValueError("no program map table")
    body = table_entries(p[maps[0]])
    at = 4 + ((body[2] & 15) << 8 | body[3])
    stream = (body[at + 1] & 31) << 8 | body[at + 2]
    rows = np.flatnonzero(pid == stream)
    q = p[rows]
    counters = q[:, 3] & 15
    errors = int((np.diff(counters.astype(np.int16)) & 15 != 1).sum())
    if errors:
        raise ValueError(f"{errors} continuity errors")
    adapted = q[:, 3] & 0x20 != 0
    begin = np.where(adapted, 5 + q[:, 4].astype(np.int32), 4)
    starts = np.flatnonzero(q[:, 1] & 0x40)
    random_access = adapted & (q[:, 4] > 0) & (q[:, 5] & 0x40 != 0)
    data = q[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    offsets = np.append(ends[starts] - (PACKET - begin[starts]), len(data))
    parts, times, points = [], [], []
    for k, row in enumerate(starts):
        a, b = int(offsets[k]), int(offsets[k + 1])
        if data[a : a + 3] != b"\x00\x00\x01" or (data[a + 4] << 8 | data[a + 5]) != b - a - 6:
            raise ValueError("a packetised stream is damaged")
        t = data[a + 9 : a + 14]
        times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        if random_access[row]:
            points.append(int(rows[row]) * PACKET)
        parts.append(data[a + 9 + data[a + 8] : b])
    return {"payload": b"".join(parts), "times": times, "points": points, "packets": len(p)}


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, points (of random access: pts, offset) of whole texts in UTF-8, padded with spaces to a positive multiple of ALIGN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or "").encode() for x in b.column("text").to_pylist()]
            media = [mux(x.ljust(max(1, -(-len(x) // ALIGN)) * ALIGN)) for x in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What reading the stored streams gives: digests, and the feature string of packets, units, times and random-access points."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points array<struct<pts:long,offset:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, x in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                d = demux(x)
                y, t = d["payload"], d["times"]
                told = f"packets={d['packets']};units={len(t)};random_access={len(d['points'])};first_pts={t[0]};last_pts={t[-1]};seconds={(t[-1] - t[0] + TICKS) / CLOCK:.2f};continuity_errors=0"
                rows.append({"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(y), "payload_sha256": hashlib.sha256(y).hexdigest(), "tail_crc32": zlib.crc32(y[-16:]), "media_bytes": len(x), "media_sha256": hashlib.sha256(x).hexdigest(), "feature": told, "points": [{"pts": i, "offset": j} for i, j in zip(t, d["points"], strict=True)]})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return media.mapInArrow(run, schema)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("points", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64())])))])


def media_features(docs: DataFrame) -> DataFrame:
    """Store the streams of docs as a Parquet table in the shared folder, read them back, and return features()."""
    return features(materialize(to_media(docs), "media"))
