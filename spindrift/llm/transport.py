"""MPEG transport streams as a column: one programme with one private data stream for each text.

Stored form: a program association table, a program map table, then elementary packets of UNIT
payload bytes each. Every elementary packet has a presentation timestamp (its first byte's time at
RATE samples a second, in 90 kHz ticks) and starts in a transport packet whose adaptation field
sets the random-access flag and a clock reference. All transport packets have 188 bytes and
continuity counters for each identifier.

Reading takes nothing for granted: it checks sync bytes and table digests, follows the tables to
the stream's identifier, counts breaks of continuity, reassembles elementary packets by their
start flags, checks their lengths, and lists timestamps with random-access points.

Defined cases: a null text is the empty text; its payload is 64 zero bytes. Equal texts have
equal values. Long texts are stored whole, a bounded number of bytes at a time for each packet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import by_text, table

#: Payload bytes of an elementary packet; samples a second; ticks a second; bytes of a transport packet.
UNIT, RATE, TICKS, PACKET = 4096, 8000, 90_000, 188
#: Identifiers of the map table and of the stream, number of the programme, type and id of a private stream.
MAP_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
BATCH_BYTES = 4_000_000


def _crc_table() -> list[int]:
    rows = []
    for n in range(256):
        r = n << 24
        for _ in range(8):
            r = (r << 1) ^ (0x04C11DB7 if r & 0x80000000 else 0)
        rows.append(r & 0xFFFFFFFF)
    return rows


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ _CRC[(r >> 24) ^ b]
    return r


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))) + _table_packet(
    MAP_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))
)


def _stamp(ticks: int) -> bytes:
    t = ticks % 2**33
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])


def write(payload: bytes) -> bytes:
    """The transport stream that stores the payload."""
    out, counter = [TABLES], 0
    for unit in range(0, len(payload), UNIT):
        data = payload[unit : unit + UNIT]
        ticks = unit * TICKS // RATE
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data
        clock = (ticks % 2**33 << 15 | 0x7E00).to_bytes(6, "big")
        # Room: 176 bytes beside the first packet's adaptation field, 184 in each later packet.
        n = 1 + max(0, -(-(len(pes) - 176) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter = (counter + n) % 16
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4:12] = np.frombuffer(bytes([7, 0x50]) + clock, np.uint8)
        body = np.frombuffer(pes, np.uint8)
        last = len(body) if n == 1 else len(body) - 176 - 184 * (n - 2)
        if n > 1:
            packets[0, 12:] = body[:176]
            packets[1 : n - 1, 4:] = body[176 : len(body) - last].reshape(n - 2, 184)
            if last < 184:
                packets[n - 1, 3] |= 0x20
                packets[n - 1, 4] = 183 - last
                if last < 183:
                    packets[n - 1, 5] = 0
        else:
            packets[0, 4] = 183 - last
        packets[n - 1, PACKET - last :] = body[len(body) - last :]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    stamps: list[int]
    random_access: list[bool]
    packets: int
    breaks: int
    program: int
    stream_type: int


def _parse_section(packet: np.ndarray, table_id: int) -> bytes:
    data = packet.tobytes()
    at = 5 + data[4]
    length = (data[at + 1] & 0x0F) << 8 | data[at + 2]
    section = data[at : at + 3 + length]
    if data[at] != table_id or section_crc(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("a table is damaged")
    return section[8:-4]


def read(media: bytes) -> Stream:
    """Demultiplexes a transport stream of one programme with one stream."""
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("sync is lost")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    starts = packets[:, 1] & 0x40 != 0
    programs = _parse_section(packets[np.flatnonzero((pids == 0) & starts)[0]], 0)
    program, map_pid = int.from_bytes(programs[:2], "big"), int.from_bytes(programs[2:4], "big") & 0x1FFF
    streams = _parse_section(packets[np.flatnonzero((pids == map_pid) & starts)[0]], 2)
    entry = 4 + (int.from_bytes(streams[2:4], "big") & 0x0FFF)
    stream_type, pid = streams[entry], int.from_bytes(streams[entry + 1 : entry + 3], "big") & 0x1FFF

    breaks = 0
    for own in (0, map_pid, pid):
        counters = packets[(pids == own) & (packets[:, 3] & 0x10 != 0), 3] & 0x0F
        breaks += int(((counters[1:].astype(int) - counters[:-1]) % 16 != 1).sum())
    chosen = packets[(pids == pid) & (packets[:, 3] & 0x10 != 0)]
    adapted = chosen[:, 3] & 0x20 != 0
    offset = np.where(adapted, 5 + chosen[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (chosen[:, 4] > 0), chosen[:, 5], 0)
    body = chosen[np.arange(PACKET)[None, :] >= offset[:, None]].tobytes()
    at = np.cumsum(PACKET - offset) - (PACKET - offset)
    opens = np.flatnonzero(chosen[:, 1] & 0x40)
    bounds = [*at[opens].tolist(), len(body)]
    data, stamps = [], []
    for a, b in zip(bounds, bounds[1:]):
        head = body[a : a + 14]
        if head[:3] != b"\0\0\1" or int.from_bytes(head[4:6], "big") != b - a - 6:
            raise ValueError("an elementary packet is damaged")
        stamps.append((head[9] & 0x0E) << 29 | head[10] << 22 | (head[11] & 0xFE) << 14 | head[12] << 7 | head[13] >> 1)
        data.append(body[a + 9 + head[8] : b])
    return Stream(b"".join(data), stamps, (flags[opens] & 0x40 != 0).tolist(), len(packets), breaks, program, stream_type)


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def feature(stream: Stream) -> str:
    """Counts of the container, and of the samples: mean, root mean square and crossings of the middle."""
    samples = np.frombuffer(stream.payload, np.uint8).astype(np.int64)
    high = samples >= 128
    return (
        f"program={stream.program};type={stream.stream_type};packets={stream.packets};units={len(stream.stamps)};breaks={stream.breaks};"
        f"first={stream.stamps[0]};last={stream.stamps[-1]};random_access={sum(stream.random_access)};"
        f"mean={samples.mean():.4f};rms={np.sqrt((samples * samples).mean()):.4f};crossings={int((high[1:] != high[:-1]).sum())}"
    )


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, random_access array<boolean>"


def describe(text: bytes) -> tuple:
    """Stores a text, reads the stored bytes back and describes what was read."""
    media = write(payload_of(text))
    stream = read(media)
    kept = stream.payload
    return (len(text), len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), stream.stamps, stream.random_access)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's transport stream as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_bytes(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([write(payload_of(text))], pa.binary())], names=["doc_id", "media"])

    return by_text(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """What the stored form of each text holds when read back, with timestamps and random-access points."""
    names = ["doc_id", *(c.split(" ")[0] for c in SCHEMA.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(t) for t in _bytes(batch)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return by_text(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op7_transport_streams": op7_transport_streams}
ORACLES: dict[str, str] = {}
