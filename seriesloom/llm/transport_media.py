"""op2: a media column of MPEG transport streams (ISO/IEC 13818-1).

`encode_media` stores each payload as a transport stream: a program
association table and a program map table before every random-access point,
and the payload as time-stamped PES packets (access units) on one
elementary PID. `decode_media` reads stored bytes back, its own or those of
other encoders: it parses the program tables (of any number of packets), checks
the continuity counters (with packets sent twice, packets without payload and
marked discontinuities), reassembles the PES packets (also those without a
length) and lists their timestamps and random-access points. Null packets and
PIDs that no program lists are passed over.

The payload of the query is the text in UTF-8 (null: empty) with zero bytes
up to a positive multiple of 64, so an empty text stores 64 zero bytes.
Equal payloads give equal streams. Ids may be null or repeat; other columns
are not read. An empty table gives an empty result. Tasks take a few MB of text
at a time, or one text, however long (a stored stream may have 2 GiB at most,
Spark's bound on one binary value); a stream is about 1.1 times its payload.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, lean

PACKET, SYNC = 188, 0x47
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0101, 1
STREAM_ID, STREAM_TYPE = 0xBD, 0x06  # private stream 1, private PES data
UNIT, GROUP, TICKS = 2048, 8, 3600  # bytes of an access unit, units from one random-access point to the next, 90 kHz ticks a unit
PES_HEADER = 14


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(0x02, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(ticks: int) -> bytes:
    """A presentation time of 33 bits, spread over five bytes with marker bits."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | (t >> 30) << 1, t >> 22 & 255, 1 | (t >> 15 & 127) << 1, t >> 7 & 255, 1 | (t & 127) << 1])


def _clock(ticks: int) -> bytes:
    """A program clock reference with extension 0."""
    t = ticks & (1 << 33) - 1
    return ((t << 15) | 0x7E00).to_bytes(6, "big")


_HEADS = [bytes([SYNC]) + MEDIA_PID.to_bytes(2, "big") + bytes([0x10 | c]) for c in range(16)]


def mux(payload: bytes) -> bytes:
    """The transport stream that holds `payload`."""
    out, counter, tables = [], 0, 0
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        data = payload[at : at + UNIT]
        ticks, entry = unit * TICKS, unit % GROUP == 0
        if entry:
            out += (_table_packet(0, tables, PAT), _table_packet(PMT_PID, tables, PMT))
            tables += 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data
        field = b"\x50" + _clock(ticks) if entry else b""  # random access and clock
        p, first = 0, True
        while p < len(pes):
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = pes[p : p + room]
            if not field and len(part) == room:
                packet = _HEADS[counter] + part
            else:
                space = PACKET - 4 - len(part)  # the adaptation field, with stuffing
                body = (field or b"\x00").ljust(space - 1, b"\xff")[: space - 1]
                packet = _HEADS[counter][:3] + bytes([0x30 | counter, space - 1]) + body + part
            if first:
                packet = packet[:1] + bytes([packet[1] | 0x40]) + packet[2:]
            out.append(packet)
            counter, p, field, first = counter + 1 & 15, p + len(part), b"", False
    return b"".join(out)


def _payloads(packets: np.ndarray) -> np.ndarray:
    """Where the payload of each packet begins, 188 where it has none."""
    start = np.where(packets[:, 3] & 0x20, 5 + packets[:, 4].astype(np.int32), 4)
    return np.where(packets[:, 3] & 0x10, np.minimum(start, PACKET), PACKET)


def _in_order(packets: np.ndarray) -> tuple[np.ndarray, int]:
    """The packets of one PID without those that are sent twice, and how often the continuity counter breaks.

    A counter goes up by one with each payload and stays without; a packet may be sent twice, the second time with another clock value; a discontinuity indicator allows any jump."""
    if len(packets) < 2:
        return packets, 0
    clocked = ((packets[:, 3] & 0x20) != 0) & (packets[:, 4] >= 7) & ((packets[:, 5] & 0x10) != 0)
    bare = packets.copy() if clocked.any() else packets
    bare[clocked, 6:12] = 0
    step = (packets[1:, 3].astype(np.int16) - packets[:-1, 3]) & 15
    carries = (packets[1:, 3] & 0x10) != 0
    twice = (step == 0) & carries & (bare[1:] == bare[:-1]).all(axis=1)
    jumps = ((packets[1:, 3] & 0x20) != 0) & (packets[1:, 4] > 0) & ((packets[1:, 5] & 0x80) != 0)
    broken = ~(twice | jumps | (step == carries))
    return packets[np.concatenate([[True], ~twice])], int(broken.sum())


def _section_of(packets: np.ndarray, start: np.ndarray) -> bytes:
    """The first section in the packets of a PID, however many it spans, its CRC checked."""
    found = np.flatnonzero((packets[:, 1] & 0x40 != 0) & (start < PACKET))
    if not len(found):
        raise ValueError("no packet begins a program table")
    raw = b"".join(packets[k, start[k] :].tobytes() for k in range(found[0], min(len(packets), found[0] + 8)))  # a section has 1024 bytes at most
    raw = raw[1 + raw[0] :]
    section = raw[: 3 + (int.from_bytes(raw[1:3], "big") & 0x0FFF)]
    if crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("a program table has a wrong checksum")
    return section


def demux(media: bytes) -> dict:
    """Of the first elementary stream of the first program: payload, times (90 kHz ticks, -1 for a unit without one), entries (units that are
    random-access points), cut (units that end before their length); and packets, and errors (breaks of a continuity counter) of the tables and all elementary streams."""
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if len(packets) == 0 or (packets[:, 0] != SYNC).any():
        raise ValueError("not a transport stream")
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    streams, errors = {}, 0

    def read(one: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal errors
        if one not in streams:
            own, broken = _in_order(packets[pid == one])
            errors += broken
            streams[one] = own, _payloads(own)
        return streams[one]

    pat = _section_of(*read(0))
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4)}
    program = min(n for n in programs if n)
    pmt = _section_of(*read(programs[program]))
    at, media_pids = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF), []
    while at < len(pmt) - 4:
        media_pids.append(int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF)
        at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF)
    for one in media_pids:
        read(one)
    own, start = read(media_pids[0])
    data = own[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    first = np.flatnonzero((own[:, 1] & 0x40 != 0) & (start < PACKET))
    begins = ends[first] - (PACKET - start[first])
    stops = np.append(begins[1:], len(data))
    payload, times, cut = [], [], 0
    for b, stop in zip(begins.tolist(), stops.tolist(), strict=True):
        if data[b : b + 3] != b"\x00\x00\x01":
            raise ValueError("no start code where a PES packet begins")
        length = int.from_bytes(data[b + 4 : b + 6], "big")
        s = data[b + 9 : b + 14]
        times.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1 if len(s) == 5 and data[b + 7] & 0x80 else -1)
        end = b + 6 + length if length else stop  # length 0: up to the next one
        cut += end > stop
        payload.append(data[b + 9 + data[b + 8] : min(end, stop)])  # after a lost packet, nothing of the next unit
    entries = np.flatnonzero((own[first, 3] & 0x20 != 0) & (own[first, 4] > 0) & (own[first, 5] & 0x40 != 0))
    return {"payload": b"".join(payload), "times": times, "entries": entries.tolist(), "packets": len(packets), "errors": errors, "cut": cut, "program": program, "pid": media_pids[0]}


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text in UTF-8) and media, the transport stream of the padded text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            media = pa.array([mux(padded(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), media], ["id", "n_bytes", "media"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(rows), f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(stored: DataFrame) -> DataFrame:
    """Of each stored stream: payload, times, entries (random-access points), packets, errors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct({"payload": pa.binary(), "times": pa.list_(pa.int64()), "entries": pa.list_(pa.int32()), "packets": pa.int64(), "errors": pa.int64()})
        for batch in batches:
            read = [demux(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *pa.array(read, kind).flatten()], [*batch.schema.names, "payload", "times", "entries", "packets", "errors"])

    kind = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(lean(rows), f"id {kind}, n_bytes long, media binary, payload binary, times array<long>, entries array<int>, packets long, errors long")


def op2_transport_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored streams and of the payloads read back from them."""
    read = decode_media(encode_media(documents(spark, sf_dir)))
    feature = F.concat_ws(
        ";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("times")), F.concat(F.lit("entries="), F.size("entries")),
        F.concat(F.lit("last="), F.element_at("times", -1)), F.concat(F.lit("errors="), "errors"),
    )
    return read.select(
        F.col("id").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), F.size("entries").alias("random_access_points"), "errors",
    )
