"""Texts as MPEG transport streams: written, parsed and checked packet by packet in numpy, many documents at once.

A text is padded with spaces to a positive multiple of 192 bytes and cut into access units. Each unit is one PES packet with
a presentation time stamp, carried in 188-byte packets. Every sixteenth unit, the first included, is a random-access point: the
program tables (PAT, PMT) stand before it and its first packet has the random-access flag. Reading takes the stream's PID from
the tables, checks sync bytes and continuity counters, takes off the headers, and keeps the time stamps and access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_buffers

#: Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, CLOCK = 188, 0x47, 0x0000, 90_000
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06

PMT_PID, STREAM_PID, PROGRAM = 0x1000, 0x0100, 1
FRAME, UNIT, UNITS_PER_ACCESS, UNIT_TICKS = 192, 192 * 32, 16, CLOCK // 25
PES_HEADER, FIRST_ROOM, ROOM = 14, 176, 184
#: Bytes of text that are turned into streams in one step.
STEP = 1 << 20


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


@lru_cache(maxsize=1)
def table_packets() -> np.ndarray:
    """The two table packets with continuity counter 0."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0")
    packets = [bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section for pid, section in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.stack([np.frombuffer(p.ljust(PACKET, b"\xff"), np.uint8) for p in packets])


@lru_cache(maxsize=1024)
def parse_section(payload: bytes, table: int) -> tuple[int, int]:
    """(number, PID) of the first entry of a PAT (program, PMT) or PMT (stream type, stream) section after its pointer field."""
    at = 1 + payload[0]
    length = int.from_bytes(payload[at + 1 : at + 3], "big") & 0xFFF
    section = payload[at : at + 3 + length]
    if section[0] != table or crc32_mpeg(section):
        raise ValueError("broken program table")
    if table == 0:
        return int.from_bytes(section[8:10], "big"), int.from_bytes(section[10:12], "big") & 0x1FFF
    skip = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
    return section[skip], int.from_bytes(section[skip + 1 : skip + 3], "big") & 0x1FFF


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled with spaces to a positive multiple of FRAME."""
    lengths = np.diff(offsets)
    sizes = np.maximum(-(-lengths // FRAME), 1) * FRAME
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(starts[-1]), 32, np.uint8)
    out[_within(lengths) + np.repeat(starts[:-1], lengths)] = data[offsets[0] : offsets[-1]]
    return out, starts


def written(payload: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packets (n x 188) of all rows and each row's first packet."""
    sizes = np.diff(starts)
    units = -(-sizes // UNIT)
    row = np.repeat(np.arange(len(sizes)), units)
    unit = _within(units)
    length = np.minimum(UNIT, sizes[row] - unit * UNIT)
    access = unit % UNITS_PER_ACCESS == 0
    pes = length + PES_HEADER
    packets = 1 + np.maximum(0, -(-(pes - FIRST_ROOM) // ROOM))
    slots = packets + 2 * access
    first_slot = np.cumsum(slots) - slots
    out = np.full((int(slots.sum()), PACKET), 0xFF, np.uint8)

    tables = first_slot[access]
    turn = unit[access] // UNITS_PER_ACCESS % 16
    for k in (0, 1):
        out[tables + k] = table_packets()[k]
        out[tables + k, 3] = 0x10 | turn

    of = np.repeat(np.arange(len(pes)), packets)
    k = _within(packets)
    at = (first_slot + 2 * access)[of] + k
    carried = np.where(k == 0, np.minimum(pes[of], FIRST_ROOM), np.minimum(ROOM, pes[of] - FIRST_ROOM - (k - 1) * ROOM))
    counter = _within(np.bincount(row[of], minlength=len(sizes))) % 16
    out[at, 0] = SYNC
    out[at, 1] = np.where(k == 0, 0x40, 0) | STREAM_PID >> 8
    out[at, 2] = STREAM_PID & 0xFF
    out[at, 3] = counter | np.where(carried < ROOM, 0x30, 0x10)
    stuffed = at[carried < ROOM]
    out[stuffed, 4] = (PACKET - 5 - carried)[carried < ROOM]
    flagged = at[(carried < ROOM - 1) & (k > 0)]
    out[flagged, 5] = 0
    heads = at[k == 0]
    ticks = unit * UNIT_TICKS
    out[heads, 5] = np.where(access, 0x50, 0x10)
    out[heads[:, None], np.arange(6, 12)] = _clock_reference(ticks)

    head = PACKET - carried[k == 0]
    out[heads[:, None], head[:, None] + np.arange(PES_HEADER)] = _pes_header(length, ticks)
    header = np.where(k == 0, PES_HEADER, 0)
    body = carried - header
    out.reshape(-1)[_within(body) + np.repeat(at * PACKET + PACKET - body, body)] = payload
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, slots, len(sizes)))]).astype(np.int64)


def _clock_reference(ticks: np.ndarray) -> np.ndarray:
    base = ticks % (1 << 33)
    return np.stack([base >> 25, base >> 17, base >> 9, base >> 1, (base & 1) << 7 | 0x7E, base * 0], 1).astype(np.uint8)


def _pes_header(length: np.ndarray, ticks: np.ndarray) -> np.ndarray:
    rest, t, one = length + 8, ticks % (1 << 33), np.ones_like(ticks)
    fields = [one * 0, one * 0, one, one * PRIVATE_STREAM, rest >> 8, rest, one * 0x80, one * 0x80, one * 5, 0x21 | t >> 29 & 0x0E, t >> 22, t >> 14 | 1, t >> 7, t << 1 | 1]
    return np.stack([f & 0xFF for f in fields], 1).astype(np.uint8)


class Read:
    """What ``read`` found: payload bytes, each row's bounds in it, and the units' rows, time stamps and access flags."""

    def __init__(self, payload, starts, row, stamps, access):
        self.payload, self.starts, self.row, self.stamps, self.access = payload, starts, row, stamps, access


def read(media: np.ndarray, starts: np.ndarray) -> Read:
    """Parse streams; ``media`` is n x 188 and ``starts`` has each row's first packet. Raises ValueError on any damage."""
    if (media[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    counts = np.diff(starts)
    row = np.repeat(np.arange(len(counts)), counts)
    pid = (media[:, 1].astype(np.int64) & 0x1F) << 8 | media[:, 2]
    begins = (media[:, 1] & 0x40) > 0
    adapted, filled = (media[:, 3] & 0x20) > 0, (media[:, 3] & 0x10) > 0
    at = 4 + np.where(adapted, 1 + media[:, 4].astype(np.int64), 0)
    pmt_pid, stream = (np.full(len(counts), -1) for _ in range(2))
    for i in np.flatnonzero((pid == PAT_PID) & begins).tolist():
        pmt_pid[row[i]] = parse_section(media[i, at[i] :].tobytes(), 0)[1]
    for i in np.flatnonzero((pid == pmt_pid[row]) & begins).tolist():
        stream[row[i]] = parse_section(media[i, at[i] :].tobytes(), 2)[1]
    for wanted in (np.full(len(row), PAT_PID), pmt_pid[row], stream[row]):
        own = np.flatnonzero((pid == wanted) & filled)
        expected = _within(np.bincount(row[own], minlength=len(counts))) % 16
        if ((media[own, 3] & 0x0F) != expected).any():
            raise ValueError("a packet is missing")
    own = np.flatnonzero((pid == stream[row]) & filled)
    at, begins, of = at[own], begins[own], row[own]
    heads = own[begins]
    header = media[heads[:, None], at[begins][:, None] + np.arange(PES_HEADER)].astype(np.int64)
    if (header[:, :3] != [0, 0, 1]).any():
        raise ValueError("no packet start code")
    skip = np.zeros(len(own), np.int64)
    skip[begins] = 9 + header[:, 8]
    body = PACKET - at - skip
    unit = np.cumsum(begins) - 1
    if (np.bincount(unit, body) + header[:, 8] + 3 != (header[:, 4] << 8 | header[:, 5])).any():
        raise ValueError("a packet's length is wrong")
    stamps = (header[:, 9] >> 1 & 7) << 30 | header[:, 10] << 22 | header[:, 11] >> 1 << 15 | header[:, 12] << 7 | header[:, 13] >> 1
    access = adapted[heads] & (media[heads, 4] > 0) & ((media[heads, 5] & 0x40) > 0)
    payload = media.reshape(-1)[_within(body) + np.repeat(own * PACKET + PACKET - body, body)]
    return Read(payload, np.concatenate([[0], np.cumsum(np.bincount(of, body, len(counts)))]).astype(np.int64), row[heads], stamps, access)


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about STEP bytes."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
        yield a, b
        a = b


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every row; null texts count as empty, repeated rows and null ids stay.

    A text over ``STEP`` is a step of its own, with all of its stream in memory. Other columns are not looked at, an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in _steps(np.diff(offsets)):
                packets, starts = written(*padded(data, offsets[a : b + 1]))
                media = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(starts * PACKET), pa.py_buffer(packets.reshape(-1))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), media], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(made, f"`{id_col}` {kind}, n_bytes long, media binary")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What reading the stored streams gives: payload and media digests and a feature string, for (id, n_bytes, media).

    Damage fails the job, and so does media that is null or empty, since every text has a stream. Repeated rows and null ids stay, an
    empty table gives no rows.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if not len(column):
                continue
            if (np.diff(offsets) == 0).any():
                raise ValueError("a stream is missing")
            whole = np.frombuffer(column.buffers()[2], np.uint8)
            for a, b in _steps(np.diff(offsets)):
                packets = whole[offsets[a] : offsets[b]].reshape(-1, PACKET)
                found = read(packets, (offsets[a : b + 1] - offsets[a]) // PACKET)
                units = np.bincount(found.row, minlength=b - a)
                points = np.bincount(found.row, found.access, b - a).astype(int)
                last = found.stamps[np.cumsum(units) - 1]
                sums = np.add.reduceat(found.payload, found.starts[:-1], dtype=np.int64)
                out: list[list] = [[] for _ in range(6)]
                for i, (p, q) in enumerate(zip(found.starts[:-1].tolist(), found.starts[1:].tolist(), strict=True)):
                    payload, stored = found.payload[p:q], whole[offsets[a + i] : offsets[a + i + 1]]
                    feature = f"units={units[i]} access={points[i]} last={last[i] / CLOCK:.2f}s mean={sums[i] / (q - p):.3f}"
                    for values, x in zip(out, (q - p, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature), strict=True):
                        values.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, out)], names=names)

    return media.mapInArrow(made, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
