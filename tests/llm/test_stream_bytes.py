"""Stored transport streams read byte by byte, as the standard describes them, by code that shares nothing with the operator."""

import random

import pytest
from pyspark.sql import functions as F

from epochgraph.llm import transport


def crc(data):
    """CRC-32 of program tables, bit by bit: zero over a whole section."""
    register = [1] * 32
    for byte in data:
        for bit in range(7, -1, -1):
            out = register.pop(0) ^ (byte >> bit & 1)
            register.append(out)
            for place in (26, 23, 22, 16, 12, 11, 10, 8, 7, 5, 4, 2, 1):
                register[31 - place] ^= out
    return sum(register)


def section(payload):
    body = payload[1 + payload[0] :]
    size = 3 + ((body[1] & 0x0F) << 8 | body[2])
    assert body[1] & 0x80 and crc(body[:size]) == 0
    assert set(body[size:]) <= {0xFF}
    return body[: size - 4]


def demuxed(media):
    """(payload, [(time stamp, random access, clock)], table places): every field that a player looks at is checked."""
    assert len(media) % 188 == 0
    counters, units, tables, streams = {}, [], [], {}
    for at in range(0, len(media), 188):
        packet = media[at : at + 188]
        assert packet[0] == 0x47 and not packet[1] & 0x80 and not packet[3] & 0xC0  # in step, no error, not scrambled
        pid = (packet[1] & 0x1F) << 8 | packet[2]
        start, adaptation, counter = bool(packet[1] & 0x40), packet[3] >> 4 & 3, packet[3] & 15
        assert adaptation in (1, 3) and counter == (counters.get(pid, -1) + 1) % 16
        counters[pid] = counter
        payload, access, clock = packet[4:], False, None
        if adaptation == 3:
            size = packet[4]
            assert size <= 182
            if size:
                access = bool(packet[5] & 0x40)
                if packet[5] & 0x10:
                    base = int.from_bytes(packet[6:11], "big") >> 7
                    clock = base * 300 + (int.from_bytes(packet[10:12], "big") & 0x1FF)
                used = 1 + 6 * bool(packet[5] & 0x10)
                assert not packet[5] & 0x0F and set(packet[5 + used : 5 + size]) <= {0xFF}
            payload = packet[5 + size :]
        if pid == 0:
            s = section(payload)
            assert s[0] == 0 and len(s) == 12
            program = (s[10] & 0x1F) << 8 | s[11]
            tables.append(at // 188)
        elif pid == program:
            s = section(payload)
            assert s[0] == 2
            first = 12 + ((s[10] & 0x0F) << 8 | s[11])
            streams[(s[first + 1] & 0x1F) << 8 | s[first + 2]] = s[first]
            assert (s[8] & 0x1F) << 8 | s[9] in streams  # whose packets carry the clock
        else:
            assert pid in streams
            if start:
                units.append([b"", access, clock, at // 188])
            units[-1][0] += payload
    found, whole = [], b""
    for pes, access, clock, place in units:
        assert pes[:3] == b"\0\0\1" and int.from_bytes(pes[4:6], "big") == len(pes) - 6 and pes[6] >> 6 == 2 and pes[7] >> 6 == 2
        t = pes[9:14]
        assert t[0] >> 4 == 2 and t[0] & 1 and t[2] & 1 and t[4] & 1
        bits = f"{t[0] >> 1 & 7:03b}{t[1]:08b}{t[2] >> 1:07b}{t[3]:08b}{t[4] >> 1:07b}"
        found.append((int(bits, 2), access, clock, place))
        whole += pes[9 + pes[8] :]
    return whole, found, tables


def test_stored_form(spark):
    rng = random.Random(2)
    sizes = [0, 1, 191, 192, 193, 6143, 6144, 6145, 16 * 6144, 16 * 6144 + 1, 300_000, 1_300_000]
    texts = ["".join(rng.choices("ab é\nG", k=n)) for n in sizes] + [None, "x" * 6144]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = {r["doc_id"]: (r["n_bytes"], bytes(r["media"])) for r in transport.streams(docs).collect()}
    features = {r["doc_id"]: r["feature"] for r in transport.digests(transport.streams(docs)).collect()}
    assert len(media) == len(features) == len(texts)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        n, stored = media[i]
        payload, units, tables = demuxed(stored)
        assert n == len(data) and payload == data + b" " * (max(1, -(-n // 192)) * 192 - n)
        assert [t for t, *_ in units] == [k * 3600 for k in range(-(-len(payload) // 6144))]  # 25 units a second of 90,000 ticks
        assert [a for _, a, *_ in units] == [k % 16 == 0 for k in range(len(units))]
        assert all(clock == 300 * t for t, _, clock, _ in units)
        assert tables == [place - 2 for _, access, _, place in units if access]  # tables stand before each point
        mean = sum(payload) / len(payload)
        assert features[i] == f"units={len(units)} access={len(tables)} last={(len(units) - 1) / 25:.2f}s mean={mean:.3f}"


def test_missing_streams_fail(spark):
    media = transport.streams(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    for nothing in (F.lit(None).cast("binary"), F.lit(b"")):
        with pytest.raises(Exception, match="a stream is missing"):
            transport.digests(media.withColumn("media", F.when(F.col("doc_id") == 1, F.col("media")).otherwise(nothing))).collect()
