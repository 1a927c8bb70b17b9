"""FLAC: exact round trips, an independent bit-by-bit reader, other writers' forms, and damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from mailrisk.llm import flac


class Reader:
    """Reads a stream bit by bit, as the format is written down."""

    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def slow_frames(stream):
    r = Reader(stream)
    r.at = 32
    last = 0
    while not last:
        last, _, size = r.take(1), r.take(7), r.take(24)
        r.at += 8 * size
    out = []
    while r.at < len(r.bits):
        assert r.take(14) == 0x3FFE
        r.at += 18
        ones = 0
        while r.take(1):
            ones += 1
        r.at += 7 - ones + 8 * max(0, ones - 1)
        n = r.take(16) + 1
        r.at += 8
        kind = r.take(8) >> 1
        if kind == 0:
            samples = [r.signed(8)] * n
        elif kind == 1:
            samples = [r.signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            samples = [r.signed(8) for _ in range(order)]
            shift, weights = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None
            if weights is None:
                precision, shift = r.take(4) + 1, r.take(5)
                weights = [r.signed(precision) for _ in range(order)]
            wide, parts = 4 + r.take(2), 1 << r.take(4)
            for p in range(parts):
                rice = r.take(wide)
                raw = r.take(5) if rice == (1 << wide) - 1 else None
                for _ in range(n // parts - (order if p == 0 else 0)):
                    if raw is not None:
                        residual = r.signed(raw)
                    else:
                        code = r.unary() << rice | r.take(rice)
                        residual = code >> 1 ^ -(code & 1)
                    samples.append(residual + (sum(w * samples[-1 - i] for i, w in enumerate(weights)) >> shift))
        r.at = -(-r.at // 8) * 8 + 16
        out += samples
    return bytes(s + 128 & 255 for s in out)


RNG = random.Random(4)
PAYLOADS = [
    bytes(64), b"x" * 4096, bytes(range(256)) * 5, RNG.randbytes(5000), b"The quick brown fox jumps. " * 300,
    bytes(128 + int(100 * np.sin(i / 30)) for i in range(3000)), b"\0\xff" * 700, bytes(i * i >> 8 & 255 for i in range(2500)),
    b"q" * 1024 + RNG.randbytes(1), "äöü€\U0001f600".encode() * 200,
]


@pytest.mark.parametrize("block", [16, 300, 1024])
@pytest.mark.parametrize("linear", [None, ((31, -17, 3), 4)])
def test_round_trip_and_independent_reader(block, linear):
    streams = flac.encode(PAYLOADS, block, linear)
    for payload, stream, (read, offsets) in zip(PAYLOADS, streams, flac.decode(streams), strict=True):
        assert read == payload
        assert offsets.tolist() == list(range(0, len(payload), block))
        if len(payload) < 3100:
            assert slow_frames(stream) == payload
    assert streams[:3] == flac.encode(PAYLOADS[:3], block, linear), "a stream does not depend on its batch"


def test_predictors_compress():
    smooth = bytes(128 + int(100 * np.sin(i / 90)) for i in range(20000))
    assert len(flac.encode([smooth])[0]) < 0.5 * len(smooth)


def _crc(data, bits, polynomial):
    value = 0
    for byte in data:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ polynomial if value >> (bits - 1) & 1 else value << 1) & (1 << bits) - 1
    return value


def written(samples, subframe_bits):
    """One frame of a subframe given as a string of bits, in a stream."""
    head = bytes((0xFF, 0xF8, 0x70, 0x02, 0)) + (len(samples) - 1).to_bytes(2, "big")
    head += bytes((_crc(head, 8, 0x07),))
    body = subframe_bits + "0" * (-len(subframe_bits) % 8)
    frame = head + int(body, 2).to_bytes(len(body) // 8, "big")
    frame += _crc(frame, 16, 0x8005).to_bytes(2, "big")
    raw = bytes(s & 255 for s in samples)
    info = bytes(2) + bytes(8) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    points = bytes(8) + bytes(8) + len(samples).to_bytes(2, "big")
    return b"fLaC" + (34).to_bytes(4, "big") + info + (0x83 << 24 | 18).to_bytes(4, "big") + points + frame


def _twos(value, width):
    return f"{value & (1 << width) - 1:0{width}b}" if width else ""


def test_partitions_escapes_and_long_codes_of_other_writers():
    rng = random.Random(8)
    samples = [rng.randint(-128, 127) for _ in range(32)]
    residual = [samples[i] - samples[i - 1] for i in range(1, 32)]
    bits = "0" + f"{9:06b}" + "0" + _twos(samples[0], 8) + "01" + f"{2:04b}"  # order 1, five-bit parameters, four partitions
    at = 0
    for part, rice in enumerate((0, 31, 7, 3)):
        n = 7 if part == 0 else 8
        bits += f"{rice:05b}" + (f"{9:05b}" if rice == 31 else "")
        for value in residual[at : at + n]:
            code = 2 * value if value >= 0 else -2 * value - 1
            bits += _twos(value, 9) if rice == 31 else "0" * (code >> rice) + "1" + (f"{code & (1 << rice) - 1:0{rice}b}" if rice else "")
        at += n
    stream = written(samples, bits)
    want = bytes(s + 128 for s in samples)
    assert flac.decode([stream, flac.encode([PAYLOADS[4]])[0]])[0][0] == want == slow_frames(stream)


def test_long_frame_numbers():
    payload = RNG.randbytes(16 * 2100)
    stream = flac.encode([payload], 16)[0]
    assert flac.decode([stream])[0][0] == payload == slow_frames(stream)


def test_damage_is_found():
    stream = flac.encode([PAYLOADS[4]])[0]
    begins = 4 + 4 + 34 + 4 + 18 * len(range(0, len(PAYLOADS[4]), 1024))
    for at in [0, *RNG.sample(range(begins, len(stream)), 60)]:
        bad = bytearray(stream)
        bad[at] ^= 1 << RNG.randrange(8)
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])
    with pytest.raises(flac.FlacError):
        flac.decode([stream[:-3]])


def test_payload():
    assert [len(flac.payload_of(x)) for x in (None, b"", b"a", b"a" * 64, b"a" * 65)] == [64, 64, 64, 64, 128]


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (2, "same", "b"), (None, "same", "b"), (3, "long text " * 90000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blocks string")
    read = flac.read_media(flac.write_media(docs)).collect()
    got = sorted((r.n_bytes, b"".join(b.pcm for b in r.blocks)) for r in read)
    assert got == sorted((len(t or ""), flac.payload_of((t or "").encode())) for _, t, _ in rows)
    assert flac.write_media(docs.limit(0)).count() == 0
    lost = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert flac.read_media(lost).collect()[0].blocks is None


def test_query(spark):
    from mailrisk.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_flac"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = flac.payload_of(texts[r.doc_id])
        stream = flac.encode([data])[0]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(data), zlib.crc32(data[-64:]))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(stream).hexdigest())
        assert r.media_bytes == len(stream)
