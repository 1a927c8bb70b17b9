"""FLAC in numpy: 8-bit mono samples, all frames of a batch at once.

A frame is a lane of an array. Encoding chooses per frame the cheapest of constant, fixed
predictors of order 0 to 4, linear predictors given by coefficients, and verbatim.
Decoding takes one sample of every frame at a time: it reads a Rice code with a leading-zero
count, adds the prediction, and moves each lane's bit position on. A seek table has a point
per frame, so frames are found, checked and decoded without each other.

The format is that of RFC 9639. Written streams have one channel, 8 bits per sample and a
fixed block size; read streams may also have partitioned and escaped residuals and
linear predictors of any order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailrisk.llm.common import as_bytes, pieces

BLOCK = 1024
RATE = 8000
#: Bytes of samples, encoded or decoded, that one array step holds.
BYTES_AT_ONCE = 1 << 20

#: Fixed values of the format: predictor weights of the fixed orders, by distance.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SYNC = 0b11111111111110


class FlacError(ValueError):
    """The stream is not one this reader can trust: bad magic, layout or checksum."""


# --- checksums ------------------------------------------------------------------


@lru_cache(maxsize=4)
def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    table = np.zeros(256, np.uint32)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & top else value << 1) & mask
        table[byte] = value
    return table


def crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of many byte ranges, a byte of each per step; the longest lanes last."""
    table = _crc_table(bits, 0x07 if bits == 8 else 0x8005)
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order].copy(), sizes[order]
    value = np.zeros(len(at), np.uint32)
    live = np.searchsorted(-left, -np.arange(1, (left.max() if len(left) else 0) + 1), side="right")
    for n in live.tolist():
        value[:n] = (value[:n] << 8 & ((1 << bits) - 1)) ^ table[(value[:n] >> (bits - 8)) ^ data[at[:n]]]
        at[:n] += 1
    out = np.empty_like(value)
    out[order] = value
    return out


# --- writing ----------------------------------------------------------------------


def _number(value: int) -> bytes:
    """A frame number in the format's extended UTF-8 coding."""
    if value < 0x80:
        return bytes((value,))
    tail = []
    while True:
        tail.append(0x80 | value & 0x3F)
        value >>= 6
        room = 6 - len(tail)
        if value < 1 << room:
            return bytes(((0xFF << (room + 1) & 0xFF) | value, *reversed(tail)))


@lru_cache(maxsize=100_000)
def _frame_header(number: int, samples: int) -> bytes:
    """Sync, fixed block size, rate and bits from the stream's header, mono; ends with its CRC-8."""
    head = bytes((0xFF, 0xF8, 0x70, 0x02)) + _number(number) + (samples - 1).to_bytes(2, "big")
    table, value = _crc_table(8, 0x07), 0
    for byte in head:
        value = int(table[value ^ byte])
    return head + bytes((value,))


@dataclass
class _Lanes:
    """Frames of many streams: first sample, number of samples, and number within the stream."""

    start: np.ndarray
    size: np.ndarray
    number: np.ndarray
    stream: np.ndarray


def _lay_out(sizes: np.ndarray, block: int) -> _Lanes:
    frames = -(-sizes // block)
    stream = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = np.repeat(np.cumsum(sizes) - sizes, frames) + number * block
    return _Lanes(start, np.minimum(block, np.repeat(sizes, frames) - number * block), number, stream)


def encode(payloads: list[bytes], block: int = BLOCK, linear: tuple[tuple[int, ...], int] | None = None) -> list[bytes]:
    """FLAC streams of 8-bit samples (byte minus 128). Every payload has at least 16 bytes.

    `linear` adds a quantised linear predictor (coefficients, shift) to the choices.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    lanes = _lay_out(sizes, block)
    grid = np.zeros((len(lanes.start), block), np.int32)
    inside = np.arange(block)[None, :] < lanes.size[:, None]
    grid[inside] = samples  # rows are filled in the order of the frames, which is that of the samples

    best_bits = lanes.size * 8 + 8  # verbatim
    best_kind = np.full(len(grid), -1)
    best_rice = np.zeros(len(grid), np.int64)
    best_codes = np.zeros_like(grid, dtype=np.uint16)
    kinds = [(order, FIXED[order], 0) for order in range(5)]
    if linear:
        kinds.append((5, linear[0], linear[1]))
    for kind, weights, shift in kinds:
        order = len(weights)
        residual = grid.copy()
        predicted = np.zeros((len(grid), block - order), np.int32)
        for back, weight in enumerate(weights, 1):
            predicted += weight * grid[:, order - back : block - back]
        residual[:, order:] -= predicted >> shift
        codes = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
        codes[:, :order] = 0
        codes[~inside] = 0
        count = np.maximum(lanes.size - order, 1)
        total = codes.sum(axis=1, dtype=np.int64)
        rice = np.clip(np.ceil(np.log2(np.maximum(total / count, 1) * 0.6931 + 1e-9)), 0, 14).astype(np.int64)
        quotients = (codes >> rice[:, None]).astype(np.int64)
        bits = 8 + 8 * order + 10 + quotients.sum(axis=1) + count * (rice + 1) + (9 + 14 * order if kind == 5 else 0)
        # A quotient over 24 or a residual that does not fit is left to the verbatim form.
        usable = (lanes.size > order) & (quotients.max(axis=1) <= 24) & (bits < best_bits)
        best_bits = np.where(usable, bits, best_bits)
        best_kind = np.where(usable, kind, best_kind)
        best_rice = np.where(usable, rice, best_rice)
        best_codes[usable] = codes[usable]
    constant = (grid == grid[:, :1]).sum(axis=1, where=inside) == lanes.size
    best_kind[constant] = -2
    best_bits[constant] = 16
    return _write(payloads, sizes, lanes, grid, inside, best_kind, best_rice, best_codes, best_bits, block, linear)


def _write(payloads, sizes, lanes, grid, inside, kind, rice, codes, bits, block, linear) -> list[bytes]:
    weights = {k: len(FIXED[k]) for k in range(5)} | ({5: len(linear[0])} if linear else {})
    order = np.array([weights.get(int(k), 0) for k in kind])
    coded = kind >= 0
    # Width and value of each sample's field: a stop bit and the low bits of a code, or the sample itself.
    column = np.arange(grid.shape[1])[None, :]
    as_code = coded[:, None] & (column >= order[:, None]) & inside
    plain = inside & ~as_code & ~((kind == -2)[:, None] & (column > 0))
    tail = np.where(as_code, rice[:, None] + 1, np.where(plain, 8, 0))
    zeros = np.where(as_code, codes >> rice[:, None], 0)
    value = np.where(as_code, (1 << rice)[:, None] | codes & ((1 << rice) - 1)[:, None], grid & 255)
    # After the warm-up samples of a coded frame comes its residual header, before them the subframe header.
    lead = np.full(len(grid), 8)
    middle = np.where(coded, 10, 0) + np.where(kind == 5, 9 + 14 * order, 0)
    ends = np.cumsum(zeros + tail, axis=1) + lead[:, None]
    ends = np.where(column >= order[:, None], ends + middle[:, None], ends)
    headers = [_frame_header(int(n), int(s)) for n, s in zip(lanes.number, lanes.size, strict=True)]
    head = np.array([len(h) for h in headers])
    body = -(-bits // 8)
    size = head + body + 2
    at = np.cumsum(size) - size
    stream_bits = np.zeros(int(size.sum()) * 8, np.uint8)
    base = (at + head) * 8

    def put(place: np.ndarray, number, width: int) -> None:
        """Writes numbers of a width so that they end before the place."""
        for low in range(width):
            stream_bits[place - 1 - low] = number >> low & 1

    kinds = np.where(kind == -2, 0, np.where(kind == -1, 1, np.where(kind == 5, 32 + order - 1, 8 + kind)))
    put(base + 8, kinds << 1, 8)
    rows = np.flatnonzero(coded)
    after_warm = base + 8 + 8 * order
    if linear and (kind == 5).any():
        own = np.flatnonzero(kind == 5)
        put(after_warm[own] + 4, np.full(len(own), 13), 4)  # 14-bit coefficients
        put(after_warm[own] + 9, np.full(len(own), linear[1]), 5)
        for i, coefficient in enumerate(linear[0]):
            put(after_warm[own] + 9 + 14 * (i + 1), np.full(len(own), coefficient & 0x3FFF), 14)
    parameter = after_warm[rows] + np.where(kind[rows] == 5, 9 + 14 * order[rows], 0) + 10
    put(parameter, rice[rows], 4)
    place = ends + base[:, None]
    widths = np.unique(tail)
    for width in widths[widths > 0].tolist():
        own = tail == width
        put(place[own], value[own], width)
    packed = np.packbits(stream_bits)
    joined = np.frombuffer(b"".join(headers), np.uint8)
    within = np.arange(len(joined)) - np.repeat(np.cumsum(head) - head, head)
    packed[np.repeat(at, head) + within] = joined
    check = crc(packed, at, head + body, 16)
    packed[at + head + body], packed[at + head + body + 1] = check >> 8, check & 255
    return _join(payloads, sizes, lanes, packed, at, size, block)


def _join(payloads, sizes, lanes, packed, at, size, block) -> list[bytes]:
    frames = np.bincount(lanes.stream, minlength=len(payloads))
    first = np.cumsum(frames) - frames
    whole, out = packed.tobytes(), []
    for i, payload in enumerate(payloads):
        own = slice(int(first[i]), int(first[i] + frames[i]))
        points = np.empty(frames[i], np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        points["sample"], points["count"] = lanes.number[own] * block, lanes.size[own]
        points["offset"] = at[own] - at[own.start]
        info = (
            block.to_bytes(2, "big") * 2 + int(size[own].min()).to_bytes(3, "big") + int(size[own].max()).to_bytes(3, "big")
            + (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big")
            + hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
        )
        table = points.tobytes()
        out.append(
            b"fLaC" + (34).to_bytes(4, "big") + info + (0x83 << 24 | len(table)).to_bytes(4, "big") + table
            + whole[int(at[own.start]) : int(at[own.stop - 1] + size[own.stop - 1])]
        )
    return out


# --- reading ----------------------------------------------------------------------


@dataclass
class _Head:
    samples: int
    md5: bytes
    points: np.ndarray  # sample, offset, count
    data: int  # where frames begin


def _read_head(stream: bytes) -> _Head:
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, info, points = 4, None, None
    while True:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut off")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("metadata is cut off")
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        at += 4 + size
        if last:
            break
    if info is None or points is None:
        raise FlacError("stream header or seek table is missing")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise FlacError("only one channel of 8 bits is read")
    return _Head(packed & (1 << 36) - 1, info[18:34], points[points["sample"] != (1 << 64) - 1], at)


class _Bits:
    """Bits of one buffer, read at many places at once."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)  # the eight bytes from each byte on
        for i in range(8):
            self.words |= padded[i : i + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.end = 8 * len(data)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place, of which at least 57 are real."""
        if len(at) and int(at.max()) > self.end:
            raise FlacError("a frame runs past the end")
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Numbers of up to 32 bits; widths may differ, and 0 gives 0."""
        wide = np.asarray(width, np.uint64)
        return (self.peek(at) >> np.uint64(1) >> (np.uint64(63) - wide)).astype(np.int64)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """How many zero bits come before the next one bit."""
        top = (self.peek(at) >> np.uint64(32)).astype(np.float64)
        count = 32 - np.frexp(top)[1].astype(np.int64)
        more = np.flatnonzero(top == 0)
        if len(more):
            count[more] = 32 + self.zeros(at[more] + 32)
        return count


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload bytes, offsets of its blocks in samples) of each stream; raises FlacError on damage."""
    heads = [_read_head(s) for s in streams]
    counts = np.array([len(h.points) for h in heads])
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams[:-1])]) if streams else np.zeros(0, np.int64)
    if not counts.sum():
        if any(h.samples for h in heads):
            raise FlacError("samples without frames")
        return [(b"", np.zeros(0, np.int64)) for _ in heads]
    points = np.concatenate([h.points for h in heads])
    owner = np.repeat(np.arange(len(heads)), counts)
    start = points["offset"].astype(np.int64) + (base + [h.data for h in heads])[owner]
    ends = base + [len(s) for s in streams]
    end = np.where(np.r_[owner[1:] != owner[:-1], True], ends[owner], np.r_[start[1:], 0])
    if (end <= start + 8).any():
        raise FlacError("seek points are out of order")
    sizes, first = _check_headers(data, start, end, points["count"].astype(np.int64))
    check = crc(data, start, end - start - 2, 16)
    if (check != data[end - 2].astype(np.uint32) << 8 | data[end - 1]).any():
        raise FlacError("a frame's checksum is wrong")
    samples = _decode_frames(_Bits(data), first * 8, sizes)
    payload = ((samples[np.arange(samples.shape[1])[None, :] < sizes[:, None]] + 128) & 255).astype(np.uint8).tobytes()
    out, at, k = [], 0, 0
    for head, n in zip(heads, counts, strict=True):
        own, k = points[k : k + n], k + n
        offsets = own["sample"].astype(np.int64)
        if int(own["count"].sum()) != head.samples or (n and (offsets != np.cumsum(own["count"].astype(np.int64)) - own["count"]).any()):
            raise FlacError("frames do not hold the samples that the header names")
        part, at = payload[at : at + head.samples], at + head.samples
        if head.md5 != bytes(16) and hashlib.md5((np.frombuffer(part, np.uint8) ^ 128).tobytes()).digest() != head.md5:
            raise FlacError("the samples' checksum is wrong")
        out.append((part, offsets))
    return out


def _check_headers(data, start, end, count) -> tuple[np.ndarray, np.ndarray]:
    """Block sizes, and where the subframes begin. Sync code and CRC-8 are verified."""
    sync = data[start].astype(np.int64) << 6 | data[start + 1] >> 2
    if (sync != SYNC).any() or (data[start + 2] >> 4 != 7).any() or (data[start + 3] >> 4 != 0).any():
        raise FlacError("no frame where the seek table says, or of another layout")
    lead = data[start + 4].astype(np.int64)
    extra = np.where(lead < 0x80, 0, 7 - np.frexp((~lead & 0xFF).astype(float))[1])
    size_at = start + 5 + extra
    sizes = (data[size_at].astype(np.int64) << 8 | data[size_at + 1]) + 1
    if (crc(data, start, size_at + 2 - start, 8) != data[size_at + 2]).any():
        raise FlacError("a frame header's checksum is wrong")
    if (sizes != count).any() or (size_at + 3 >= end).any():
        raise FlacError("a frame does not hold the samples that the seek table names")
    return sizes, size_at + 3


def _decode_frames(bits: _Bits, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples (frames x longest). One sample of every frame is decoded per step."""
    lanes = len(at)
    head = bits.take(at, 8)
    kind, at = head >> 1 & 63, at + 8
    if (head & 0x81).any():
        raise FlacError("padding is not zero, or bits are wasted")
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise FlacError("a reserved kind of subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    if (order > sizes).any():
        raise FlacError("a predictor is longer than its frame")
    longest, most = int(sizes.max()), int(order.max())
    # Samples by step, after `most` rows of zeros so that a prediction may look back from the first.
    out = np.zeros((most + longest, lanes), np.int64)
    for i in range(most):
        own = np.flatnonzero(order > i)
        out[most + i, own] = _signed(bits.take(at[own], 8), 8)
        at[own] += 8
    weights, shift = np.zeros((max(most, 4), lanes), np.int64), np.zeros(lanes, np.int64)
    for i, row in enumerate(FIXED):
        for back, weight in enumerate(row):
            weights[back, fixed & (order == i)] = weight
    own = np.flatnonzero(linear)
    if len(own):
        precision = bits.take(at[own], 4) + 1
        shift[own] = bits.take(at[own] + 4, 5)
        if (precision == 16).any() or (shift[own] > 15).any():
            raise FlacError("a reserved precision or shift")
        at[own] += 9
        for back in range(most):
            use = order[own] > back
            weights[back, own[use]] = _signed(bits.take(at[own[use]], precision[use]), precision[use])
            at[own[use]] += precision[use]
    coded = fixed | linear
    method, split = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    own = np.flatnonzero(coded)
    method[own], split[own] = bits.take(at[own], 2), bits.take(at[own] + 2, 4)
    if (method > 1).any() or (coded & (sizes & (1 << split) - 1 != 0)).any():
        raise FlacError("a reserved residual coding, or partitions that do not fit")
    at[own] += 6
    part = sizes >> split
    if (coded & (part < order)).any():
        raise FlacError("a partition is shorter than the predictor")
    width, rice, raw = np.where(verbatim | constant, 8, 0), np.zeros(lanes, np.int64), np.zeros(lanes, bool)
    # Lanes of one kind and equal layout take the same path, so steps work on whole arrays.
    groups = {}
    for name, mask in (("verbatim", verbatim), ("coded", coded)):
        if mask.any():
            groups[name] = np.flatnonzero(mask)
    if constant.any():
        own = np.flatnonzero(constant)
        out[most:, own] = _signed(bits.take(at[own], 8), 8)[None, :]
    if "verbatim" in groups:
        own = groups["verbatim"]
        for step in range(int(sizes[own].max())):
            use = own[sizes[own] > step]
            out[most + step, use] = _signed(bits.take(at[use] + 8 * step, 8), width[use])
    if "coded" in groups:
        _decode_residuals(bits, at, sizes, order, weights, shift, method, part, rice, raw, out, groups["coded"], most)
    return out[most:].T


def _decode_residuals(bits, at, sizes, order, weights, shift, method, part, rice, raw, out, lanes, most) -> None:
    by_size = lanes[np.argsort(-sizes[lanes], kind="stable")]
    at, sizes, order, shift, method, part = (x[by_size] for x in (at, sizes, order, shift, method, part))
    weights, column = weights[:, by_size], out[:, by_size]
    rice, escape, width = (np.zeros(len(by_size), np.int64) for _ in range(3))
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    orders_end, predictors = int(order.max()), [i for i in range(len(weights)) if weights[i].any()]
    begins = {int(x) for x in np.unique(part)}
    for step, n in enumerate(live.tolist()):
        # A partition begins at multiples of its size; the first has fewer samples by the order.
        opens = step == 0 or any(step % size == 0 for size in begins)
        if opens or step <= orders_end:
            first = np.flatnonzero((step == order[:n]) & (step < part[:n]) | (step % part[:n] == 0) & (step >= order[:n]) & (step > 0))
            first = np.unique(first)
            if len(first):
                wide = 4 + method[first]
                rice[first] = bits.take(at[first], wide)
                escape[first] = rice[first] == (1 << wide) - 1
                at[first] += wide
                out_of = first[escape[first] == 1]
                if len(out_of):
                    width[out_of] = bits.take(at[out_of], 5)
                    at[out_of] += 5
        if step < orders_end or escape[:n].any():
            use = np.flatnonzero((step >= order[:n]) & (escape[:n] == 0))
            own = np.flatnonzero((step >= order[:n]) & (escape[:n] == 1))
            if len(own):
                value = _signed(bits.take(at[own], width[own]), width[own])
                at[own] += width[own]
                column[most + step, own] = value + _predict(column, weights, shift, predictors, most + step, own)
            if len(use):
                value, at[use] = _rice(bits, at[use], rice[use])
                column[most + step, use] = value + _predict(column, weights, shift, predictors, most + step, use)
        else:
            value, at[:n] = _rice(bits, at[:n], rice[:n])
            column[most + step, :n] = value + _predict(column, weights, shift, predictors, most + step, slice(0, n))
    out[:, by_size] = column


def _rice(bits: _Bits, at: np.ndarray, rice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    zeros = bits.zeros(at)
    low = at + zeros + 1
    code = zeros << rice | bits.take(low, rice)
    return code >> 1 ^ -(code & 1), low + rice


def _predict(column, weights, shift, predictors, row, lanes):
    if not predictors:
        return 0
    total = 0
    for i in predictors:
        total = total + weights[i, lanes] * column[row - 1 - i, lanes]
    return total >> shift[lanes]


def _signed(value: np.ndarray, width) -> np.ndarray:
    """Two's complement of the given widths; width 0 is 0."""
    top = np.where(np.asarray(width) > 0, 1 << np.maximum(np.asarray(width) - 1, 0), 1)
    return (value ^ top) - np.where(np.asarray(width) > 0, top, 1)


# --- operators ----------------------------------------------------------------------


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 bytes followed by bytes 0 up to a positive multiple of 64."""
    data = text or b""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def write_media(documents: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC stream. Null counts as empty.

    Equal texts give equal streams. Rows are independent and there is no shuffle; a task holds
    the samples of a few megabytes of text at a time, or of one text.
    """
    source = documents.select("doc_id", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, BYTES_AT_ONCE):
                texts = as_bytes(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()),
                     pa.array(encode([payload_of(t) for t in texts], block), pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_bytes long, media binary")


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with `blocks`, an array of (sample_offset, pcm) of each stream; a block can be read alone.

    Frame and stream checksums are verified; damage fails the job, with what is wrong.
    A null stream has null blocks. A column named `blocks` is replaced.
    """
    kept = media.drop("blocks")
    names = kept.columns
    kind = "array<struct<sample_offset:bigint,pcm:binary>>"
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes), f"blocks {kind}"])
    arrow = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, media_col, BYTES_AT_ONCE):
                streams = part.column(media_col).to_pylist()
                read = iter(decode([s for s in streams if s is not None]))
                made = []
                for stream in streams:
                    if stream is None:
                        made.append(None)
                        continue
                    payload, offsets = next(read)
                    ends = [*offsets[1:].tolist(), len(payload)]
                    made.append([{"sample_offset": i, "pcm": payload[i:j]} for i, j in zip(offsets.tolist(), ends, strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow)], names=[*names, "blocks"])

    return kept.mapInArrow(run, schema)


def features(samples: np.ndarray) -> str:
    """Integer features of unsigned 8-bit samples: sum, sum of squares, zero crossings about 128, peak."""
    wave = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((wave[1:] >= 0) != (wave[:-1] >= 0)))
    return f"sum={int(wave.sum())};energy={int((wave * wave).sum())};crossings={crossings};peak={int(np.abs(wave).max(initial=0))}"


def digests(media: DataFrame) -> DataFrame:
    """One row per document, of what `read_media` gives back for the stored stream."""
    read = read_media(media).select("doc_id", "n_bytes", "media", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream, blocks in zip(batch.column(2), batch.column(3), strict=True):
                payload = b"".join(blocks.values.field("pcm").to_pylist())
                stored = stream.as_py()
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored),
                    hashlib.sha256(stored).hexdigest(), features(np.frombuffer(payload, np.uint8)),
                ))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = dict(read.dtypes)["doc_id"]
    return read.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                                "media_bytes long, media_sha256 string, feature string")
