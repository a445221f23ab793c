"""Exact codecs of blocks of points: clocks, whole numbers, doubles, booleans and strings.

Written from the published descriptions: Simple-8b (Anh and Moffat, 2010), the XOR code of floating point
series (Pelkonen et al., 2015), zigzag and LEB128 integers. A block is: type, then three streams, each behind
its length as a signed varint: clocks, values, quality. Words are big-endian. The first byte of a stream has
the scheme in its upper half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidewell.operators import model

RAW, PACKED, RLE = 0, 1, 2
LARGEST_PACKED = 2**60 - 1
#: Fixed values of Simple-8b: how many values a word holds under each selector, and the bits of each.
PER_WORD = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS_EACH = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


def put_varint(x: int) -> bytes:
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = data[at]
        at += 1
        x |= (b & 0x7F) << shift
        if b < 0x80:
            return x, at
        shift += 7


def put_count(n: int) -> bytes:
    """A length or count: a signed varint, which doubles it."""
    return put_varint(n << 1)


def get_count(data: bytes, at: int) -> tuple[int, int]:
    x, at = get_varint(data, at)
    return x >> 1, at


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Of unsigned 64-bit numbers; 0 of 0."""
    n = np.frexp(x.astype(np.float64))[1].astype(np.int64)
    # a number that was rounded up to a power of two has one bit less
    over = (n > 64) | (n > 0) & ((x >> np.clip(n - 1, 0, 63).astype(np.uint64)) == 0)
    return n - over


def pack(values: np.ndarray | list[int]) -> bytes:
    """Simple-8b of values up to 2**60 - 1; each word takes as many of the next values as any selector lets it."""
    x = np.asarray(values, np.uint64)
    n = len(x)
    if not n:
        return b""
    width = bit_lengths(x)
    if width.max() > BITS_EACH[-1]:
        raise ValueError("a value above 2**60 - 1")
    place = np.arange(n)

    def run(bad: np.ndarray) -> np.ndarray:
        """From each place on, how many values come before the next bad one."""
        return np.minimum.accumulate(np.where(bad, place, n)[::-1])[::-1] - place

    choice = np.full(n, -1)
    free = np.ones(n, bool)
    runs: dict[int, np.ndarray] = {}
    for selector, (count, bits) in enumerate(zip(PER_WORD, BITS_EACH, strict=True)):
        if count > n:
            continue
        if bits not in runs:
            runs[bits] = run(width > bits) if bits else run(x != 1)
        fits = free & (runs[bits] >= count)
        choice[fits] = selector
        free &= ~fits
    step = np.array(PER_WORD)[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    chosen = choice[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        if bits := BITS_EACH[selector]:
            own = np.flatnonzero(chosen == selector)
            k = np.arange(PER_WORD[selector])
            words[own] |= np.bitwise_or.reduce(x[at[own, None] + k] << (k * bits).astype(np.uint64), axis=1)
    return words.astype(">u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    words = np.frombuffer(data, ">u8").astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count, bits = np.array(PER_WORD)[selector], np.array(BITS_EACH)[selector]
    width = np.repeat(bits, count).astype(np.uint64)
    nth = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    out = (np.repeat(words, count) >> (nth * width)) & ((np.uint64(1) << width) - np.uint64(1))
    out[width == 0] = 1
    return out


def packed_count(data: bytes) -> int:
    return int(np.array(PER_WORD)[np.frombuffer(data, ">u8").astype(np.uint64) >> np.uint64(60)].sum())


def encode_clocks(clocks: np.ndarray | list[int]) -> bytes:
    x = np.asarray(clocks, np.int64).view(np.uint64)
    if not len(x):
        return b""
    deltas = np.diff(x)
    first = x[:1].astype(">u8").tobytes()
    power = 12
    if len(deltas) and (deltas == deltas[0]).all():
        step = int(deltas[0])
        while step % 10**power:
            power -= 1
        return bytes([RLE << 4 | power]) + first + put_varint(step // 10**power << 1) + put_count(len(x))
    if len(deltas) and deltas.max() > LARGEST_PACKED:
        return bytes([RAW << 4]) + first + deltas.astype(">u8").tobytes()
    while power and (deltas % np.uint64(10**power)).any():
        power -= 1
    return bytes([PACKED << 4 | power]) + first + pack(deltas // np.uint64(10**power))


def clock_array(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    scheme, unit = data[0] >> 4, np.uint64(10 ** (data[0] & 15))
    first = np.frombuffer(data[1:9], ">u8").astype(np.uint64)
    if scheme == RLE:
        step, at = get_varint(data, 9)
        n, _ = get_count(data, at)
        return (first + np.arange(n, dtype=np.uint64) * np.uint64(step >> 1) * unit).view(np.int64)
    deltas = np.frombuffer(data[9:], ">u8").astype(np.uint64) if scheme == RAW else unpack(data[9:]) * unit
    return np.cumsum(np.concatenate([first, deltas]), dtype=np.uint64).view(np.int64)


def decode_clocks(data: bytes) -> list[int]:
    return clock_array(data).tolist()


def clock_count(data: bytes) -> int:
    """Points of a block, without decoding their clocks."""
    if not data:
        return 0
    scheme = data[0] >> 4
    if scheme == RLE:
        _, at = get_varint(data, 9)
        return get_count(data, at)[0]
    return (len(data) - 9) // 8 + 1 if scheme == RAW else 1 + packed_count(data[9:])


def zigzag_codes(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _zigzag(x: int) -> int:
    return int(zigzag_codes(np.array([x], np.int64))[0])


def encode_integers(values: np.ndarray | list[int]) -> bytes:
    x = np.asarray(values, np.int64)
    if not len(x):
        return b""
    d = np.concatenate([x[:1], np.diff(x)])  # wraps as 64-bit integers do
    codes = zigzag_codes(d)
    first, rest = codes[:1].astype(">u8").tobytes(), codes[1:]
    if len(rest) > 1 and (rest == rest[0]).all():
        return bytes([RLE << 4]) + first + put_varint(int(rest[0])) + put_count(len(rest))
    if len(rest) and rest.max() > LARGEST_PACKED:
        return bytes([RAW << 4]) + first + rest.astype(">u8").tobytes()
    return bytes([PACKED << 4]) + first + pack(rest)


def integer_array(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    first = np.frombuffer(data[1:9], ">u8").astype(np.uint64)
    scheme = data[0] >> 4
    if scheme == RLE:
        code, at = get_varint(data, 9)
        rest = np.full(get_count(data, at)[0], code, np.uint64)
    else:
        rest = np.frombuffer(data[9:], ">u8").astype(np.uint64) if scheme == RAW else unpack(data[9:])
    codes = np.concatenate([first, rest])
    d = (codes >> np.uint64(1)) ^ (np.uint64(0) - (codes & np.uint64(1)))
    return np.cumsum(d, dtype=np.uint64).view(np.int64)


def decode_integers(data: bytes) -> list[int]:
    return integer_array(data).tolist()


def encode_doubles(values: np.ndarray | list[float]) -> bytes:
    """XOR code; NaN ends the stream and cannot be a value."""
    x = np.append(np.asarray(values, np.float64), np.nan)
    if np.isnan(x[:-1]).any():
        raise ValueError("NaN is not stored")
    words = x.view(np.uint64)
    diff = words[1:] ^ words[:-1]
    leading = np.minimum(31, 64 - bit_lengths(diff)).tolist()
    trailing = (bit_lengths(diff & (np.uint64(0) - diff)) - 1).tolist()
    # which values open a window of their own, and the window of each
    lead, trail = -1, 0
    new, leads, trails = [], [], []
    for a, z in zip(leading, trailing, strict=True):
        opens = z >= 0 and not (0 <= lead <= a and z >= trail)
        if opens:
            lead, trail = a, z
        new.append(opens)
        leads.append(lead)
        trails.append(trail)
    new, leads, trails = np.array(new, bool), np.array(leads, np.int64), np.array(trails, np.int64)
    some = diff != 0
    size = 64 - leads - trails
    # two pieces for each value: what is said of its window, and its bits
    said = np.where(new, (3 << 11) | (leads << 6) | (size & 63), np.where(some, 2, 0)).astype(np.uint64)
    piece = np.stack([said, diff >> np.where(some, trails, 0).astype(np.uint64)], axis=1).ravel()
    length = np.stack([np.where(new, 13, np.where(some, 2, 1)), np.where(some, size, 0)], axis=1).ravel()
    nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    bits = (np.repeat(piece, length) >> (np.repeat(length, length) - 1 - nth).astype(np.uint64)) & np.uint64(1)
    first = np.unpackbits(words[:1].astype(">u8").view(np.uint8))
    return bytes([PACKED << 4]) + np.packbits(np.concatenate([first, bits.astype(np.uint8)])).tobytes()


def double_array(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0)
    body = np.frombuffer(data[1:], np.uint8)
    bits = np.unpackbits(body).tobytes()
    first = np.frombuffer(data[1:9], ">u8").astype(np.uint64)
    # where the bits of each value are; NaN ends the stream
    starts, sizes, trails = [], [], []
    at, lead, trail, total = 64, 0, 0, len(bits)
    padded = np.concatenate([body, np.zeros(9, np.uint8)])
    high = np.zeros(len(body) + 1, np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        high |= padded[k : k + len(high)].astype(np.uint64) << np.uint64(56 - 8 * k)
    whole = high.tolist()
    while at < total:
        if not bits[at]:
            at += 1
            starts.append(0)
            sizes.append(0)
            trails.append(0)
            continue
        if bits[at + 1]:
            at += 2
            said = whole[at >> 3] >> (53 - (at & 7)) & 2047
            lead = said >> 6
            trail = 64 - lead - ((said & 63) or 64)
            at += 11
        else:
            at += 2
        n = 64 - lead - trail
        starts.append(at)
        sizes.append(n)
        trails.append(trail)
        at += n
    start, size = np.array(starts, np.int64), np.array(sizes, np.int64)
    byte = start >> 3
    skip = (start & 7).astype(np.uint64)
    window = (high[byte] << skip) | (padded[byte + 8].astype(np.uint64) >> (np.uint64(8) - skip))
    value = np.where(size > 0, window >> np.where(size > 0, 64 - size, 0).astype(np.uint64), np.uint64(0)) << np.array(trails, np.uint64)
    words = np.bitwise_xor.accumulate(np.concatenate([first, value]))
    return words[: int(np.argmax(np.isnan(words.view(np.float64))))].view(np.float64)  # the bits that fill the last byte repeat NaN


def decode_doubles(data: bytes) -> list[float]:
    return double_array(data).tolist()


def encode_booleans(values: list[bool]) -> bytes:
    return bytes([PACKED << 4]) + put_count(len(values)) + np.packbits(np.array(values, bool)).tobytes()


def decode_booleans(data: bytes) -> list[bool]:
    if not data:
        return []
    n, at = get_count(data, 1)
    return np.unpackbits(np.frombuffer(data[at:], np.uint8))[:n].astype(bool).tolist()


def encode_strings(values: list[str]) -> bytes:
    raw = b"".join(put_count(len(b)) + b for b in (v.encode() for v in values))
    return bytes([PACKED << 4]) + put_varint(len(raw)) + pa.Codec("snappy").compress(raw, asbytes=True)


def decode_strings(data: bytes) -> list[str]:
    if not data:
        return []
    size, at = get_varint(data, 1)
    raw = pa.Codec("snappy").decompress(data[at:], size, asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, at = get_count(raw, at)
        out.append(raw[at : at + n].decode())
        at += n
    return out


ENCODE = {model.DOUBLE: encode_doubles, model.INTEGER: encode_integers, model.BOOLEAN: encode_booleans, model.STRING: encode_strings}
DECODE = {model.DOUBLE: double_array, model.INTEGER: integer_array, model.BOOLEAN: decode_booleans, model.STRING: decode_strings}


def encode_block(tag: int, clocks: np.ndarray | list[int], values: np.ndarray | list, quality: np.ndarray | list[int]) -> bytes:
    streams = (encode_clocks(clocks), ENCODE[tag](values), encode_integers(quality))
    return bytes([tag]) + b"".join(put_count(len(s)) + s for s in streams)


def split_block(block: bytes) -> tuple[int, bytes, bytes, bytes]:
    out, at = [], 1
    for _ in range(3):
        n, at = get_count(block, at)
        out.append(block[at : at + n])
        at += n
    return block[0], *out


def block_arrays(block: bytes, lo: int | None = None, hi: int | None = None) -> tuple[np.ndarray, np.ndarray | list, np.ndarray]:
    """Clocks, values and quality of a block, or of the inclusive range in it."""
    tag, clocks, values, quality = split_block(block)
    clock = clock_array(clocks)
    a = 0 if lo is None else int(np.searchsorted(clock, lo, "left"))
    z = len(clock) if hi is None else int(np.searchsorted(clock, hi, "right"))
    return clock[a:z], DECODE[tag](values)[a:z], integer_array(quality)[a:z]


def decode_block(block: bytes, lo: int | None = None, hi: int | None = None) -> list[tuple[int, object, int]]:
    """(clock, value, quality) of a block, or of the inclusive range in it."""
    clock, value, quality = block_arrays(block, lo, hi)
    return list(zip(clock.tolist(), value.tolist() if isinstance(value, np.ndarray) else value, quality.tolist(), strict=True))


def block_count(block: bytes) -> int:
    return clock_count(split_block(block)[1])
