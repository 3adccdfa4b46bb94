"""A lane-parallel FLAC codec in numpy: each step works on one sample of many frames at once.

Encoder: mono 8-bit, frames of 576 samples, one seek point for each frame. Decoder: mono, 4 to 16 bits, any block
size, all subframe types. It starts at the seek points, and from there walks on frame by frame where a stream has
fewer of them than frames.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
RATE = 8000
LPC_ORDER, LPC_BITS = 8, 10
PARTITION_ORDER = 2
BIAS = 128  # unsigned payload bytes are stored as signed samples
#: Frames that the encoder works on at once, and bytes of streams that the decoder does: a longer stream is cut at its
#: seek points, so memory follows these and not the longest stream.
LANES, SPAN = 910, 1 << 19


class FlacError(ValueError):
    """A stream that isn't FLAC of the kinds above, or whose checksums don't hold."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: The 16-bit checksum after two bytes at once.
CRC16_PAIR = CRC16[CRC16[np.arange(1 << 16) >> 8] >> 8 ^ np.arange(1 << 16) & 255] ^ (CRC16[np.arange(1 << 16) >> 8] << 8 & 0xFFFF)


def crc_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each data[start:start + length]. Zeros in front leave it as it is, so ends are lined up."""
    crc, most = np.zeros(len(starts), np.int32), int(lengths.max(initial=0))
    if not most:
        return crc
    most += most & 1
    back = np.arange(most, 0, -1)[:, None]
    rows = np.where(back <= lengths, data[np.maximum(starts + lengths - back, 0)], np.uint8(0))
    if bits == 8:
        for byte in rows:
            crc = CRC8[crc ^ byte]
        return crc
    for pair in rows[::2].astype(np.int32) << 8 | rows[1::2]:
        crc = CRC16_PAIR[crc ^ pair]
    return crc


# ---------------------------------------------------------------- encoder


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as FLAC codes them: (frames, 6) bytes and how many of them count."""
    size = 1 + sum((n >= x).astype(np.int64) for x in (0x80, 0x800, 0x10000, 0x200000, 0x4000000))
    out = np.zeros((len(n), 6), np.int64)
    for k in range(1, 7):
        m = size == k
        if m.any():
            x = n[m]
            for j in range(k - 1, 0, -1):
                out[m, j] = 0x80 | (x & 0x3F)
                x = x >> 6
            out[m, 0] = x if k == 1 else (0xFF << (8 - k) & 0xFF) | x
    return out, size


def _pack(values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fields (value below 2^17, its bits; more bits than the value has are zeros in front) as bytes.

    Each row's bits must be whole bytes. Returns the bytes of all rows and the bytes of each.
    """
    length = bits.sum(1) >> 3
    end = np.cumsum(bits.ravel(), dtype=np.int64)
    keep = np.flatnonzero(values.ravel())
    end, v = end[keep], values.ravel()[keep].astype(np.int64)
    at, v = (end - 1) >> 3, v << ((8 - (end & 7)) & 7)
    n = int(length.sum())
    out = np.bincount(at, v & 255, n)
    for k in (1, 2):
        part = v >> (8 * k) & 255
        some = np.flatnonzero(part)
        out += np.bincount(at[some] - k, part[some], n)
    return out.astype(np.uint8), length


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients (frames, LPC_ORDER) and their shifts, by autocorrelation and Levinson-Durbin."""
    f = x.astype(np.float64)
    f = (f - f.mean(1, keepdims=True)) * np.hanning(f.shape[1] + 2)[1:-1]
    n, p = f.shape[1], LPC_ORDER
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : n - k]) for k in range(p + 1)], 1)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    a, err = np.zeros((len(f), p)), r[:, 0].copy()
    for i in range(p):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        prev = a[:, :i].copy()
        a[:, :i] = prev - k[:, None] * prev[:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    peak = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(peak)).astype(np.int64), 0, 14)
    most = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int64), shift


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of the rows of x (samples): all bytes in the rows' order, and bytes of each."""
    n_frames, n = x.shape
    x = x.astype(np.int32)
    kinds = [x]
    for _ in range(4):
        kinds.append(np.diff(kinds[-1], axis=1))
    coefs, shift = _lpc(x)
    guess, narrow = np.zeros((n_frames, n - LPC_ORDER), np.int32), coefs.astype(np.int32)
    for j in range(LPC_ORDER):
        guess += narrow[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    kinds.append(x[:, LPC_ORDER:] - (guess >> shift[:, None].astype(np.int32)))
    cost = np.stack([np.abs(k).sum(1) for k in kinds], 1)
    cost[:, 5] += n // 4  # its coefficients take room
    best = cost.argmin(1)
    best[(x == x[:, :1]).all(1)] = 6
    number, size = _utf8_number(numbers)
    head = np.concatenate([np.tile(np.array([0xFF, 0xF8, 0x20, 0x02], np.int64), (n_frames, 1)), number], 1)
    head_bits = np.concatenate([np.full((n_frames, 4), 8, np.int64), np.where(np.arange(6) < size[:, None], 8, 0)], 1)
    flat, length = _pack(head, head_bits)
    crc8 = crc_of(flat, np.cumsum(length) - length, length, 8)
    head, head_bits = np.concatenate([head, crc8[:, None]], 1), np.concatenate([head_bits, np.full((n_frames, 1), 8)], 1)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind in range(7):
        rows = np.flatnonzero(best == kind)
        if not len(rows):
            continue
        g, own = len(rows), x[rows]
        col = lambda v, b, g=g: (np.broadcast_to(np.asarray(v, np.int64).reshape(-1, 1), (g, 1)), np.broadcast_to(np.asarray(b, np.int64).reshape(-1, 1), (g, 1)))
        verbatim = [(own & 255, np.full((g, n), 8, np.int64))]
        if kind == 6:
            fields = [col(0, 8), (own[:, :1] & 255, np.full((g, 1), 8, np.int64))]
        else:
            order = LPC_ORDER if kind == 5 else kind
            fields = [col((32 | LPC_ORDER - 1) << 1 if kind == 5 else (8 | kind) << 1, 8), (own[:, :order] & 255, np.full((g, order), 8, np.int64))]
            if kind == 5:
                fields += [col(LPC_BITS - 1, 4), col(shift[rows], 5), (coefs[rows] & ((1 << LPC_BITS) - 1), np.full((g, LPC_ORDER), LPC_BITS, np.int64))]
            u = kinds[kind][rows]
            u = (u << 1) ^ (u >> 31)
            fields += [col(0, 2), col(PARTITION_ORDER, 4)]
            step, at = n >> PARTITION_ORDER, 0
            for p in range(1 << PARTITION_ORDER):
                part = u[:, at : (p + 1) * step - order]
                at = (p + 1) * step - order
                mean = part.sum(1) / part.shape[1]
                k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
                q = part >> k[:, None]
                fields += [col(k, 4), (part & ((1 << k) - 1)[:, None] | (1 << k)[:, None], q + 1 + k[:, None])]
            total = sum(b.sum(1) for _, b in fields)
            plain = total > 8 + 8 * n
            if plain.any():  # residuals would be longer than the samples
                rest = ~plain
                parts.append((rows[plain], *_close(head[rows[plain]], head_bits[rows[plain]], [(np.full((plain.sum(), 1), 2, np.int64), np.full((plain.sum(), 1), 8, np.int64)), (verbatim[0][0][plain], verbatim[0][1][plain])])))
                fields, rows = [(v[rest], b[rest]) for v, b in fields], rows[rest]
                if not len(rows):
                    continue
        parts.append((rows, *_close(head[rows], head_bits[rows], fields)))
    length = np.zeros(n_frames, np.int64)
    for rows, _, own in parts:
        length[rows] = own
    start, out = np.cumsum(length) - length, np.zeros(int(length.sum()), np.uint8)
    for rows, data, own in parts:
        before = np.cumsum(own) - own
        out[np.arange(len(data)) + np.repeat(start[rows] - before, own)] = data
    return out, length


def _close(head, head_bits, fields):
    """Header, fields, padding to a byte and the frame's checksum."""
    values = np.concatenate([head, *(v for v, _ in fields)], 1)
    bits = np.concatenate([head_bits, *(b for _, b in fields)], 1)
    pad = (-bits.sum(1)) % 8
    zero = np.zeros((len(head), 1), np.int64)
    data, length = _pack(np.concatenate([values, zero, zero], 1), np.concatenate([bits, pad[:, None], zero + 16], 1))
    start = np.cumsum(length) - length
    crc = crc_of(data, start, length - 2, 16)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 255
    return data, length


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its length must be a positive multiple of 576."""
    size = np.array([len(p) for p in payloads], np.int64)
    if (size % BLOCK).any() or (size == 0).any():
        raise FlacError("payloads must be positive multiples of 576 bytes")
    per = size // BLOCK
    x = np.frombuffer(b"".join(payloads) if len(payloads) > 1 else payloads[0] if payloads else b"", np.uint8).reshape(-1, BLOCK)
    first = np.cumsum(per) - per
    numbers = np.arange(len(x)) - np.repeat(first, per)
    parts = [_frames(x[i : i + LANES].astype(np.int32) - BIAS, numbers[i : i + LANES]) for i in range(0, len(x), LANES)]
    length = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
    end, out, raw = np.cumsum(length), [], memoryview(b"".join(d.tobytes() for d, _ in parts))
    del parts
    for p, a, n in zip(payloads, first.tolist(), per.tolist(), strict=True):
        own, base = length[a : a + n], int(end[a] - length[a])
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8) + hashlib.md5(signed).digest()
        seek = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        seek["sample"], seek["offset"], seek["samples"] = np.arange(n) * BLOCK, np.cumsum(own) - own, BLOCK
        points = [seek[i : i + 900_000].tobytes() for i in range(0, n, 900_000)]  # a block's length has 24 bits
        blocks = [b"\0" + len(info).to_bytes(3) + info, *((b"\x03" if i < len(points) - 1 else b"\x83") + len(s).to_bytes(3) + s for i, s in enumerate(points))]
        out.append(b"".join([b"fLaC", *blocks, raw[base : base + int(own.sum())]]))
    return out


# ---------------------------------------------------------------- decoder


class Header:
    """What a stream says of itself, and where its seek points lie (from the stream's start)."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise FlacError("no fLaC marker")
        at, last, points = 4, False, []
        self.samples = None
        while not last:
            kind, n = raw[at], int.from_bytes(raw[at + 1 : at + 4])
            last, kind, body = bool(kind & 0x80), kind & 0x7F, raw[at + 4 : at + 4 + n]
            if kind == 0:
                packed = int.from_bytes(body[10:18])
                self.block, self.samples = int.from_bytes(body[2:4]), packed & (1 << 36) - 1
                self.bits, self.channels, self.md5 = (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, body[18:34]
            elif kind == 3:
                points.append(np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])))
            at += 4 + n
        if self.samples is None or self.channels != 1 or not 4 <= self.bits <= 16:
            raise FlacError("not a mono stream of 4 to 16 bits")
        seek = np.concatenate(points) if points else np.zeros(0, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        seek = seek[seek["sample"] < self.samples]  # placeholders have the largest number
        self.first = at
        self.sample, self.offset = seek["sample"].astype(np.int64), seek["offset"].astype(np.int64) + at
        if not len(self.sample) or self.sample[0] != 0:
            self.sample, self.offset = np.append(0, self.sample), np.append(at, self.offset)


class _Bits:
    """Reads bits at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        d = self.data.astype(np.int64)
        self.word = d[:-4] << 24 | d[1:-3] << 16 | d[2:-2] << 8 | d[3:-1]

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n (up to 25, one number or one for each place) bits from each place."""
        return self.word[at >> 3] >> (32 - (at & 7) - n) & (np.int64(1) << n) - 1

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        q, todo = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(todo):
            p = at[todo] + q[todo]
            v = (self.word[np.minimum(p >> 3, len(self.word) - 1)] << (p & 7)) & 0xFFFFFF80
            zeros = 32 - np.frexp(v.astype(np.float64))[1]
            q[todo] += np.minimum(zeros, 25)
            todo = todo[(zeros > 25) & (p < 8 * len(self.data))] if (zeros > 25).any() else todo[:0]
            if len(todo) and (at[todo] + q[todo] >= 8 * len(self.data)).any():
                raise FlacError("a residual runs over the end")
        return q


def signed(v: np.ndarray, bits) -> np.ndarray:
    return v - ((v >> (bits - 1) & 1) << bits)


def decode_frames(bits: _Bits, starts: np.ndarray, depth: np.ndarray, stop: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """The frames that begin at the byte offsets `starts`: samples of each, their numbers, their ends.

    depth: bits of a sample by the stream's header; stop: the stream's end. Verifies both checksums of each frame.
    """
    try:
        return _frames_at(bits, starts, depth, stop)
    except IndexError as e:
        raise FlacError("a frame runs over the end") from e


def _frames_at(bits, starts, depth, stop):
    d, n = bits.data, len(starts)
    b1, b2, b3, b4 = (d[starts + i].astype(np.int64) for i in range(4))
    if ((b1 != 0xFF) | (b2 & 0xFE != 0xF8)).any():
        raise FlacError("no frame where one should begin")
    if (b4 >> 4 != 0).any() or (b4 & 1).any():
        raise FlacError("not mono")
    lead = d[starts + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 9, 1, 2, 3, 4, 5], 6)
    if (more == 9).any():
        raise FlacError("bad frame number")
    number = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(1, 7):
        number = np.where(more >= j, number << 6 | d[np.minimum(starts + 4 + j, len(d) - 1)] & 0x3F, number)
    at = starts + 5 + more
    code, rate = b3 >> 4, b3 & 15
    block = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)], 0)
    block = np.where(code == 6, d[at].astype(np.int64) + 1, np.where(code == 7, (d[at].astype(np.int64) << 8 | d[at + 1]) + 1, block))
    at = at + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (block == 0).any():
        raise FlacError("bad block size")
    size_code = b4 >> 1 & 7
    depth = np.select([size_code == 1, size_code == 2, size_code == 4], [8, 12, 16], depth)
    if (crc_of(d, starts, at - starts, 8) != d[at]).any():
        raise FlacError("a frame header's checksum doesn't hold")
    p = (at + 1) * 8
    sub = bits.read(p, 8)
    p = p + 8
    wasted = np.where(sub & 1, bits.unary(p) + 1, 0)
    p, depth, kind = p + wasted, depth - wasted, sub >> 1 & 63
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if (~((kind <= 1) | (kind >= 8) & (kind <= 12) | (kind >= 32))).any():
        raise FlacError("reserved subframe")
    samples: list = [None] * n
    ends = np.zeros(n, np.int64)
    key = (block << 6 | kind) << 5 | depth
    for k in np.unique(key):
        own = np.flatnonzero(key == k)
        x, ends[own] = _subframes(bits, p[own], int(block[own[0]]), int(kind[own[0]]), int(order[own[0]]), int(depth[own[0]]))
        x = x << wasted[own][:, None]
        for i, row in zip(own.tolist(), x, strict=True):
            samples[i] = row
    ends = (ends + 7) >> 3
    if (ends + 2 > stop).any():
        raise FlacError("a frame runs over the end")
    if (crc_of(d, starts, ends - starts, 16) != (d[ends].astype(np.int64) << 8 | d[ends + 1])).any():
        raise FlacError("a frame's checksum doesn't hold")
    return samples, number, ends + 2


def _subframes(bits: _Bits, p: np.ndarray, n: int, kind: int, order: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (lanes, n) of subframes of one kind, and the bits after them."""
    lanes = len(p)
    x = np.zeros((lanes, n), np.int64)
    if kind == 0:
        x[:] = signed(bits.read(p, depth), depth)[:, None]
        return x, p + depth
    warm = n if kind == 1 else order
    if warm:
        at = p[:, None] + np.arange(warm) * depth
        x[:, :warm] = signed(bits.read(at, depth), depth)
        p = p + warm * depth
    if kind == 1:
        return x, p
    if kind >= 32:
        precision = bits.read(p, 4) + 1
        shift = signed(bits.read(p + 4, 5), 5)
        if (precision == 16).any() or (shift < 0).any():
            raise FlacError("bad predictor")
        p = p + 9
        coefs = signed(bits.read(p[:, None] + np.arange(order) * precision[:, None], precision[:, None]), precision[:, None])
        p = p + order * precision
    res, p = _residuals(bits, p, n, order)
    if kind >= 32:
        back = np.ascontiguousarray(coefs[:, ::-1].T)  # oldest first
        rows = np.ascontiguousarray(x.T)
        rows[order:] = res.T
        for t in range(order, n):
            rows[t] += (back * rows[t - order : t]).sum(0) >> shift
        return np.ascontiguousarray(rows.T), p
    x[:, order:] = res
    if order:  # residuals are the order-th differences
        tops = [x[:, :order]]
        for _ in range(order - 1):
            tops.append(np.diff(tops[-1], axis=1))
        level = res
        for k in range(order - 1, -1, -1):
            level = np.cumsum(np.concatenate([tops[k][:, -1:], level], 1), 1)[:, 1:]
        x[:, order:] = level
    return x, p


def _residuals(bits: _Bits, p: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    lanes = len(p)
    method, parts = bits.read(p, 2), bits.read(p + 2, 4)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    p = p + 6
    out, done = np.zeros((n - order, lanes), np.int64), np.zeros(lanes, np.int64)
    for m in np.unique(method << 4 | parts).tolist():
        own = np.flatnonzero((method << 4 | parts) == m)
        wide, count = 4 + (m >> 4), 1 << (m & 15)
        if n % count or n // count < order:
            raise FlacError("bad partitions")
        q, got, t = p[own], np.zeros((n - order, len(own)), np.int64), 0
        for part in range(count):
            k = bits.read(q, wide)
            q = q + wide
            raw = k == (1 << wide) - 1
            steps = n // count - (order if part == 0 else 0)
            if raw.any():
                lane = np.flatnonzero(raw)
                w = bits.read(q[lane], 5)
                for s in range(steps):
                    got[t + s, lane] = np.where(w > 0, signed(bits.read(q[lane] + 5 + s * w, w), np.maximum(w, 1)), 0)
                q[lane] += 5 + steps * w
            lane = np.flatnonzero(~raw) if raw.any() else slice(None)
            q[lane] = _rice(bits, q[lane], k[lane], got, t, steps, lane)
            t += steps
        out[:, own], done[own] = got, q
    return out.T, done


def _rice(bits: _Bits, p: np.ndarray, k: np.ndarray, out: np.ndarray, t: int, steps: int, lane) -> np.ndarray:
    """Decodes `steps` codes of every lane into out[t:t + steps, lane]; the places after them."""
    mask, word, top = (np.int64(1) << k) - 1, bits.word, len(bits.word) - 1
    for s in range(t, t + steps):
        v = (word[np.minimum(p >> 3, top)] << (p & 7)) & 0xFFFFFFFF
        q = 32 - np.frexp(v.astype(np.float64))[1].astype(np.int64)
        need = q + 1 + k
        if need.max(initial=0) > 25:
            far = np.flatnonzero(need > 25)
            low = v >> np.maximum(31 - q - k, 0) & mask
            q[far] = bits.unary(p[far])
            low[far] = bits.read(p[far] + q[far] + 1, k[far])
            need = q + 1 + k
        else:
            low = v >> (31 - q - k) & mask
        u = q << k | low
        out[s, lane] = (u >> 1) ^ -(u & 1)
        p = p + need
    return p


def _walk(pieces: list[tuple[bytes, np.ndarray, int]]) -> list[list[np.ndarray]]:
    """Samples of the frames of each piece (bytes, where frames are known to begin, bits of a sample), in order.

    A piece ends where a frame ends; from the last frame known, and wherever the next one isn't known, frames are
    found one after the other.
    """
    size = np.array([len(p) for p, *_ in pieces], np.int64)
    base = np.cumsum(size) - size
    bits = _Bits(np.frombuffer(b"".join([p for p, *_ in pieces]), np.uint8))
    owner = np.repeat(np.arange(len(pieces)), [len(k) for _, k, _ in pieces])
    starts = np.concatenate([k + b for (_, k, _), b in zip(pieces, base, strict=True)])
    depth, stop, seen = np.array([d for *_, d in pieces], np.int64), base + size, np.sort(starts)
    found: list[list] = [[] for _ in pieces]
    starts, owner = starts[starts < stop[owner]], owner[starts < stop[owner]]
    while len(starts):
        samples, _, ends = decode_frames(bits, starts, depth[owner], stop[owner])
        for o, s, x in zip(owner.tolist(), starts.tolist(), samples, strict=True):
            found[o].append((s, x.astype(np.int16)))
        at = np.minimum(np.searchsorted(seen, ends), len(seen) - 1)
        go = (ends < stop[owner]) & (seen[at] != ends)
        starts, owner = ends[go], owner[go]
    return [[x for _, x in sorted(f, key=lambda r: r[0])] for f in found]


def decode(streams: list[bytes], verify: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Samples of each stream, and the sample offset at which each of its frames begins (with a last entry for the end)."""
    heads = [Header(s) for s in streams]
    rows: list[list[np.ndarray]] = [[] for _ in streams]
    group, held = [], 0

    def settle():
        nonlocal group, held
        for (i, *_), own in zip(group, _walk([g[1:] for g in group]) if group else [], strict=True):
            rows[i] += own
        group, held = [], 0

    for i, (s, h) in enumerate(zip(streams, heads, strict=True)):
        offset = h.offset[h.offset < len(s)]
        if (np.diff(offset) <= 0).any():
            raise FlacError("seek points out of order")
        at = 0
        while at < len(offset):
            to = max(at + 1, int(np.searchsorted(offset, offset[at] + SPAN)))
            lo, hi = int(offset[at]), int(offset[to]) if to < len(offset) else len(s)
            group.append((i, s[lo:hi], offset[at:to] - lo, h.bits))
            held += hi - lo
            if held >= SPAN:
                settle()
            at = to
    settle()
    out, offsets = [], []
    for h, own in zip(heads, rows, strict=True):
        x = np.concatenate(own) if own else np.zeros(0, np.int16)
        if len(x) != h.samples:
            raise FlacError("samples are missing")
        if verify and any(h.md5) and h.bits <= 8 and hashlib.md5(x.astype(np.int8).tobytes()).digest() != h.md5:
            raise FlacError("the samples' digest doesn't hold")
        out.append(x)
        offsets.append(np.cumsum([0, *(len(r) for r in own)]))
    return out, offsets


def decode_range(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples first .. first + count - 1, decoding only from the last seek point at or before `first`."""
    h = Header(stream)
    last = min(first + count, h.samples)
    if first >= last:
        return np.zeros(0, np.int16)
    i = int(np.searchsorted(h.sample, first, "right")) - 1
    j = int(np.searchsorted(h.sample, last, "left"))
    lo, hi = int(h.offset[i]), int(h.offset[j]) if j < len(h.offset) else len(stream)
    x = np.concatenate(_walk([(stream[lo:hi], h.offset[i:j] - lo, h.bits)])[0])
    return x[first - int(h.sample[i]) : last - int(h.sample[i])]
