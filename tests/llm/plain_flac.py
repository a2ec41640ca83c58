"""A plain FLAC decoder, frame by frame, and an encoder with every kind of subframe: what the batch decoder is compared with."""


from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for n in range(256):
        v = n << (bits - 8)
        for _ in range(8):
            v = ((v << 1) ^ poly if v & top else v << 1) & mask
        out.append(v)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = _CRC8[v ^ b]
    return v


def crc16(data: bytes) -> int:
    v = 0
    for b in data:
        v = (v << 8 & 0xFFFF) ^ _CRC16[v >> 8 ^ b]
    return v


class FlacError(ValueError):
    """The stream breaks the format at this place."""


class _Bits:
    """Bits of a stretch of bytes, most significant first."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0
        self._next: np.ndarray | None = None

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise FlacError("the stream ends too early")
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | int(b)
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def many(self, count: int, width: int, signed: bool = True) -> np.ndarray:
        if self.at + count * width > len(self.bits):
            raise FlacError("the stream ends too early")
        if not width:
            return np.zeros(count, np.int64)
        raw = self.bits[self.at : self.at + count * width].reshape(count, width)
        self.at += count * width
        v = raw.astype(np.int64) @ (np.int64(1) << np.arange(width - 1, -1, -1, dtype=np.int64))
        return np.where(raw[:, 0] > 0, v - (np.int64(1) << np.int64(width)), v) if signed else v

    def ones_after(self) -> np.ndarray:
        """For each bit the place of the next set bit, at it or after it; the length where there is none."""
        if self._next is None:
            n = len(self.bits)
            place = np.where(self.bits > 0, np.arange(n), n)
            self._next = np.append(np.minimum.accumulate(place[::-1])[::-1], [n])
        return self._next

    def unary(self) -> int:
        end = int(self.ones_after()[self.at])
        if end >= len(self.bits):
            raise FlacError("the stream ends too early")
        v, self.at = end - self.at, end + 1
        return v

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` residuals with Rice parameter k."""
        if not count:
            return np.zeros(0, np.int64)
        ones, n = self.ones_after(), len(self.bits)
        # No code spans more than what is left; the doubling works on the stretch that the codes can lie in.
        lo = self.at
        hi = min(n, lo + count * (k + 1) + 64)
        while int(np.count_nonzero(self.bits[lo:hi])) < count and hi < n:
            hi = min(n, hi + (hi - lo))
        while True:
            stop = hi - lo
            jump = np.minimum(ones[lo : hi + 1] - lo + 1 + k, stop + 1)
            jump = np.append(jump, stop + 1)
            starts = np.zeros(1, np.int64)
            while len(starts) < count + 1:
                starts = np.concatenate([starts, jump[starts]])
                if len(starts) < count + 1:
                    jump = jump[jump]
            if starts[count] <= stop:
                break
            if hi >= n:
                raise FlacError("the stream ends too early")
            hi = min(n, hi + (hi - lo))
        begin = starts[:count] + lo
        one = ones[begin]
        value = (one - begin) << np.int64(k)
        for j in range(k):
            value |= self.bits[one + 1 + j].astype(np.int64) << np.int64(k - 1 - j)
        self.at = int(starts[count]) + lo
        return (value >> 1) ^ -(value & 1)


@dataclass
class StreamInfo:
    min_block: int
    max_block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes


def read_header(data: bytes) -> tuple[StreamInfo, int]:
    """STREAMINFO and where the first frame starts; an ID3v2 tag before the stream is skipped, other metadata too."""
    at = 0
    if data[:3] == b"ID3" and len(data) > 10:
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    if data[at : at + 4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info = at + 4, None
    while True:
        if at + 4 > len(data):
            raise FlacError("the metadata ends too early")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            if len(body) < 34:
                raise FlacError("STREAMINFO is too short")
            v = int.from_bytes(body[10:18], "big")
            info = StreamInfo(int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"), v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & (1 << 36) - 1, body[18:34])
        at += 4 + size
        if last:
            break
    if info is None:
        raise FlacError("there is no STREAMINFO")
    return info, at


def _residual(b: _Bits, block: int, order: int) -> np.ndarray:
    method, parts = b.take(2), b.take(4)
    if method > 1:
        raise FlacError("reserved residual coding")
    width, escape = (4, 15) if method == 0 else (5, 31)
    if block & ((1 << parts) - 1) or (block >> parts) < order:
        raise FlacError("the partitions don't fit the block")
    out = []
    for p in range(1 << parts):
        n = (block >> parts) - (order if p == 0 else 0)
        k = b.take(width)
        out.append(b.many(n, b.take(5)) if k == escape else b.rice(n, k))
    return np.concatenate(out)


def _predict(warm: np.ndarray, residual: np.ndarray, coefs, shift: int) -> np.ndarray:
    order = len(coefs)
    out = [int(x) for x in warm]
    coefs = [int(c) for c in coefs]
    for r in residual.tolist():
        s = 0
        for j in range(order):
            s += coefs[j] * out[-1 - j]
        out.append(r + (s >> shift))
    return np.array(out, np.int64)


def _fixed(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undo a fixed predictor of order len(warm): that many running sums, each from its own start."""
    order, x = len(warm), residual
    starts, level = [], warm.astype(np.int64)
    for _ in range(order):
        starts.append(level)
        level = np.diff(level)
    for k in range(order - 1, -1, -1):
        first = starts[k][-1]  # the last known value of the k-th difference
        x = first + np.cumsum(x)
    return np.concatenate([warm, x]) if order else residual


def _subframe(b: _Bits, block: int, bits: int) -> np.ndarray:
    if b.take(1):
        raise FlacError("a subframe starts with a set bit")
    kind = b.take(6)
    wasted = 1 + b.unary() if b.take(1) else 0
    bits -= wasted
    if bits < 1:
        raise FlacError("no bits are left")
    if kind == 0:
        x = np.full(block, b.signed(bits), np.int64)
    elif kind == 1:
        x = b.many(block, bits)
    elif 8 <= kind <= 12:
        warm = b.many(kind - 8, bits)
        x = _fixed(warm, _residual(b, block, kind - 8))
    elif kind >= 32:
        order = kind - 31
        warm = b.many(order, bits)
        precision = b.take(4) + 1
        if precision == 16:
            raise FlacError("reserved coefficient precision")
        shift = b.signed(5)
        if shift < 0:
            raise FlacError("a negative shift")
        coefs = b.many(order, precision)
        x = _predict(warm, _residual(b, block, order), coefs, shift)
    else:
        raise FlacError("reserved subframe")
    return x << np.int64(wasted)


_RATES = (0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000)
_SIZES = (0, 8, 12, 0, 16, 20, 24, 32)


def _channels(b: _Bits, channel: int, block: int, bits: int) -> np.ndarray:
    """The subframes of a frame, samples x channels, stereo decorrelation undone."""
    if channel < 8:
        return np.stack([_subframe(b, block, bits) for _ in range(channel + 1)], 1)
    one = _subframe(b, block, bits + (channel == 9))
    two = _subframe(b, block, bits + (channel in (8, 10)))
    if channel == 8:
        return np.stack([one, one - two], 1)
    if channel == 9:
        return np.stack([one + two, two], 1)
    mid = one << 1 | two & 1
    return np.stack([(mid + two) >> 1, (mid - two) >> 1], 1)


def read_frame(data: bytes, at: int, info: StreamInfo) -> tuple[int, np.ndarray, int, int, bool]:
    """``(first sample, samples x channels, rate, end, CRC-16 right)`` of the frame at a byte; raises if there is none or its header is damaged."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame starts here")
    variable, b2, b3, p = data[at + 1] & 1, data[at + 2], data[at + 3], at + 4
    extra = 0
    while data[p] & 0x80 >> extra and extra < 8:
        extra += 1
    if extra in (1, 8) or b3 & 1:
        raise FlacError("a damaged frame number")
    number = data[p] & (0x7F >> extra)
    for k in range(1, extra):
        if p + k >= len(data) or data[p + k] & 0xC0 != 0x80:
            raise FlacError("a damaged frame number")
        number = number << 6 | data[p + k] & 0x3F
    p += max(1, extra)
    size, rate = b2 >> 4, b2 & 15
    if size == 0 or rate == 15:
        raise FlacError("a reserved block size or rate")
    if size in (6, 7):
        block, p = int.from_bytes(data[p : p + size - 5], "big") + 1, p + size - 5
    else:
        block = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    if rate == 12:
        hertz, p = data[p] * 1000, p + 1
    elif rate in (13, 14):
        hertz, p = int.from_bytes(data[p : p + 2], "big") * (10 if rate == 14 else 1), p + 2
    else:
        hertz = _RATES[rate] or info.rate
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise FlacError("the header's CRC-8 is wrong")
    channel, bits = b3 >> 4, _SIZES[b3 >> 1 & 7] or info.bits
    if channel > 10:
        raise FlacError("reserved channels")
    # A sensible encoder's frame is not longer than its samples verbatim; one that is gets a second try with all that is left.
    limit = p + 1 + ((channel + 1 if channel < 8 else 2) * (block * (bits + 1) + 300) + 7) // 8 + 64
    for stop in (limit, len(data)):
        b = _Bits(data[p + 1 : stop])
        try:
            x = _channels(b, channel, block, bits)
            break
        except FlacError as e:
            if stop >= len(data) or "too early" not in str(e):
                raise
    end = p + 1 + (b.at + 7) // 8
    if end + 2 > len(data):
        raise FlacError("the stream ends too early")
    right = crc16(data[at:end]) == int.from_bytes(data[end : end + 2], "big")
    return number if variable else number * info.max_block, x, hertz, end + 2, right


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian PCM, whole bytes a sample; up to 8 bits are unsigned."""
    if bits <= 8:
        return (x + 128).astype(np.uint8).tobytes()
    width = (bits + 7) // 8
    return x.astype("<i8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(data: bytes) -> tuple[StreamInfo, list[dict], str | None]:
    """STREAMINFO, the blocks, and what is wrong with the stream as a whole (None: nothing).

    A frame with a wrong CRC-16 is a block without PCM; after a damaged header or frame the next place with a valid header is looked for.
    """
    info, at = read_header(data)
    blocks, wrong, skipped = [], None, 0
    while at < len(data):
        try:
            first, x, rate, end, right = read_frame(data, at, info)
        except (FlacError, IndexError):
            skipped += 1
            nxt = data.find(b"\xff", at + 1)
            while nxt >= 0 and (nxt + 1 >= len(data) or data[nxt + 1] & 0xFE != 0xF8):
                nxt = data.find(b"\xff", nxt + 1)
            at = nxt if nxt >= 0 else len(data)
            continue
        if not right:  # look for the next frame inside: a wrong length may have swallowed it
            wrong = "a frame's CRC-16 is wrong"
            end = at + 2
            while end < len(data):
                end = data.find(b"\xff", end)
                if end < 0:
                    end = len(data)
                    break
                try:
                    read_frame(data, end, info)
                    break
                except (FlacError, IndexError):
                    end += 1
        blocks.append({"first_sample": first, "n_samples": len(x), "channels": x.shape[1], "bits": info.bits, "rate": rate, "crc_ok": right, "byte_offset": at, "pcm": pcm(x, info.bits) if right else None})
        at = end
    total = sum(b["n_samples"] for b in blocks)
    if skipped and wrong is None:
        wrong = "bytes that are no frame"
    if wrong is None and info.samples and total != info.samples:
        wrong = f"{total} samples of {info.samples}"
    if wrong is None and info.md5 != bytes(16):
        whole = b"".join(b["pcm"] for b in blocks)
        if info.bits <= 8:
            whole = (np.frombuffer(whole, np.uint8).astype(np.int16) - 128).astype(np.int8).tobytes()
        if hashlib.md5(whole).digest() != info.md5:
            wrong = "the MD5 of the samples is wrong"
    return info, blocks, wrong



class _Writer:
    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(np.array([value >> k & 1 for k in range(n - 1, -1, -1)], np.uint8))

    def many(self, values: np.ndarray, n: int) -> None:
        if n and len(values):
            self.parts.append(((values.astype(np.int64)[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel())

    def rice(self, values: np.ndarray, k: int) -> None:
        v = np.where(values < 0, -2 * values - 1, 2 * values).astype(np.int64)
        q = v >> k
        ends = np.cumsum(q + 1 + k)
        bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        one = ends - k - 1
        bits[one] = 1
        for j in range(k):
            bits[one + 1 + j] = v >> (k - 1 - j) & 1
        self.parts.append(bits)

    def data(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes() if self.parts else b""


def _rice_parameter(x: np.ndarray) -> int:
    mean = float(np.abs(x).mean()) if len(x) else 0
    return int(np.clip(np.floor(np.log2(mean + 1e-9)) + 1, 0, 14))


def _write_subframe(w: _Writer, x: np.ndarray, bits: int, kind: str, order: int, parts: int) -> None:
    if kind == "constant":
        w.put(0, 8)
        w.many(x[:1], bits)
        return
    if kind == "verbatim":
        w.put(1 << 1, 8)
        w.many(x, bits)
        return
    if kind == "fixed":
        residual = np.diff(x, order) if order else x
        w.put((8 + order) << 1, 8)
        w.many(x[:order], bits)
    else:  # a quantised least-squares predictor
        rows = np.stack([x[order - 1 - j : len(x) - 1 - j] for j in range(order)], 1).astype(float)
        c = np.linalg.lstsq(rows, x[order:].astype(float), rcond=None)[0]
        shift = int(np.clip(10 - np.ceil(np.log2(np.abs(c).max() + 1e-9)), 0, 15))
        coefs = np.clip(np.round(c * (1 << shift)), -2047, 2047).astype(np.int64)
        guess = (np.stack([x[order - 1 - j : len(x) - 1 - j] for j in range(order)], 1) * coefs).sum(1) >> shift
        residual = x[order:] - guess
        w.put((31 + order) << 1, 8)
        w.many(x[:order], bits)
        w.put(11, 4)
        w.put(shift, 5)
        w.many(coefs, 12)
    w.put(0, 2)
    w.put(parts, 4)
    size, at = len(x) >> parts, 0
    for p in range(1 << parts):
        n = size - (order if p == 0 else 0)
        part = residual[at : at + n]
        at += n
        k = _rice_parameter(part)
        if n and int(np.abs(part).max()) >> k > 200:  # an escape: plain numbers
            width = int(np.abs(part).max()).bit_length() + 1
            w.put(15, 4)
            w.put(width, 5)
            w.many(part, width)
        else:
            w.put(k, 4)
            w.rice(part, k)


def encode(x: np.ndarray, bits: int = 16, rate: int = 16000, block: int = 192, kind: str = "fixed", order: int = 2, parts: int = 1, stereo: int = 0) -> bytes:
    """A FLAC stream of ``samples x channels``; ``stereo``: 0 as they are, 8 left and side, 9 side and right, 10 mid and side."""
    x = np.asarray(x, np.int64)
    n, channels = x.shape
    raw = x.astype(np.int8).tobytes() if bits <= 8 else pcm(x, bits)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    out = bytearray(b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info)
    for number, at in enumerate(range(0, n, block)):
        part = x[at : at + block]
        size = len(part)
        p = parts if size % (1 << parts) == 0 and size >> parts > order else 0
        if number < 0x80:
            name = bytes([number])
        else:
            k = 1 + (number >= 0x800) + (number >= 0x10000) + (number >= 0x200000)
            name = bytes([(0xFF00 >> (k + 1) & 0xFF) | number >> 6 * k]) + bytes(0x80 | number >> 6 * j & 0x3F for j in range(k - 1, -1, -1))
        header = bytes([0xFF, 0xF8, 0x70, (stereo or channels - 1) << 4]) + name + (size - 1).to_bytes(2, "big")
        header += bytes([crc8(header)])
        if stereo:
            left, right = part[:, 0], part[:, 1]
            side = left - right
            subs = {8: ((left, bits), (side, bits + 1)), 9: ((side, bits + 1), (right, bits)), 10: ((left + right >> 1, bits), (side, bits + 1))}[stereo]
        else:
            subs = tuple((part[:, c], bits) for c in range(channels))
        w = _Writer()
        for s, b in subs:
            usable = "verbatim" if size <= order + 1 else kind
            _write_subframe(w, s, b, usable, order, p)
        body = header + w.data()
        out += body + crc16(body).to_bytes(2, "big")
    return bytes(out)
