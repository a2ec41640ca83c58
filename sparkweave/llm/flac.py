"""Media columns: FLAC streams in a binary column to PCM blocks with sample offsets.

Many frames are decoded at once, in numpy. Every place of a batch of streams that has a frame header with the right CRC-8 is a
candidate; the candidates' subframes are read side by side, each with a bit cursor of its own: constant, verbatim, fixed and linear
predictors, Rice-coded residuals with escapes, wasted bits, then stereo decorrelation and the frame's CRC-16. One step decodes one
residual of each frame, so the cost of a step is shared by hundreds of frames. A stream's frames are then those that follow one
another from its first byte on; after damage, those from the next candidate on.
A frame gives one row with the number of its first sample, so that a seek is a filter on ``first_sample``.

:func:`encode_clips` writes test streams, also many at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: Bytes of streams, with what they decode to, that are worked on together; cells of a table of samples.
GROUP_BYTES, CELLS = 4_000_000, 1_000_000


class FlacError(ValueError):
    """The stream breaks the format at this place."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    v = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        v = np.where(v >> (bits - 1) & 1, v << 1 ^ poly, v << 1) & ((1 << bits) - 1)
    return v


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: A byte's share in the CRC-16 of 64 bytes, by its place, and what 64 further bytes make of a CRC.
_SHARE = np.zeros((64, 256), np.int64)
_SHARE[63] = _CRC16
for _k in range(62, -1, -1):
    _SHARE[_k] = (_SHARE[_k + 1] << 8 & 0xFFFF) ^ _CRC16[_SHARE[_k + 1] >> 8]
_ON = np.arange(65536, dtype=np.int64)
for _k in range(64):
    _ON = (_ON << 8 & 0xFFFF) ^ _CRC16[_ON >> 8]


def crc8s(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-8 of each short stretch ``[start, end)``."""
    v = np.zeros(len(start), np.int64)
    for k in range(int((end - start).max()) if len(start) else 0):
        v = np.where(start + k < end, _CRC8[v ^ buf[np.minimum(start + k, len(buf) - 1)]], v)
    return v


def crc16s(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch: 64 bytes at a time are summed up by place, then the sums are chained. Bytes of 0 in front change nothing."""
    out = np.zeros(len(start), np.int64)
    chunks = -(-(end - start) // 64)
    order = np.argsort(chunks, kind="stable")
    lo = 0
    while lo < len(order):
        most = int(chunks[order[lo]])
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (most := max(most, int(chunks[order[hi]]))) * 64 <= CELLS:
            hi += 1
        rows = order[lo:hi]
        most = max(1, int(chunks[rows].max()))
        at = end[rows][:, None] - 64 * most + np.arange(64 * most)
        data = np.where(at >= start[rows][:, None], buf[np.maximum(at, 0)], 0).reshape(len(rows), most, 64)
        sums = np.bitwise_xor.reduce(_SHARE[np.arange(64), data], axis=2)
        v = np.zeros(len(rows), np.int64)
        for k in range(most):
            v = _ON[v] ^ sums[:, k]
        out[rows] = v
        lo = hi
    return out


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


class _Bits:
    """Many cursors into one buffer; positions are bits, most significant first. The buffer ends in 16 bytes of padding."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf = buf
        self.words = np.ndarray((len(buf) - 8,), ">u8", buf, 0, (1,))  # the eight bytes from each byte on, without a copy
        self._full: np.ndarray | None = None

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position on, at the top of 64."""
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)].astype(_U) << (pos & 7).astype(_U)

    def take(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """``n`` (0 to 57) bits at each position, unsigned."""
        return ((self.peek(pos) >> _U(1)) >> (63 - np.asarray(n)).astype(_U)).astype(np.int64)

    def signed(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = self.take(pos, n)
        top = np.int64(1) << np.maximum(n - 1, 0)
        return np.where(n > 0, (v ^ top) - top, 0)

    def zeros(self, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Bits of 0 before the next set one; ``w``: what :meth:`peek` gives there."""
        high = (w >> _U(11)).astype(np.float64)
        out = 52 - ((high.view(np.int64) >> 52) - 1023)
        far = np.flatnonzero(high == 0)
        if len(far):  # 53 zeros or more: the next byte that is not 0
            if self._full is None:
                self._full = np.append(np.flatnonzero(self.buf), len(self.buf))
            p = pos[far]
            byte = self._full[np.searchsorted(self._full, np.minimum((p + 52) >> 3, len(self.buf)))]
            bits = np.where(byte < len(self.buf), self.buf[np.minimum(byte, len(self.buf) - 1)], 128)
            # The byte at hand may be one whose set bits are all before the position.
            inside = byte * 8 < p + 52
            bits = np.where(inside, bits & (0xFF >> np.clip(p + 52 - byte * 8, 0, 7)), bits)
            none = inside & (bits == 0)
            byte = np.where(none, self._full[np.searchsorted(self._full, np.minimum(byte + 1, len(self.buf)))], byte)
            bits = np.where(none, np.where(byte < len(self.buf), self.buf[np.minimum(byte, len(self.buf) - 1)], 128), bits)
            out[far] = byte * 8 + 7 - np.floor(np.log2(bits)).astype(np.int64) - p
        return out


_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def _subframes(b: _Bits, pos: np.ndarray, end: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(samples: time x frame, position after, fine)`` of one subframe of each frame."""
    n, most = len(pos), int(block.max())
    head = b.take(pos, 8)
    pos = pos + 8
    kind, wasted = head >> 1 & 63, head & 1
    fine = head < 128
    w = np.flatnonzero(wasted)
    if len(w):
        z = b.zeros(pos[w], b.peek(pos[w]))
        wasted[w] += z
        pos[w] += z + 1
    fine &= (bits - wasted >= 1) & ((kind < 2) | ((kind >= 8) & (kind <= 12)) | (kind >= 32))
    wasted = np.minimum(wasted, bits - 1)
    bits = bits - wasted
    linear, coded = kind >= 32, kind >= 8
    order = np.where(linear, kind - 31, np.where(coded, np.minimum(kind - 8, 4), 0))
    x = np.zeros((32 + most, n), np.int64)  # 32 rows of 0 before the first sample
    body = x[32:]

    one = np.flatnonzero(fine & (kind == 0))
    body[:, one] = b.signed(pos[one], bits[one])
    pos[one] += bits[one]
    one = np.flatnonzero(fine & (kind == 1))
    if len(one):
        t = np.arange(most)[:, None]
        inside = t < block[one]
        body[:, one] = np.where(inside, b.signed(np.where(inside, pos[one] + t * bits[one], pos[one]), np.broadcast_to(bits[one], inside.shape)), 0)
        pos[one] += block[one] * bits[one]

    for t in range(int(order[fine].max(initial=0))):  # first samples as they are
        one = np.flatnonzero(fine & (order > t))
        if t < most:
            body[t, one] = b.signed(pos[one], bits[one])
        pos[one] += bits[one]
    coefs, shift = np.zeros((32, n), np.int64), np.zeros(n, np.int64)
    coefs[:4] = np.where(linear | ~coded, 0, _FIXED[order * ~linear].T)
    one = np.flatnonzero(fine & linear)
    if len(one):
        precision = b.take(pos[one], 4) + 1
        shift[one] = b.signed(pos[one] + 4, np.full(len(one), 5))
        fine[one] &= (precision < 16) & (shift[one] >= 0)
        shift[one] = np.maximum(0, shift[one])
        pos[one] += 9
        for j in range(int(order[one].max())):
            has = order[one] > j
            coefs[j, one[has]] = b.signed(pos[one[has]], precision[has])
            pos[one[has]] += precision[has]

    one = np.flatnonzero(fine & coded)
    if len(one):
        method, parts = b.take(pos[one], 2), b.take(pos[one] + 2, 4)
        pos[one] += 6
        fine[one] &= (method < 2) & (block[one] & ((1 << parts) - 1) == 0) & (block[one] >> parts >= order[one])
        keep = fine[one]
        one, method, parts = one[keep], method[keep], parts[keep]
    if len(one):
        width, size = 4 + method, block[one] >> parts
        first, last = order[one], block[one]
        p, stop = pos[one], end[one] * 8
        k, raw, left = np.zeros(len(one), np.int64), np.zeros(len(one), bool), size - first
        begin = np.ones(len(one), bool)  # a partition's parameter comes next
        dead = np.zeros(len(one), bool)
        for t in range(int(first.min()), int(last.max())):
            live = np.flatnonzero((first <= t) & (t < last) & ~dead)
            if not len(live):
                continue
            # A first partition may have no residual at all, but still has a parameter.
            while len(new := live[begin[live] | (left[live] == 0)]):
                opening = begin[new]
                left[new] = np.where(opening, left[new], size[new])
                k[new] = b.take(p[new], width[new])
                raw[new] = k[new] == np.where(width[new] == 4, 15, 31)
                p[new] += width[new]
                esc = new[raw[new]]
                k[esc] = b.take(p[esc], 5)
                p[esc] += 5
                begin[new] = False
            q, kk = p[live], k[live]
            w = b.peek(q)
            z = b.zeros(q, w)
            low = w << np.minimum(z + 1, 63).astype(_U)
            if int((z + kk).max()) > 55:
                low = b.peek(q + z + 1)
            v = z << kk | ((low >> _U(1)) >> (63 - kk).astype(_U)).astype(np.int64)
            v = v >> 1 ^ -(v & 1)
            used = z + 1 + kk
            esc = raw[live]
            if esc.any():
                v = np.where(esc, b.signed(q, kk), v)
                used = np.where(esc, kk, used)
            p[live] = q + used
            dead[live] = p[live] > stop[live]
            body[t, one[live]] = v
            left[live] -= 1
        pos[one] = p
        # A block that is as long as its first samples has no residual, only the parameter of its one partition.
        none = np.flatnonzero((first >= last) & begin)
        for r in none:
            at = one[r : r + 1]
            kr = int(b.take(pos[at], int(width[r]))[0])
            pos[at] += width[r] + (5 if kr == (15 if width[r] == 4 else 31) else 0)
        fine[one] &= ~dead
    fine &= pos <= end * 8

    some = np.flatnonzero(fine & (coefs != 0).any(0))
    if len(some):
        m = int(order[some].max())
        c, s, o, y = coefs[:m, some][::-1], shift[some], order[some], np.ascontiguousarray(x[:, some])
        for t in range(int(o.min()), most):
            guess = (y[32 + t - m : 32 + t] * c).sum(0) >> s
            y[32 + t] += np.where(o <= t, guess, 0)
        x[:, some] = y
    return x[32:] << wasted, pos, fine


_RATES = np.array([0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000, 0, 0, 0, 0])
_SIZES = np.array([0, 8, 12, 0, 16, 20, 24, 32])
_ONES = np.array([8 - (~k & 0xFF).bit_length() for k in range(256)])


@dataclass
class Frames:
    """Frames of a group of streams, by place: everything of theirs but the samples as arrays, samples as PCM bytes (None: damaged)."""

    at: np.ndarray
    end: np.ndarray
    first: np.ndarray
    n: np.ndarray
    channels: np.ndarray
    rate: np.ndarray
    right: np.ndarray
    pcm: list[bytes | None]


def frames_of(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, infos: list[StreamInfo]) -> Frames:
    """All frames of streams that lie at ``[begin, end)`` (the first frame to the end) of a buffer with 16 bytes of padding."""
    at = np.flatnonzero((buf[:-1] == 0xFF) & (buf[1:] & 0xFE == 0xF8))
    of = np.searchsorted(begin, at, side="right") - 1
    keep = of >= 0
    at, of = at[keep], of[keep]
    keep = at + 6 <= end[of]
    at, of = at[keep], of[keep]
    stop = end[of]
    b2, b3, byte = (buf[at + k].astype(np.int64) for k in (2, 3, 4))
    extra = _ONES[byte]
    keep = (extra != 1) & (extra != 8) & (b3 & 1 == 0) & (b2 >> 4 > 0) & (b2 & 15 < 15) & (b3 >> 4 <= 10)
    number = byte & (0x7F >> extra)
    last = len(buf) - 1
    for k in range(1, 7):
        more = buf[np.minimum(at + 4 + k, last)].astype(np.int64)
        has = extra > k
        keep &= ~has | (more & 0xC0 == 0x80)
        number = np.where(has, number << 6 | more & 0x3F, number)
    p = at + 4 + np.maximum(1, extra)
    byte_at = lambda q: buf[np.minimum(q, last)].astype(np.int64)
    size, rate = b2 >> 4, b2 & 15
    two = byte_at(p) << 8 | byte_at(p + 1)
    block = np.where(size == 1, 192, np.where(size < 6, 576 << np.clip(size - 2, 0, 4), 256 << np.clip(size - 8, 0, 8)))
    block = np.where(size == 6, byte_at(p) + 1, np.where(size == 7, two + 1, block))
    p = p + np.where(size == 6, 1, np.where(size == 7, 2, 0))
    two = byte_at(p) << 8 | byte_at(p + 1)
    own = np.array([i.rate for i in infos])[of]
    hertz = np.where(rate == 12, byte_at(p) * 1000, np.where(rate == 13, two, np.where(rate == 14, two * 10, np.where(rate == 0, own, _RATES[rate]))))
    p = p + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    keep &= p < stop
    keep = np.flatnonzero(keep)
    keep = keep[crc8s(buf, at[keep], p[keep]) == buf[p[keep]]]
    at, of, stop, number, block, hertz, p, b3 = (a[keep] for a in (at, of, stop, number, block, hertz, p, b3))
    depth, most = np.array([i.bits for i in infos])[of], np.array([i.max_block for i in infos])[of]
    own = _SIZES[b3 >> 1 & 7]
    bits, mode = np.where(own > 0, own, depth), b3 >> 4
    channels = np.where(mode < 8, mode + 1, 2)
    first = np.where(buf[at + 1] & 1, number, number * most)

    fine, ends, right = np.zeros(len(at), bool), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    pcm: list[bytes | None] = [None] * len(at)
    reader, order, lo = _Bits(buf), np.argsort(block, kind="stable"), 0
    while lo < len(order):
        hi, longest = lo + 1, int(block[order[lo]])
        while hi < len(order) and (hi + 1 - lo) * int(block[order[hi]]) <= CELLS:
            longest = int(block[order[hi]])
            hi += 1
        rows = order[lo:hi]
        lo = hi
        pos, good = (p[rows] + 1) * 8, np.ones(len(rows), bool)
        sub = np.zeros((int(channels[rows].max()), longest, len(rows)), np.int64)
        for c in range(len(sub)):
            here = np.flatnonzero(good & (channels[rows] > c))
            if not len(here):
                break
            r = rows[here]
            wider = ((mode[r] == 9) & (c == 0)) | (((mode[r] == 8) | (mode[r] == 10)) & (c == 1))
            x, after, ok = _subframes(reader, pos[here], stop[r], block[r], bits[r] + wider)
            sub[c][: len(x), here] = x
            pos[here], good[here] = after, ok
        done = (pos + 7) >> 3
        good &= done + 2 <= stop[rows]
        ends[rows], fine[rows] = np.where(good, done + 2, 0), good
        g = np.flatnonzero(good)
        right[rows[g]] = crc16s(buf, at[rows[g]], done[g]) == (buf[done[g]].astype(np.int64) << 8 | buf[done[g] + 1])
        for code in (8, 9, 10):
            k = np.flatnonzero(mode[rows] == code)
            if len(k):
                one, two = sub[0][:, k], sub[1][:, k]
                if code == 8:
                    sub[1][:, k] = one - two
                elif code == 9:
                    sub[0][:, k] = one + two
                else:
                    mid = one << 1 | two & 1
                    sub[0][:, k], sub[1][:, k] = (mid + two) >> 1, (mid - two) >> 1
        shown = g[right[rows[g]]]
        for ch, wide in set(zip(channels[rows[shown]].tolist(), depth[rows[shown]].tolist())):
            k = shown[(channels[rows[shown]] == ch) & (depth[rows[shown]] == wide)]
            x = np.ascontiguousarray(sub[:ch, :, k].transpose(2, 1, 0))
            raw = packed(x, wide)
            for row, line in zip(rows[k].tolist(), raw):
                pcm[row] = line[: int(block[row])].tobytes()
    keep = np.flatnonzero(fine)
    return Frames(at[keep], ends[keep], first[keep], block[keep], channels[keep], hertz[keep], right[keep], [pcm[k] for k in keep.tolist()])


def packed(x: np.ndarray, bits: int) -> np.ndarray:
    """Samples as the bytes of little-endian PCM, whole bytes a sample, along a new last axis; up to 8 bits are unsigned."""
    if bits <= 8:
        return (x + 128).astype(np.uint8)[..., None]
    return x.astype("<i8")[..., None].view(np.uint8)[..., : (bits + 7) // 8]


def decode_many(streams: list[bytes | None]) -> Iterator[tuple[StreamInfo | None, list[tuple], str | None]]:
    """For each stream STREAMINFO, its blocks ``(first_sample, n_samples, channels, bits, rate, byte_offset, crc_ok, pcm)`` and what is wrong
    with the stream as a whole (None: nothing).

    A frame with a wrong CRC-16 is a block without PCM; after a damaged header or frame the next frame is looked for.
    """
    heads: list[tuple[StreamInfo, int] | str] = []
    for s in streams:
        try:
            heads.append("there is no stream" if s is None else read_header(s))
        except (FlacError, IndexError) as e:
            heads.append(str(e))
    lo = 0
    while lo < len(streams):
        hi, size = lo, 0
        while hi < len(streams):
            h = heads[hi]
            mine = 0 if isinstance(h, str) else len(streams[hi]) + h[0].samples * h[0].channels * ((h[0].bits + 7) // 8)
            if hi > lo and size + mine > GROUP_BYTES:
                break
            size, hi = size + mine, hi + 1
        yield from _decode_group(streams[lo:hi], heads[lo:hi])
        lo = hi


def _decode_group(streams: list[bytes | None], heads: list) -> Iterator[tuple[StreamInfo | None, list[tuple], str | None]]:
    ok = [k for k, h in enumerate(heads) if not isinstance(h, str)]
    sizes = np.array([len(streams[k]) for k in ok], np.int64)
    base = np.cumsum(sizes) - sizes
    begin = base + np.array([heads[k][1] for k in ok], np.int64)
    begin = np.minimum(begin, base + sizes)
    f = frames_of(np.frombuffer(b"".join([*(streams[k] for k in ok), bytes(16)]), np.uint8), begin, base + sizes, [heads[k][0] for k in ok]) if ok else None
    starts = np.searchsorted(f.at, base) if ok else []
    at, end, first, n, channels, rate, right = (getattr(f, c).tolist() for c in ("at", "end", "first", "n", "channels", "rate", "right")) if ok else ([],) * 7
    number = {k: i for i, k in enumerate(ok)}
    for k, h in enumerate(heads):
        if isinstance(h, str):
            yield None, [], h
            continue
        info, i = h[0], number[k]
        low, high, here, stop, origin = int(starts[i]), int(starts[i + 1]) if i + 1 < len(ok) else len(at), int(begin[i]), int(base[i] + sizes[i]), int(base[i])
        blocks, wrong, skipped, j = [], None, False, low
        while here < stop:
            while j < high and at[j] < here:
                j += 1
            if j == high:
                skipped = True
                break
            skipped |= at[j] > here
            if right[j]:
                here = end[j]
            else:  # look for the next frame inside: a wrong length may have swallowed it
                wrong = "a frame's CRC-16 is wrong"
                here = at[j + 1] if j + 1 < high else stop
            blocks.append((first[j], n[j], channels[j], info.bits, rate[j], at[j] - origin, right[j], f.pcm[j]))
            j += 1
        total = sum(b[1] for b in blocks)
        if skipped and wrong is None:
            wrong = "bytes that are no frame"
        if wrong is None and info.samples and total != info.samples:
            wrong = f"{total} samples of {info.samples}"
        if wrong is None and info.md5 != bytes(16):
            whole = b"".join(b[7] for b in blocks)
            if info.bits <= 8:
                whole = (np.frombuffer(whole, np.uint8).astype(np.int16) - 128).astype(np.int8).tobytes()
            if hashlib.md5(whole).digest() != info.md5:
                wrong = "the MD5 of the samples is wrong"
        yield info, blocks, wrong


BLOCKS_SCHEMA = "media_id long, block int, first_sample long, n_samples int, channels int, bits int, rate int, byte_offset long, crc_ok boolean, pcm binary, error string"
_ARROW = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[t]) for c, t in (x.split() for x in BLOCKS_SCHEMA.split(", "))])


def decode_media(table: DataFrame, id_col: str = "media_id", data: str = "flac") -> DataFrame:
    """One row per frame, ``media_id, block, first_sample, n_samples, channels, bits, rate, byte_offset, crc_ok, pcm, error``.

    ``pcm`` is interleaved and little-endian, null for a frame whose CRC-16 is wrong. ``error`` says what is wrong with the stream as a
    whole. A stream that is null, empty, no FLAC or has no frame gives one row with null in all columns but ``media_id`` and
    ``error``. Streams of any length are decoded whole. Repeated rows are decoded once each; an empty table gives an empty result; further
    columns are ignored, whatever their names.
    """

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for i, (_, blocks, error) in zip(b.column(0).to_pylist(), decode_many(b.column(1).to_pylist())):
                error = error or (None if blocks else "there is no frame")
                for k, r in enumerate(blocks or [(None,) * 8]):
                    rows.append((i, k if blocks else None, *r, error))
                    size += len(r[7] or b"")
                if size > GROUP_BYTES or len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return table.select(F.col(id_col).cast("long").alias("media_id"), F.col(data).cast("binary").alias("flac")).mapInArrow(run, BLOCKS_SCHEMA)


# ---- streams for tests and for the query


def _packed_fields(value: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fields (at most 32 bits each) of each row behind one another: a buffer, where each row starts in it and its whole bytes.

    Fields don't overlap, so adding them up word by word is as good as or-ing them.
    """
    bits = width.sum(1)
    words = -(-bits // 32) + 1
    base = (np.cumsum(words) - words) * 32
    at = base[:, None] + np.cumsum(width, 1) - width
    v = value.astype(_U) << (64 - width - (at & 31)).astype(_U)
    v = np.where(width > 0, v, _U(0))
    word = at >> 5
    n = int(words.sum()) + 1
    high = np.bincount(word.ravel(), (v >> _U(32)).ravel().astype(np.float64), minlength=n)
    low = np.bincount(word.ravel() + 1, (v & _U(0xFFFFFFFF)).ravel().astype(np.float64), minlength=n + 1)
    return (high[:n] + low[:n]).astype(np.uint32).astype(">u4").view(np.uint8), base >> 3, (bits + 7) >> 3


def _linear(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised least-squares coefficients (12 bits) and shifts of each row."""
    past = np.stack([x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order)], 2).astype(float)
    gram = np.einsum("nti,ntj->nij", past, past) + 1e-6 * np.eye(order)
    c = np.linalg.solve(gram, np.einsum("nti,nt->ni", past, x[:, order:].astype(float))[:, :, None])[:, :, 0]
    shift = np.clip(10 - np.ceil(np.log2(np.abs(c).max(1) + 1e-9)), 0, 15).astype(np.int64)
    return np.clip(np.round(c * (1 << shift)[:, None]), -2047, 2047).astype(np.int64), shift


def _subframe_fields(x: np.ndarray, bits: int, kind: str, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(values, widths)``, rows x fields, of one subframe of each row; residuals in two partitions where the length is even."""
    n, size = x.shape
    field = lambda v, w: (np.broadcast_to(np.asarray(v, np.int64) & ((1 << w) - 1), (n, 1)), np.full((n, 1), w))
    plain = lambda v, w: (v & ((1 << w) - 1), np.full(v.shape, w))
    if kind == "verbatim" or size <= order + 1:
        return [field(1 << 1, 8), plain(x, bits)]
    if kind == "fixed":
        out = [field((8 + order) << 1, 8), plain(x[:, :order], bits)]
        rest = np.diff(x, order) if order else x
    else:
        coefs, shift = _linear(x, order)
        guess = sum(x[:, order - 1 - j : size - 1 - j] * coefs[:, j : j + 1] for j in range(order)) >> shift[:, None]
        rest = x[:, order:] - guess
        out = [field((31 + order) << 1, 8), plain(x[:, :order], bits), field(11, 4), plain(shift[:, None], 5), plain(coefs, 12)]
    parts = int(size % 2 == 0 and size // 2 > order)
    out += [field(0, 2), field(parts, 4)]
    cut = size // 2 - order if parts else rest.shape[1]
    for part in (rest[:, :cut], rest[:, cut:]) if parts else (rest,):
        k = np.clip(np.floor(np.log2(np.abs(part).mean(1) + 1e-9)) + 1, 0, 14).astype(np.int64)
        most = np.abs(part).max(1)
        fold = np.where(part < 0, -2 * part - 1, 2 * part)
        raw = (fold.max(1) >> k) + 1 + k > 32  # an escape: plain numbers
        wide = np.where(raw, [int(v).bit_length() + 1 for v in most], 0)
        out += [(np.where(raw, 15, k)[:, None], np.full((n, 1), 4)), (wide[:, None], np.where(raw, 5, 0)[:, None])]
        kk = k[:, None]
        value = np.where(raw[:, None], part & ((1 << wide) - 1)[:, None], 1 << kk | fold & ((1 << kk) - 1))
        out.append((value, np.where(raw[:, None], wide[:, None], (fold >> kk) + 1 + kk)))
    return out


def encode_clips(x: np.ndarray, bits: int = 16, rate: int = 16000, block: int = 192, kind: str = "fixed", order: int = 2, stereo: int = 0) -> list[bytes]:
    """A FLAC stream of each of ``clips x samples x channels``; ``kind``: fixed, lpc or verbatim; ``stereo``: 0 as they are, 8 left and side,
    9 side and right, 10 mid and side. At most 128 blocks."""
    x = np.asarray(x, np.int64)
    n, samples, channels = x.shape
    raw = np.ascontiguousarray(x.astype(np.int8).view(np.uint8)[..., None] if bits <= 8 else packed(x, bits)).reshape(n, -1)
    frames: list[list[bytes]] = []
    for number, at in enumerate(range(0, samples, block)):
        part = x[:, at : at + block]
        size = part.shape[1]
        header = bytes([0xFF, 0xF8, 0x70, (stereo or channels - 1) << 4, number]) + (size - 1).to_bytes(2, "big")
        h = np.frombuffer(header, np.uint8)
        header += bytes([int(crc8s(h, np.array([0]), np.array([7]))[0])])
        if stereo:
            left, right = part[:, :, 0], part[:, :, 1]
            side = left - right
            subs = {8: ((left, bits), (side, bits + 1)), 9: ((side, bits + 1), (right, bits)), 10: ((left + right >> 1, bits), (side, bits + 1))}[stereo]
        else:
            subs = tuple((part[:, :, c], bits) for c in range(channels))
        fields = [(np.broadcast_to(np.frombuffer(header, np.uint8).astype(np.int64), (n, 8)), np.full((n, 8), 8))]
        for s, b in subs:
            fields += _subframe_fields(s, b, kind, order)
        buf, start, length = _packed_fields(np.concatenate([v for v, _ in fields], 1), np.concatenate([w for _, w in fields], 1))
        crc = crc16s(buf, start, start + length)
        data = buf.tobytes()
        frames.append([data[s : s + m] + int(c).to_bytes(2, "big") for s, m, c in zip(start.tolist(), length.tolist(), crc)])
    head = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples).to_bytes(8, "big")
    return [b"fLaC\x80\x00\x00\x22" + head + hashlib.md5(raw[k].tobytes()).digest() + b"".join(f[k] for f in frames) for k in range(n)]
