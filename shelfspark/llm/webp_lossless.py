"""Media columns in lossless WebP (VP8L, RFC 9649): an encoder and a decoder in numpy.

The decoder reads every feature of the format: prefix codes, back-references, the colour cache, several groups of codes,
and the predictor, cross-colour, subtract-green and palette transforms. Streams with one group and no colour cache, whose
pixels are one symbol each, are read without a step per pixel: codes are looked up at every bit at once, and the bits
where symbols truly start are found by following links that jump sixteen symbols at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blobs, plain_names, sliced, table

#: Payload bytes of one image: 64 samples a row, as many rows as the format allows. Longer payloads become several images.
ROW = 64
IMAGE_BYTES = ROW * 16384
_CHUNK = 1 << 19
_JUMP = 16
_MATCH = 32
_MAX_COPY = 4096

# Fixed values of the format: the order of code length codes, and the near distances (columns, rows) of the codes 1 to 120.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class WebpError(ValueError):
    """The bytes aren't a lossless WebP image that the format allows."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of the symbols that occur, none above `most` (counts are flattened until they fit); one symbol has length 1."""
    counts = np.asarray(counts, dtype=np.int64)
    used = counts.nonzero()[0].tolist()
    out = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = n
            heapq.heappush(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= most:
            out[used] = depth[: len(used)]
            return out
        weight = [(w >> 2) + 1 for w in weight]


#: Numbers of 16 bits with their bits in reverse order.
_REVERSED = sum(((np.arange(1 << 16) >> b) & 1) << (15 - b) for b in range(16))


def _in_order(lengths: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The used symbols by code, and their lengths."""
    size = lengths[used]
    order = np.argsort(size, kind="stable")
    return used[order], size[order]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of the lengths, first bit lowest, as they lie in the stream."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used = lengths.nonzero()[0]
    if len(used):
        used, size = _in_order(lengths, used)
        room = 1 << (15 - size)
        code = (np.cumsum(room) - room) >> (15 - size)
        codes[used] = _REVERSED[code] >> (16 - size)
    return codes


class Prefix:
    """A prefix code for reading: symbol and length by the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        self.lists = None
        if len(used) <= 1:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbol, self.length = np.array([self.only]), np.array([0])
            return
        used, size = _in_order(lengths, used)
        if int((1 << (15 - size)).sum()) != 1 << 15:
            raise WebpError("a prefix code is not complete")
        self.only, self.bits = None, int(size[-1])
        # By code with the first bit highest a symbol's places follow each other.
        turn = _REVERSED[: 1 << self.bits] >> (16 - self.bits)
        each = 1 << (self.bits - size)
        self.symbol = np.repeat(used, each)[turn].astype(np.int32)
        self.length = np.repeat(size, each)[turn].astype(np.int32)

    def read(self, bits: Reader) -> int:
        if not self.bits:
            return self.only
        if self.lists is None:
            self.lists = self.symbol.tolist(), self.length.tolist()
        k = bits.at >> 3
        v = int.from_bytes(bits.data[k : k + 4], "little") >> (bits.at & 7) & ((1 << self.bits) - 1)
        bits.at += self.lists[1][v]
        return self.lists[0][v]


class Reader:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebpError("the stream ends early")
        return v

    def lengths(self, size: int) -> np.ndarray:
        out = np.zeros(size, dtype=np.int64)
        if self.bits(1):
            two = self.bits(1)
            first = self.bits(8 if self.bits(1) else 1)
            out[first] = 1
            if two:
                out[self.bits(8)] = 1
            return out
        own = np.zeros(19, dtype=np.int64)
        for s in _LENGTH_ORDER[: 4 + self.bits(4)]:
            own[s] = self.bits(3)
        code = Prefix(own)
        left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else size
        at, last = 0, 8
        while at < size and left:
            left -= 1
            s = code.read(self)
            if s < 16:
                out[at] = s
                at += 1
                last = s or last
                continue
            n = self.bits((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16]
            if at + n > size:
                raise WebpError("code lengths run over")
            if s == 16:
                out[at : at + n] = last
            at += n
        return out

    def number(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.bits(extra) + 1


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their value) of lengths or distances of 1 and more."""
    v = np.asarray(value, dtype=np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.maximum(top - 1, 0)
    prefix = np.where(v < 4, v, 2 * top + (v >> extra & 1))
    extra = np.where(v < 4, 0, extra)
    return prefix, extra, v - np.where(v < 4, v, (2 + (prefix & 1)) << extra)


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Fields of up to 24 bits each, one after the other, lowest bit first."""
    values, sizes = values.astype(np.uint64), sizes.astype(np.int64)
    take = sizes > 0
    values, sizes = values[take], sizes[take]
    end = np.cumsum(sizes)
    total = int(end[-1]) if len(end) else 0
    words = np.zeros((total >> 5) + 2, dtype=np.uint64)
    if total:
        at = end - sizes
        v = values << (at & 31).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), first)
        over = np.flatnonzero(v >> np.uint64(32))
        words[word[over] + 1] += v[over] >> np.uint64(32)
    return words.astype("<u4").tobytes()[: -(-total // 8)]


class Writer:
    """Fields gathered as numbers and arrays, packed at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def bits(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def arrays(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.parts.append((values, sizes))

    def _close(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, dtype=np.int64), np.array(self.sizes, dtype=np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self._close()
        return pack_bits(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))

    def fixed(self, symbol: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Writes the code of one symbol, which takes no bits."""
        self.values += (1, 0, int(symbol > 1), symbol)
        self.sizes += (1, 1, 1, 8 if symbol > 1 else 1)
        none = np.zeros(size, dtype=np.int64)
        return none, none

    def code(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes the code for the counts; (codes, lengths), of length 0 where only one symbol is used."""
        used = counts.nonzero()[0].tolist()
        if len(used) <= 2 and (not used or max(used) < 256):
            used = used or [0]
            if len(used) == 1:
                return self.fixed(used[0], len(counts))
            self.bits(1, 1)
            self.bits(len(used) - 1, 1)
            self.bits(int(used[0] > 1), 1)
            self.bits(used[0], 8 if used[0] > 1 else 1)
            if len(used) == 2:
                self.bits(used[1], 8)
            lengths = np.zeros(len(counts), dtype=np.int64)
            lengths[used] = len(used) - 1
            return canonical(lengths), lengths
        lengths = code_lengths(counts, 15)
        out: list[tuple[int, int, int]] = []  # (symbol, extra value, extra bits)
        top, at = int(np.flatnonzero(lengths)[-1]) + 1, 0
        seq = lengths[:top].tolist()
        while at < top:
            run = 1
            while at + run < top and seq[at + run] == seq[at]:
                run += 1
            if seq[at] == 0 and run >= 3:
                n = min(run, 138)
                out.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            elif at and seq[at] == seq[at - 1] and seq[at] and run >= 3:
                n = min(run, 6)
                out.append((16, n - 3, 2))
            else:
                n = 1
                out.append((seq[at], 0, 0))
            at += n
        own = code_lengths(np.bincount([s for s, _, _ in out], minlength=19), 7)
        most = max(4, max(i for i, s in enumerate(_LENGTH_ORDER) if own[s]) + 1)
        self.bits(0, 1)
        self.bits(most - 4, 4)
        for s in _LENGTH_ORDER[:most]:
            self.bits(int(own[s]), 3)
        if len(out) < len(counts):
            size = max(2, (max(0, len(out) - 2)).bit_length() + 1 & ~1)
            self.bits(1, 1)
            self.bits((size - 2) // 2, 3)
            self.bits(len(out) - 2, size)
        else:
            self.bits(0, 1)
        sizes = np.where(np.count_nonzero(own) > 1, own, 0)
        codes = canonical(sizes)
        for s, value, extra in out:
            self.bits(int(codes[s]), int(sizes[s]))
            if extra:
                self.bits(value, extra)
        if np.count_nonzero(lengths) == 1:
            lengths = np.zeros_like(lengths)
        return canonical(lengths), lengths


# ---------------------------------------------------------------- decoder


def _copy(out: np.ndarray, at: int, distance: int, n: int) -> None:
    if distance >= n:
        out[at : at + n] = out[at - distance : at - distance + n]
    else:
        out[at : at + n] = np.resize(out[at - distance : at], n)


def _one_symbol_pixels(bits: Reader, codes: list[Prefix], width: int, total: int) -> np.ndarray:
    """The pixels of a stream whose red, blue and alpha are fixed and which has no colour cache."""
    green, red, blue, alpha, distance = codes
    flat = np.frombuffer(bits.data + b"\0" * 16, dtype=np.uint8)
    out, at, begin = np.zeros(total, dtype=np.uint32), 0, bits.at
    fixed = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    if not green.bits:
        if green.only < 256:
            out[:] = fixed | np.uint32(green.only << 8)
            return out
        raise WebpError("a first pixel can't be a copy")
    has_copies = bool((green.symbol >= 256).any())
    near = np.array([max(1, x + y * width) for x, y in _NEAR], dtype=np.int64)
    while at < total:
        if begin >= bits.end:
            raise WebpError("the stream ends early")
        n = min(_CHUNK, bits.end - begin)
        byte = np.ascontiguousarray(flat[begin >> 3 : (begin + n + 64 >> 3) + 16])
        # The 64 bits from every byte on.
        wide = np.ascontiguousarray(np.lib.stride_tricks.as_strided(byte, (len(byte) - 7, 8), (1, 1))).view("<u8").ravel()
        first = begin & 7
        window = ((wide.astype(np.uint32)[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel()[first : first + n].view(np.int32)
        symbol = green.symbol[window]
        step = np.arange(n, dtype=np.int32) + green.length[window]
        runs = goal = None
        if has_copies:
            spots = np.flatnonzero(symbol >= 256)
            prefix = symbol[spots].astype(np.int64) - 256
            place = step[spots].astype(np.int64) + first

            def field(place, size):
                ok = np.minimum(place >> 3, len(wide) - 1)
                return wide[ok] >> (place & 7).astype(np.uint64) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))

            def number(prefix, place):
                extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
                value = np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + field(place, extra).astype(np.int64) + 1)
                return value, place + extra

            length, place = number(prefix, place)
            w = field(place, np.full(len(place), distance.bits)).astype(np.int64)
            code, place = number(distance.symbol[w].astype(np.int64), place + distance.length[w])
            code = np.where(code > 120, code - 120, near[np.clip(code, 1, 120) - 1])
            step[spots] = place - first
            runs, goal = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            runs[spots], goal[spots] = length, code
        # step with room behind: a place beyond the chunk stays where it is.
        room = int(step.max()) + 1 - n
        links = np.concatenate((step, np.arange(n, n + room, dtype=np.int32)))
        far = links
        for _ in range(_JUMP.bit_length() - 1):
            far = far[far]
        hop, p, starts = memoryview(far), 0, []
        while p < n:
            starts.append(p)
            p = hop[p]
        pos = np.empty((len(starts), _JUMP), dtype=np.int32)
        pos[:, 0] = starts
        for k in range(1, _JUMP):
            pos[:, k] = links[pos[:, k - 1]]
        pos = pos.ravel()
        pos = pos[pos < n]
        sym = symbol[pos]
        if runs is None:
            take = min(total - at, len(pos))
            out[at : at + take] = fixed | (sym[:take].astype(np.uint32) << np.uint32(8))
            at += take
        else:
            size = runs[pos]
            ends = np.cumsum(size)
            take = min(len(pos), int(np.searchsorted(ends, total - at)) + 1)
            pos, sym, size, ends = pos[:take], sym[:take], size[:take], ends[:take]
            if (sym >= 280).any():
                raise WebpError("a colour cache code without a cache")
            if at + ends[-1] > total:
                raise WebpError("a copy runs over the image")
            where = at + ends - size
            literal = sym < 256
            out[where[literal]] = fixed | (sym[literal].astype(np.uint32) << np.uint32(8))
            for i in np.flatnonzero(~literal).tolist():
                d = int(goal[pos[i]])
                if d > where[i]:
                    raise WebpError("a copy from before the image")
                _copy(out, int(where[i]), d, int(size[i]))
            at += int(ends[-1])
        begin += int(links[pos[take - 1]]) if at >= total else p
    bits.at = begin
    if begin > bits.end:
        raise WebpError("the stream ends early")
    return out


def _pixels(bits: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels of an entropy-coded image, as uint32, width x height in a row."""
    cache_bits = bits.bits(4) if bits.bits(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    meta, groups, meta_bits = None, 1, 0
    if main and bits.bits(1):
        meta_bits = bits.bits(3) + 2
        meta = (_pixels(bits, (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        groups = max(meta) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[Prefix(bits.lengths(n)) for n in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits and not any(c.bits for c in codes[0][1:4]):
        return _one_symbol_pixels(bits, codes[0], width, total)
    out, at = np.zeros(total, dtype=np.uint32), 0
    cache, seen = [0] * (1 << cache_bits), 0  # pixels before `seen` are in the cache
    across, group = (width + (1 << meta_bits) - 1) >> meta_bits, codes[0]

    def remember(upto: int) -> None:
        nonlocal seen
        for v in out[seen:upto].tolist():
            cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        seen = upto

    while at < total:
        if meta is not None:
            y, x = divmod(at, width)
            group = codes[meta[(y >> meta_bits) * across + (x >> meta_bits)]]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = bits.number(s - 256)
            d = bits.number(group[4].read(bits))
            d = d - 120 if d > 120 else max(1, _NEAR[d - 1][0] + _NEAR[d - 1][1] * width)
            if d > at or at + n > total:
                raise WebpError("a copy leaves the image")
            _copy(out, at, d, n)
            at += n
        else:
            if not cache_bits:
                raise WebpError("a colour cache code without a cache")
            remember(at)
            out[at] = cache[s - 280]
            at += 1
        if bits.at > bits.end:
            raise WebpError("the stream ends early")
    return out


def _channels(p: np.ndarray) -> np.ndarray:
    return p.view(np.uint8).reshape(*p.shape, 4).astype(np.int64)  # blue, green, red, alpha


def _predicted(mode: int, left, top, top_right, top_left):
    """The predictor's value of channels; arrays of any shape with the channels last."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.zeros_like(top) + np.array([0, 0, 0, 255])
    if mode == 11:
        p = left + top - top_left
        nearer = np.abs(p - left).sum(axis=-1) < np.abs(p - top).sum(axis=-1)
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = half(left, top)
        d = a - top_left
        return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left),
        7: lambda: half(left, top), 8: lambda: half(top_left, top), 9: lambda: half(top, top_right), 10: lambda: half(half(left, top_left), half(top, top_right)),
    }[mode]()


_NEEDS_LEFT = {1, 5, 6, 7, 10, 11, 12, 13}


def _undo_predictor(p: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Rows are rebuilt from the top; within a row, runs of a mode that doesn't look left are rebuilt at once."""
    height, width = p.shape
    c = _channels(np.ascontiguousarray(p))
    c[0, 0] = (c[0, 0] + [0, 0, 0, 255]) & 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    for y in range(1, height):
        up = c[y - 1]
        row = c[y]
        row[0] = (row[0] + up[0]) & 255
        x = 1
        while x < width:
            stop = min(width, ((x >> bits) + 1) << bits)
            mode = int(modes[y >> bits, x >> bits])
            if mode == 1:
                row[x:stop] = (np.cumsum(row[x:stop], axis=0) + row[x - 1]) & 255
            elif mode not in _NEEDS_LEFT:
                right = up[x + 1 : stop + 1]
                if len(right) < stop - x:
                    right = np.concatenate((right, row[:1]))
                row[x:stop] = (row[x:stop] + _predicted(mode, None, up[x:stop], right, up[x - 1 : stop - 1])) & 255
            else:
                for k in range(x, stop):
                    right = up[k + 1] if k + 1 < width else row[0]
                    row[k] = (row[k] + _predicted(mode, row[k - 1], up[k], right, up[k - 1])) & 255
            x = stop
    return c.astype(np.uint8).view(np.uint32).reshape(height, width)


def _signed(x):
    return (x ^ 128) - 128


def _cross(c: np.ndarray, t: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (sign -1) the parts of red and blue that elements t (blue, green, red channels) derive."""
    c = c.copy()
    red = c[..., 2].copy()
    c[..., 2] = (red + sign * (_signed(t[..., 0]) * _signed(c[..., 1]) >> 5)) & 255
    true_red = c[..., 2] if sign > 0 else red
    c[..., 0] = (c[..., 0] + sign * ((_signed(t[..., 1]) * _signed(c[..., 1]) >> 5) + (_signed(t[..., 2]) * _signed(true_red) >> 5))) & 255
    return c


def _spread(data: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return data.repeat(1 << bits, axis=0)[:height].repeat(1 << bits, axis=1)[:, :width]


def _bundle(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (uint32, height x width) of a WebP file with one VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebpError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    bits = Reader(data[20 : 20 + size])
    if bits.bits(8) != 0x2F:
        raise WebpError("no lossless signature")
    width, height = bits.bits(14) + 1, bits.bits(14) + 1
    bits.bits(1)
    if bits.bits(3):
        raise WebpError("unknown version")
    transforms, full, seen = [], width, set()
    while bits.bits(1):
        kind = bits.bits(2)
        if kind in seen:
            raise WebpError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            block = bits.bits(3) + 2
            w, h = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            transforms.append((kind, block, _pixels(bits, w, h, False).reshape(h, w), width))
        elif kind == 2:
            transforms.append((kind, 0, None, width))
        else:
            colors = bits.bits(8) + 1
            deltas = _channels(_pixels(bits, colors, 1, False))
            palette = (np.cumsum(deltas, axis=0) & 255).astype(np.uint8).view(np.uint32).ravel()
            small = _bundle(colors)
            transforms.append((kind, small, palette, width))
            width = (width + (1 << small) - 1) >> small
    p = _pixels(bits, width, height, True).reshape(height, width)
    for kind, block, extra, wide in reversed(transforms):
        if kind == 0:
            p = _undo_predictor(p, (extra >> np.uint32(8) & np.uint32(15)), block)
        elif kind == 1:
            c = _cross(_channels(np.ascontiguousarray(p)), _spread(_channels(extra), block, height, wide), 1)
            p = c.astype(np.uint8).view(np.uint32).reshape(height, wide)
        elif kind == 2:
            c = _channels(np.ascontiguousarray(p))
            c[..., 0] = (c[..., 0] + c[..., 1]) & 255
            c[..., 2] = (c[..., 2] + c[..., 1]) & 255
            p = c.astype(np.uint8).view(np.uint32).reshape(height, wide)
        else:
            index = (p >> np.uint32(8) & np.uint32(255)).astype(np.int64)
            if block:
                each = 8 >> block
                index = (index[:, :, None] >> (each * np.arange(1 << block)) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            p = np.concatenate((extra, np.zeros(256, np.uint32)))[index]
    return np.ascontiguousarray(p[:, :full])


# ---------------------------------------------------------------- encoder


def _matches(p: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, distance, length) of copies of _MATCH pixels or more, found by hashes of aligned stretches; places rise and don't overlap."""
    n = len(p)
    if n < 2 * _MATCH:
        return []
    h, size = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    mul = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while size < _MATCH:
            h = h[:-size] * mul + h[size:]
            mul, size = mul * mul, 2 * size
        h ^= h >> np.uint64(29)
    bits = max(8, min(18, n.bit_length()))
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    table_ = np.full(1 << bits, -1, dtype=np.int64)
    aligned = np.arange(0, len(h), _MATCH)[::-1]
    table_[slot[aligned]] = aligned
    from_ = table_[slot]
    found = np.flatnonzero((from_ >= 0) & (from_ < np.arange(len(h))))
    found = found[h[from_[found]] == h[found]]
    out, free = [], 0
    data = p.tobytes()
    item = p.itemsize
    for at in found.tolist():
        if at < free:
            continue
        start = int(from_[at])
        if data[start * item : (start + _MATCH) * item] != data[at * item : (at + _MATCH) * item]:
            continue
        m = _MATCH
        most = min(_MAX_COPY, n - at)
        while m < most:
            step = min(64, most - m)
            if data[(start + m) * item : (start + m + step) * item] == data[(at + m) * item : (at + m + step) * item]:
                m += step
                continue
            while m < most and data[(start + m) * item : (start + m + 1) * item] == data[(at + m) * item : (at + m + 1) * item]:
                m += 1
            break
        out.append((at, at - start, m))
        free = at + m
    return out


def _write_pixels(w: Writer, p: np.ndarray, width: int, height: int, main: bool, cache_bits: int = 0, meta_bits: int = 0) -> None:
    """An entropy-coded image of ARGB pixels in a row; copies are taken where stretches repeat."""
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    across = (width + (1 << meta_bits) - 1) >> meta_bits if meta_bits else 1
    groups = 1
    group_at = None
    if main:
        w.bits(int(meta_bits > 0), 1)
        if meta_bits:
            down = (height + (1 << meta_bits) - 1) >> meta_bits
            groups = min(3, across * down)
            of_block = np.arange(across * down) % groups
            w.bits(meta_bits - 2, 3)
            _write_pixels(w, (of_block << 8).astype(np.uint32), across, down, False)
            y, x = np.divmod(np.arange(len(p)), width)
            group_at = of_block[(y >> meta_bits) * across + (x >> meta_bits)]
    copies = _matches(p)
    place = np.array([c[0] for c in copies], dtype=np.int64)
    length = np.array([c[2] for c in copies], dtype=np.int64)
    literal = np.arange(len(p))
    if copies:
        covered = np.zeros(len(p) + 1, dtype=np.int64)
        np.add.at(covered, place, 1)
        np.add.at(covered, place + length, -1)
        literal = (np.cumsum(covered[:-1]) == 0).nonzero()[0]
    c = p.view(np.uint8).reshape(-1, 4)
    green = c[:, 1].astype(np.int64)
    cached = np.zeros(len(p), dtype=bool)
    if cache_bits:  # the cache holds every pixel so far, copied ones too
        slots, held = ((p.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).tolist(), {}
        for i, v in enumerate(p.tolist()):
            cached[i] = held.get(slots[i], 0) == v
            held[slots[i]] = v
        green = np.where(cached, 280 + np.array(slots, dtype=np.int64), green)
    len_prefix, len_extra, len_value = prefix_of(length) if copies else [length] * 3
    dist_prefix, dist_extra, dist_value = prefix_of(np.array([x[1] for x in copies], dtype=np.int64) + 120) if copies else [length] * 3
    size = 280 + (1 << cache_bits if cache_bits else 0)
    plain = literal[~cached[literal]] if cache_bits else literal
    fields = []
    for g in range(groups):
        lit, pl, cp = literal, plain, np.arange(len(place))
        if groups > 1:
            lit, pl, cp = lit[group_at[lit] == g], pl[group_at[pl] == g], (group_at[place] == g).nonzero()[0]
        counts = np.bincount(green[lit], minlength=size)
        codes = [w.code(counts + np.bincount(256 + len_prefix[cp], minlength=size) if len(cp) else counts)]
        for k in (2, 0, 3):
            own = c[pl, k]
            same = not len(own) or int(own.min()) == int(own.max())
            codes.append(w.fixed(int(own[0]) if len(own) else 0, 256) if same else w.code(np.bincount(own, minlength=256)))
        codes.append(w.code(np.bincount(dist_prefix[cp], minlength=40)) if len(cp) else w.fixed(0, 40))
        # Each field with its place in the image and its turn there.
        fields.append((lit, 0, codes[0][0][green[lit]], codes[0][1][green[lit]]))
        for turn, k in ((1, 2), (2, 0), (3, 3)):
            if codes[turn][1].any():
                fields.append((pl, turn, codes[turn][0][c[pl, k]], codes[turn][1][c[pl, k]]))
        if len(cp):
            s = 256 + len_prefix[cp]
            fields += [(place[cp], 0, codes[0][0][s], codes[0][1][s]), (place[cp], 1, len_value[cp], len_extra[cp]), (place[cp], 2, codes[4][0][dist_prefix[cp]], codes[4][1][dist_prefix[cp]]), (place[cp], 3, dist_value[cp], dist_extra[cp])]
    if len(fields) == 1:
        w.arrays(fields[0][2], fields[0][3])
        return
    order = np.argsort(np.concatenate([f[0] * 4 + f[1] for f in fields]), kind="stable")
    w.arrays(np.concatenate([f[2] for f in fields])[order], np.concatenate([f[3] for f in fields])[order])


def encode(argb: np.ndarray, palette: bool = False, subtract_green: bool = False, predictor: int = 0, cross: int = 0, cache_bits: int = 0, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of ARGB pixels (uint32, height x width).

    predictor, cross: block size in bits (2 to 9) of that transform, 0 for none; cache_bits: 1 to 11, 0 for no colour
    cache; meta_bits: block size in bits (2 to 9) of several groups of codes, 0 for one; palette: for up to 256 colours.
    """
    height, width = argb.shape
    if not 0 < width <= 16384 or not 0 < height <= 16384:
        raise ValueError("an image has 1 to 16384 rows and columns")
    w = Writer()
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)
    w.bits(0, 3)
    p = np.ascontiguousarray(argb, dtype=np.uint32)
    if palette:
        colors, index = np.unique(p, return_inverse=True)
        index = index.reshape(height, width)
        if len(colors) > 256:
            raise ValueError("a palette has 256 colours at most")
        w.bits(1, 1)
        w.bits(3, 2)
        w.bits(len(colors) - 1, 8)
        c = _channels(colors)
        deltas = np.concatenate((c[:1], np.diff(c, axis=0))) & 255
        _write_pixels(w, deltas.astype(np.uint8).view(np.uint32).ravel(), len(colors), 1, False)
        small = _bundle(len(colors))
        if small:
            each, n = 8 >> small, 1 << small
            index = np.pad(index, ((0, 0), (0, -width % n))).reshape(height, -1, n)
            index = (index << (each * np.arange(n))).sum(axis=2)
            width = index.shape[1]
        p = (index.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    if predictor:
        c = _channels(p)
        top = np.roll(c, 1, axis=0)
        left, top_left = np.roll(c, 1, axis=1), np.roll(top, 1, axis=1)
        top_right = np.roll(top, -1, axis=1)
        top_right[:, -1] = c[:, 0]
        h, wd = (height + (1 << predictor) - 1) >> predictor, (width + (1 << predictor) - 1) >> predictor
        modes = np.add.outer(np.arange(h), np.arange(wd)) % 14
        spread, guess = _spread(modes, predictor, height, width), np.zeros_like(c)
        for mode in range(14):
            guess = np.where((spread == mode)[..., None], _predicted(mode, left, top, top_right, top_left), guess)
        guess[:, 0] = top[:, 0]
        guess[0] = left[0]
        guess[0, 0] = (0, 0, 0, 255)
        w.bits(1, 1)
        w.bits(0, 2)
        w.bits(predictor - 2, 3)
        _write_pixels(w, (modes.ravel().astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), wd, h, False)
        p = ((c - guess) & 255).astype(np.uint8).view(np.uint32).reshape(height, width)
    if cross:
        h, wd = (height + (1 << cross) - 1) >> cross, (width + (1 << cross) - 1) >> cross
        t = np.zeros((h, wd, 4), dtype=np.int64)
        grid = np.add.outer(np.arange(h) * 5, np.arange(wd) * 3)
        t[..., 0], t[..., 1], t[..., 2], t[..., 3] = (grid * 7 + 250) % 256, (grid * 11 + 3) % 256, (grid * 13 + 128) % 256, 255
        w.bits(1, 1)
        w.bits(1, 2)
        w.bits(cross - 2, 3)
        _write_pixels(w, t.astype(np.uint8).view(np.uint32).ravel(), wd, h, False)
        p = _cross(_channels(p), _spread(t, cross, height, width), -1).astype(np.uint8).view(np.uint32).reshape(height, width)
    if subtract_green:
        c = _channels(p)
        c[..., 0] = (c[..., 0] - c[..., 1]) & 255
        c[..., 2] = (c[..., 2] - c[..., 1]) & 255
        p = c.astype(np.uint8).view(np.uint32).reshape(height, width)
        w.bits(1, 1)
        w.bits(2, 2)
    w.bits(0, 1)
    _write_pixels(w, np.ascontiguousarray(p).ravel(), width, height, True, cache_bits, meta_bits)
    body = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# ---------------------------------------------------------------- payloads and media columns


def padded(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of ROW."""
    return data + b"\0" * (-len(data) % ROW or (0 if data else ROW))


def store(payload: bytes) -> bytes:
    """A payload as WebP files one after the other: a byte is a sample of the green channel, 64 to a row; the palette is the bytes that occur."""
    out = []
    for s in range(0, len(payload), IMAGE_BYTES):
        samples = np.frombuffer(payload, dtype=np.uint8, count=min(IMAGE_BYTES, len(payload) - s), offset=s)
        out.append(encode((samples.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1, ROW), palette=True))
    return b"".join(out)


def load(media: bytes) -> np.ndarray:
    """Samples (uint8, rows x 64) of stored media."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append((decode(media[at : at + size]) >> np.uint32(8)).astype(np.uint8))
        at += size
    return np.concatenate(out) if out else np.zeros((0, ROW), np.uint8)


def feature(samples: np.ndarray) -> str:
    """Rows, mean, deviation, mean step between neighbours and an eight-bin histogram of the samples."""
    flat = samples.ravel()
    n = max(1, len(flat))
    hist = np.bincount(flat, minlength=256)
    level = np.arange(256)
    total = int((hist * level).sum())
    mean = total / n
    var = max(0.0, int((hist * level * level).sum()) / n - mean * mean)
    step = int(np.abs(np.diff(flat.astype(np.int16))).sum()) / n
    return f"rows={len(samples)};mean={mean:.4f};dev={var**0.5:.4f};step={step:.4f};hist=" + ",".join(map(str, hist.reshape(8, 32).sum(axis=1).tolist()))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's UTF-8 bytes, padded and stored; null or empty texts are one row of zeros. Repeated rows and equal texts give equal media."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, 1, 2 << 20):
            texts = list(blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("__text")).transform(arrow_map, run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", pixels: bool = False) -> DataFrame:
    """The columns of media without the media, and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the samples read back; with pixels the samples too. Null media give null columns; broken media raise WebpError."""
    keep = [c for c in media.columns if c != media_col]
    head = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    kind = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", samples binary" * pixels

    def run(batches):
        for batch in sliced(batches, 0, 2 << 20):
            cols: list[list] = [[] for _ in range(6 + pixels)]
            for m in batch.column(0):
                if not m.is_valid:
                    row = [None] * len(cols)
                else:
                    data = m.as_buffer().to_pybytes()
                    samples = load(data)
                    raw = samples.tobytes()
                    row = [len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples), *[raw] * pixels]
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * pixels]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["samples"] * pixels]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*keep, *names])

    return media.select(F.col(f"`{media_col}`"), *[F.col(f"`{c}`") for c in keep]).transform(arrow_map, run, f"{head}, {kind}")


def op1_webp_lossless(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as lossless WebP, read back and described."""
    return media_features(to_media(plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"])))
