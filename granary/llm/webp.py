"""Lossless WebP (VP8L) in numpy: a full decoder, encoders, and media columns.

The decoder reads prefix codes, meta prefix groups, back-references and the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms.

Payloads are stored with references, a colour cache and prefix codes, all pictures of a batch in
step: sorted pairs of pixels show what stands before, sorted cache slots what is in the cache, and
the bits of all tokens are put together at once. Each picture takes the cheapest of a few groups of
codes; few colours are tried with a palette, and what these codes hardly shorten with codes of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import deque
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lean, mix64, slices, staged, table

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
# Near offsets, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class DamagedImage(ValueError):
    """The bytes are no valid lossless WebP image."""


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data):
            raise DamagedImage("the stream ends too early")
        return (int.from_bytes(self.data[a >> 3 : (self.at + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0
        self.done = bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 1 << 12:
            whole = self.n >> 3
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


def _canonical(lengths) -> list[tuple[int, int, int]]:
    """(symbol, length, code as read bit by bit, first bit lowest) of every used symbol."""
    out, code = [], 0
    for n in range(1, 16):
        code <<= 1
        for s, k in enumerate(lengths):
            if k == n:
                out.append((s, n, int(f"{code:0{n}b}"[::-1], 2)))
                code += 1
    return out


class Code:
    """A prefix code; one used symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            raise DamagedImage("a prefix code without symbols")
        self.bits = 0 if len(used) == 1 else max(lengths)
        self.table = np.array([used[0] << 4])
        if self.bits:
            if sum(2 ** (15 - lengths[s]) for s in used) != 2**15:
                raise DamagedImage("a prefix code that is not complete")
            self.table = np.zeros(1 << self.bits, np.int64)
            for s, n, code in _canonical(lengths):
                self.table[code :: 1 << n] = s << 4 | n

    def read(self, bits: Bits) -> int:
        a = bits.at
        found = self.table[(int.from_bytes(bits.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7)) & ((1 << self.bits) - 1)]
        bits.at += int(found & 15)
        if bits.at > 8 * len(bits.data):
            raise DamagedImage("the stream ends too early")
        return int(found >> 4)


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        for s in [first, *([bits.read(8)] if two else [])]:
            if s >= size:
                raise DamagedImage("a symbol outside its alphabet")
            lengths[s] = 1
        return Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(own)
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    k, last = 0, 8
    while k < size and tokens:
        tokens -= 1
        s = code.read(bits)
        if s < 16:
            lengths[k] = s
            last = s or last
            k += 1
            continue
        n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if k + n > size:
            raise DamagedImage("too many code lengths")
        lengths[k : k + n] = [value] * n
        k += n
    return Code(lengths)


#: The last groups of codes that were read: colour cache bits, the stream's bits, their number, the codes.
RECENT: deque[tuple[int, int, int, list[Code]]] = deque(maxlen=8)


def _read_group(bits: Bits, cache_bits: int) -> list[Code]:
    """The five prefix codes of a group. A stream whose next bits equal those of a recent group has the same codes."""
    begin = bits.at
    for own, value, n, codes in RECENT:
        if own == cache_bits and begin + n <= 8 * len(bits.data):
            if bits.read(n) == value:
                return codes
            bits.at = begin
    codes = [_read_code(bits, n) for n in (280 + (cache_bits and 1 << cache_bits), 256, 256, 256, 40)]
    n, bits.at = bits.at - begin, begin
    RECENT.append((cache_bits, bits.read(n), n, codes))
    return codes


def _value(code: int, bits: Bits) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


class Part:
    """Where the pixels of a picture with one group of codes are to be read, four symbols of which fit into 48 bits."""

    def __init__(self, bits: Bits, group: list[Code], total: int, width: int, cache_bits: int):
        self.bits, self.group, self.total, self.width, self.cache_bits = bits, group, total, width, cache_bits


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB, in one dimension."""
    found = _open_pixels(bits, width, height, main)
    return read_in_step([found])[0] if isinstance(found, Part) else found


def _open_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray | Part:
    """As _read_pixels, but what can be read in step with others is only opened."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise DamagedImage("a colour cache that is too large")
    which, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = (_read_pixels(bits, _blocks(width, block), _blocks(height, block), False) >> np.uint32(8)) & np.uint32(0xFFFF)
    groups = [_read_group(bits, cache_bits) for _ in range(int(which.max()) + 1 if which is not None else 1)]
    total = width * height
    if which is None and sum(c.bits for c in groups[0][:4]) <= 48:
        return Part(bits, groups[0], total, width, cache_bits)
    out = [0] * total
    cache, shift = [0] * (1 << cache_bits) if cache_bits else None, 32 - cache_bits
    at, across = 0, _blocks(width, block)
    which = which.tolist() if which is not None else None
    seen = 0  # pixels that are in the cache
    group = groups[0]
    while at < total:
        if which is not None:
            y, x = divmod(at, width)
            group = groups[which[(y >> block) * across + (x >> block)]]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _value(s - 256, bits)
            d = _value(group[4].read(bits), bits)
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise DamagedImage("a reference outside the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            at += n
        else:
            while seen < at:
                p = out[seen]
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
                seen += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


NEAR_X, NEAR_Y = (np.array(x) for x in zip(*NEAR, strict=True))
IN_STEP = 1 << 21  # pixels that are held at once


def read_in_step(parts: list[Part]) -> list[np.ndarray]:
    """The pixels of many pictures: in each step, every picture that is not complete gets one pixel."""
    order = sorted(range(len(parts)), key=lambda k: -parts[k].total)
    out: list = [None] * len(parts)
    some, held = [], 0
    for k in [*order, None]:
        if k is None or some and held + parts[k].total > IN_STEP:
            try:
                found = _in_step([parts[j] for j in some]) if some else []
            except IndexError:
                raise DamagedImage("the stream ends too early") from None
            for j, pixels in zip(some, found, strict=True):
                out[j] = pixels
            some, held = [], 0
        if k is not None:
            some.append(k)
            held += parts[k].total
    return out


def _in_step(parts: list[Part]) -> list[np.ndarray]:
    """As read_in_step; larger pictures must come first."""
    U = np.uint64
    # All streams one after the other, each from an even byte; 64 bits ahead from every second byte.
    padded = [p.bits.data + b"\0" * (8 + len(p.bits.data) % 2) for p in parts]
    size = np.array([len(x) for x in padded])
    half = np.concatenate([np.frombuffer(b"".join(padded), "<u2"), np.zeros(4, np.uint16)]).astype(U)
    ahead = half[:-3] | half[1:-2] << U(16) | half[2:-1] << U(32) | half[3:] << U(48)
    base = 8 * (np.cumsum(size) - size)
    pos = base + np.array([p.bits.at for p in parts])
    last = base + 8 * np.array([len(p.bits.data) for p in parts])
    # Tables of all codes one after the other.
    tables: dict[int, int] = {}
    kept, end = [], 0
    for p in parts:
        for c in p.group:
            if id(c) not in tables:
                tables[id(c)] = end
                kept.append(c.table)
                end += len(c.table)
    table = np.concatenate(kept)
    low = np.array([[tables[id(c)] for c in p.group] for p in parts]).T
    mask = np.array([[(1 << c.bits) - 1 for c in p.group] for p in parts], U).T
    total = np.array([p.total for p in parts])
    width = np.array([p.width for p in parts])
    most, files = int(total[0]), len(parts)
    row = np.cumsum(total) - total
    flat = np.zeros(int(total.sum()), np.uint32)
    cache_bits = np.array([p.cache_bits for p in parts])
    slots = 1 << int(cache_bits.max())
    cache = np.zeros(files * slots, np.uint32)
    shift = np.minimum(32 - cache_bits, 31).astype(np.uint32)
    left, far = np.zeros(files, np.int64), np.zeros(files, np.int64)
    cached = np.flatnonzero(cache_bits)

    def peek(k):
        at = pos[k]
        return ahead[at >> 4] >> (at & 15).astype(U)

    def value(k, code):
        extra = np.maximum((code - 2) >> 1, 0)
        got = (peek(k) & ((U(1) << extra.astype(U)) - U(1))).astype(np.int64)
        pos[k] += extra
        return np.where(code < 4, code + 1, ((2 + (code & 1)) << extra) + got + 1)

    alive = files
    for t in range(most):
        while total[alive - 1] <= t:
            alive -= 1
        k = np.flatnonzero(left[:alive] == 0)
        v = peek(k)
        e = table[low[0, k] + (v & mask[0, k]).astype(np.int64)]
        s, n = e >> 4, e & 15
        plain = s < 256
        own = k[plain]
        if len(own):
            w, used, pixel = v[plain] >> n[plain].astype(U), n[plain], s[plain] << 8
            for j, by in ((1, 16), (2, 0), (3, 24)):
                e = table[low[j, own] + (w & mask[j, own]).astype(np.int64)]
                pixel |= (e >> 4) << by
                e &= 15
                w >>= e.astype(U)
                used += e
            pos[own] += used
            flat[row[own] + t] = pixel
        hit = s >= 280
        own = k[hit]
        if len(own):
            pos[own] += n[hit]
            flat[row[own] + t] = cache[own * slots + s[hit] - 280]
        ref = ~(plain | hit)
        own = k[ref]
        if len(own):
            pos[own] += n[ref]
            left[own] = value(own, s[ref] - 256)
            e = table[low[4, own] + (peek(own) & mask[4, own]).astype(np.int64)]
            pos[own] += e & 15
            d = value(own, e >> 4)
            close = np.minimum(d, 120) - 1
            far[own] = np.where(d > 120, d - 120, np.maximum(1, NEAR_X[close] + NEAR_Y[close] * width[own]))
            if (far[own] > t).any() or (t + left[own] > total[own]).any():
                raise DamagedImage("a reference outside the image")
        own = np.flatnonzero(left[:alive])
        if len(own):
            at = row[own] + t
            flat[at] = flat[at - far[own]]
            left[own] -= 1
        own = cached[: np.searchsorted(cached, alive)]
        if len(own):
            pixel = flat[row[own] + t]
            cache[own * slots + ((pixel * np.uint32(CACHE_FACTOR)) >> shift[own])] = pixel
    if (pos > last).any():
        raise DamagedImage("the stream ends too early")
    for p, at in zip(parts, (pos - base).tolist(), strict=True):
        p.bits.at = at
    return [flat[k : k + n] for k, n in zip(row.tolist(), total.tolist(), strict=True)]


def _split(p: np.ndarray) -> np.ndarray:
    """ARGB -> the bytes blue, green, red, alpha, in a last dimension."""
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4)


def _half(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _predict(mode: int, left, top, tr, tl):
    """The prediction from four neighbours, each four channel values."""
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode < 5:
        return (left, top, tr, tl)[mode - 1]
    if mode == 5:
        return _half(_half(left, tr), top)
    if mode < 10:
        return _half(*((left, tl), (left, top), (tl, top), (top, tr))[mode - 6])
    if mode == 10:
        return _half(_half(left, tl), _half(top, tr))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, tl, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, tl, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, tl, strict=True)]
    return [min(255, max(0, h + int((h - c) / 2))) for h, c in zip(_half(left, top), tl, strict=True)]


def _predicted(p: np.ndarray, modes: np.ndarray, block: int, back: bool) -> np.ndarray:
    """The predictor transform (back: its inverse) of a picture; modes: by block."""
    h, w = p.shape
    if back and h > 1 and w > 0 and len(used := np.unique(modes)) == 1 and used[0] == 2:
        c = _split(p).copy()
        c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255
        c[0] = np.cumsum(c[0], axis=0, dtype=np.uint8)
        return np.cumsum(c, axis=0, dtype=np.uint8).view(np.uint32).reshape(h, w)
    given = _split(p).tolist()
    out = [[None] * w for _ in range(h)] if back else given
    made = [[None] * w for _ in range(h)]
    source = out if back else given
    mode = modes.tolist()
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = source[0][x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = source[y - 1][0]
            else:
                tr = source[y - 1][x + 1] if x + 1 < w else source[y][0]
                guess = _predict(mode[y >> block][x >> block], source[y][x - 1], source[y - 1][x], tr, source[y - 1][x - 1])
            sign = 1 if back else -1
            made[y][x] = [(v + sign * g) & 255 for v, g in zip(given[y][x], guess, strict=True)]
            if back:
                out[y][x] = made[y][x]
    return np.array(made, np.uint8).view(np.uint32).reshape(h, w)


def _crossed(p: np.ndarray, factors: np.ndarray, block: int, back: bool) -> np.ndarray:
    """The cross-colour transform (back: its inverse); factors: by block, blue, green and red hold green to red, green to blue, red to blue."""
    h, w = p.shape
    c = _split(p).copy()
    f = _split(factors)[np.arange(h)[:, None] >> block, np.arange(w)[None, :] >> block].view(np.int8).astype(np.int32)
    part = lambda t, v: (t * v.view(np.int8).astype(np.int32)) >> 5
    sign = 1 if back else -1
    green, red = c[..., 1].copy(), c[..., 2].copy()
    made = ((red + sign * part(f[..., 0], green)) & 255).astype(np.uint8)
    true_red = made if back else red
    c[..., 0] = (c[..., 0] + sign * (part(f[..., 1], green) + part(f[..., 2], true_red))) & 255
    c[..., 2] = made
    return c.view(np.uint32).reshape(h, w)


def _green(p: np.ndarray, back: bool) -> np.ndarray:
    c = _split(p).copy()
    for k in (0, 2):
        c[..., k] += c[..., 1] if back else -c[..., 1]
    return c.view(np.uint32).reshape(p.shape)


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode_one(data: bytes) -> np.ndarray:
    """A WebP file with a VP8L chunk -> ARGB picture (height, width), uint32."""
    return decode_files([data])[0]


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """As decode_one, for many files, whose pixels are read in step."""
    opened = [_open(x) for x in files]
    some = [k for k, x in enumerate(opened) if isinstance(x[0], Part)]
    found = dict(zip(some, read_in_step([opened[k][0] for k in some]), strict=True))
    return [_inverted(found.get(k, p), *more) for k, (p, *more) in enumerate(opened)]


def _open(data: bytes) -> tuple[np.ndarray | Part, list, int, int]:
    """Pixels (or where they are), transforms, and size of the coded picture."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != SIGNATURE:
        raise DamagedImage("no lossless WebP header")
    (n,) = struct.unpack_from("<I", data, 16)
    if 20 + n > len(data):
        raise DamagedImage("the file ends too early")
    bits = Bits(data[21 : 20 + n])
    full, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise DamagedImage("an unknown version")
    width, undo, seen = full, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise DamagedImage("a transform that comes twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            size = _blocks(height, block), _blocks(width, block)
            undo.append((kind, block, _read_pixels(bits, size[1], size[0], False).reshape(size), width))
        elif kind == 2:
            undo.append((2, 0, None, width))
        else:
            colours = bits.read(8) + 1
            palette = np.cumsum(_split(_read_pixels(bits, colours, 1, False)), axis=0, dtype=np.uint8).view(np.uint32).reshape(-1)
            undo.append((3, _pack_bits(colours), palette, width))
            width = _blocks(width, _pack_bits(colours))
    return _open_pixels(bits, width, height, True), undo, height, width


def _inverted(p: np.ndarray, undo: list, height: int, width: int) -> np.ndarray:
    """The picture of coded pixels: all transforms inverted, the last one first."""
    p = p.reshape(height, width)
    for kind, block, extra, width in reversed(undo):
        if kind == 0:
            p = _predicted(p, (extra >> np.uint32(8)) & np.uint32(15), block, True)
        elif kind == 1:
            p = _crossed(p, extra, block, True)
        elif kind == 2:
            p = _green(p, True)
        else:
            index = (p >> np.uint32(8)) & np.uint32(255)
            if block:
                each = 8 >> block
                parts = (index[:, :, None] >> (each * np.arange(1 << block, dtype=np.uint32))) & np.uint32((1 << each) - 1)
                index = parts.reshape(height, -1)[:, :width]
            p = np.concatenate([extra, np.zeros(256, np.uint32)])[index]
    return p


# --- encoder -------------------------------------------------------------------------------------


def _lengths(counts: dict[int, int], size: int, most: int = 15) -> list[int]:
    """Code lengths for the counts, none above most."""
    out, floor = [0] * size, 1
    if len(counts) == 1:
        out[next(iter(counts))] = 1
        return out
    while True:
        heap = [(max(n, floor), s, (s,)) for s, n in counts.items()]
        heapify(heap)
        out = [0] * size
        while len(heap) > 1:
            a, b = heappop(heap), heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out) <= most:
            return out
        floor *= 2


def _put_code(w: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Write a prefix code; symbol -> (bits, length)."""
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        used, lengths = [0], [1, *lengths[1:]]
    if len(used) <= 2 and used[-1] < 256 and all(lengths[s] == 1 for s in used):
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    w.put(0, 1)
    tokens, k = [], 0
    while k < len(lengths):
        run = 1
        while k + run < len(lengths) and lengths[k + run] == lengths[k]:
            run += 1
        n = lengths[k]
        k += run
        if n:
            tokens.append((n, 0, 0))
            run -= 1
            while run >= 3:
                m = min(run, 6)
                tokens.append((16, m - 3, 2))
                run -= m
        else:
            while run >= 3:
                m = min(run, 138)
                tokens.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
                run -= m
        tokens += [(n, 0, 0)] * run
    counts: dict[int, int] = {}
    for t, _, _ in tokens:
        counts[t] = counts.get(t, 0) + 1
    own = _lengths(counts, 19, 7)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(own[s], 3)
    w.put(0, 1)
    codes = {s: (c, n) for s, n, c in _canonical(own)} if len(counts) > 1 else {t: (0, 0) for t in counts}
    for t, value, n in tokens:
        w.put(*codes[t])
        w.put(value, n)
    return {s: (c, n) for s, n, c in _canonical(lengths)} if len(used) > 1 else {used[0]: (0, 0)}


def _prefix(value: int) -> tuple[int, int, int]:
    """Code, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _tokens(p: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """Literals, cache hits and (greedy, hashed) back-references that make up the pixels."""
    near = {}
    for d, (x, y) in reversed(list(enumerate(NEAR, 1))):
        near[max(1, x + y * width)] = d
    cache, shift = {}, 32 - cache_bits
    out, at, last = [], 0, {}
    while at < len(p):
        n, d = 0, 0
        if references and at + 2 < len(p):
            key = (p[at], p[at + 1], p[at + 2])
            if key in last:
                d = at - last[key]
                while n < 4096 and at + n < len(p) and p[at + n] == p[at + n - d]:
                    n += 1
        if n >= 3:
            out.append(("ref", n, near.get(d, d + 120)))
        elif cache_bits and cache.get((CACHE_FACTOR * p[at] & 0xFFFFFFFF) >> shift) == p[at]:
            n = 1
            out.append(("cache", (CACHE_FACTOR * p[at] & 0xFFFFFFFF) >> shift, 0))
        else:
            n = 1
            out.append(("pixel", p[at], 0))
        for k in range(at, at + n):
            if cache_bits:
                cache[(CACHE_FACTOR * p[k] & 0xFFFFFFFF) >> shift] = p[k]
            if references and k + 2 < len(p):
                last[p[k], p[k + 1], p[k + 2]] = k
        at += n
    return out


def _put_pixels(w: Writer, p: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> None:
    h, width = p.shape
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    which = lambda k: 0
    if main:
        w.put(bool(group_bits), 1)
    if main and group_bits:
        by, bx = _blocks(h, group_bits), _blocks(width, group_bits)
        groups = min(3, by * bx)
        w.put(group_bits - 2, 3)
        _put_pixels(w, ((np.arange(by * bx, dtype=np.uint32) % groups) << 8).reshape(by, bx), False)
        which = lambda k: (((k // width) >> group_bits) * bx + ((k % width) >> group_bits)) % groups
    tokens = _tokens(p.reshape(-1).tolist(), width, cache_bits, references)
    counts = [[{} for _ in range(5)] for _ in range(groups)]
    coded, at = [], 0
    for kind, x, y in tokens:
        if kind == "pixel":
            one, n = [(0, x >> 8 & 255, 0, 0), (1, x >> 16 & 255, 0, 0), (2, x & 255, 0, 0), (3, x >> 24, 0, 0)], 1
        elif kind == "cache":
            one, n = [(0, 280 + x, 0, 0)], 1
        else:
            a, b = _prefix(x), _prefix(y)
            one, n = [(0, 256 + a[0], a[1], a[2]), (4, *b)], x
        g = which(at)
        for c, s, _, _ in one:
            counts[g][c][s] = counts[g][c].get(s, 0) + 1
        coded.append((g, one))
        at += n
    codes = [[_put_code(w, _lengths(c, n) if c else [0] * n) for c, n in zip(group, (280 + (cache_bits and 1 << cache_bits), 256, 256, 256, 40), strict=True)] for group in counts]
    for g, one in coded:
        for c, s, extra, n in one:
            w.put(*codes[g][c][s])
            w.put(extra, n)


def encode_one(p: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> bytes:
    """ARGB picture -> WebP file. transforms: ("predictor", modes, block), ("cross", factors, block), ("green",), ("palette",), in the order of coding."""
    h, width = p.shape
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(h - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    for kind, *more in transforms:
        w.put(1, 1)
        w.put(("predictor", "cross", "green", "palette").index(kind), 2)
        if kind in ("predictor", "cross"):
            extra, block = more
            w.put(block - 2, 3)
            _put_pixels(w, np.asarray(extra, np.uint32) << np.uint32(8) if kind == "predictor" else extra, False)
            p = _predicted(p, np.asarray(extra), block, False) if kind == "predictor" else _crossed(p, extra, block, False)
        elif kind == "green":
            p = _green(p, False)
        else:
            colours, index = np.unique(p, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette has 256 colours at most")
            w.put(len(colours) - 1, 8)
            _put_pixels(w, np.diff(_split(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).view(np.uint32).reshape(1, -1), False)
            by = _pack_bits(len(colours))
            index = np.pad(index.reshape(h, -1).astype(np.uint32), ((0, 0), (0, -p.shape[1] % (1 << by))))
            p = (index.reshape(h, -1, 1 << by) << ((8 >> by) * np.arange(1 << by, dtype=np.uint32))).sum(axis=2, dtype=np.uint32) << np.uint32(8)
    w.put(0, 1)
    _put_pixels(w, p, True, cache_bits, references, group_bits)
    return _file(w.bytes())


def _file(data: bytes) -> bytes:
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


# --- payloads as pictures ------------------------------------------------------------------------

WIDTH = 16
CACHE_BITS = 10
LINES = 128  # of a picture at most, as many are read in step
LONGEST = 4096  # pixels of a reference


def _weights(kind: str) -> np.ndarray:
    """How often bytes are expected: in Latin letters, in scripts of several bytes a character, in letters and digits that stand for numbers, or all alike."""
    w = np.full(256, 0.05)
    if kind == "even":
        return w
    if kind == "digits":
        w[list(b"0123456789abcdef")], w[65:91], w[103:123], w[[10, 32, 43, 45, 47, 61, 95]] = 10, 4, 4, 4
        return w
    w[[10, 44, 46]] = 10
    w[32], w[48:58], w[65:91], w[97:123] = 160, 2, 3, 10
    w[list(b"etaoinsrhl")] = 60
    if kind == "wide":
        w[97:123], w[32] = 4, 40
        w[0x80:0xC0], w[0xC2:0xF5] = 20, 8
    else:
        w[0x80:0xC0], w[0xC3] = 0.5, 10
    return w


class Group:
    """Five prefix codes that are known beforehand: bits and lengths of every symbol, and a picture's head behind its size."""

    def __init__(self, kind: str):
        own = _weights(kind)
        own = own / own.sum()
        lengths = 2.0 ** (-np.arange(24) / 3)
        first = np.concatenate([0.5 * own, 0.15 * lengths / lengths.sum(), np.full(1 << CACHE_BITS, 0.35 / (1 << CACHE_BITS))])
        w = Writer()
        w.put(0, 1)
        w.put(1 | CACHE_BITS << 1, 5)
        w.put(0, 1)
        self.code, self.bits = [], []
        for weights in (first, own, own, own, np.ones(40)):
            made = _put_code(w, _lengths({k: int(x * 2**24) + 1 for k, x in enumerate(weights)}, len(weights), 12))
            self.code.append(np.array([made[k][0] for k in range(len(weights))], np.uint64))
            self.bits.append(np.array([made[k][1] for k in range(len(weights))], np.uint8))
        self.head_size = 8 * len(w.done) + w.n
        value = int.from_bytes(w.bytes(), "little")
        parts = range(0, self.head_size, 48)
        self.head = np.array([(value >> k) & (1 << 48) - 1 for k in parts], np.uint64)
        self.head_bits = np.array([min(48, self.head_size - k) for k in parts], np.uint64)


@cache
def _groups() -> list[Group]:
    return [Group(k) for k in ("latin", "wide", "digits", "even")]


@cache
def _near(width: int) -> np.ndarray:
    """The short codes of distances (0: none)."""
    out = np.zeros(8 * width + 16, np.int64)
    for d, (x, y) in reversed(list(enumerate(NEAR, 1))):
        out[max(1, x + y * width)] = d
    return out


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _prefix, for many values."""
    v = np.maximum(value - 1, 2)
    top = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    code = np.where(value <= 4, value - 1, 2 * top + ((v >> (top - 1)) & 1))
    extra = np.where(value <= 4, 0, v & ((1 << (top - 1)) - 1))
    return code, extra, np.where(value <= 4, 0, top - 1)


def _references(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and distance of references in pixels of pictures (own) one after the other: runs whose pairs stood at one distance before."""
    none = np.zeros(0, np.int64)
    if len(p) < 2:
        return none, none, none
    pair = (p[:-1].astype(np.uint64) << np.uint64(32)) | p[1:]
    order = np.argsort(mix64(pair ^ mix64(own[:-1].astype(np.uint64))), kind="stable")
    a, b = order[:-1], order[1:]
    # A pair that straddles two pictures is none.
    same = (pair[a] == pair[b]) & (own[a] == own[b]) & (own[b] == own[b + 1]) & (own[a] == own[a + 1])
    far = np.zeros(len(pair) + 1, np.int64)
    far[b[same]] = (b - a)[same]
    first = far > 0
    first[1:] &= (far[1:] != far[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(first)
    last = far > 0
    last[:-1] &= (far[1:] != far[:-1]) | (own[1:] != own[:-1])
    end, d = np.flatnonzero(last) + 2, far[begin]
    begin[1:] = np.maximum(begin[1:], end[:-1])
    good = end - begin >= 3
    begin, n, d = begin[good], (end - begin)[good], d[good]
    parts = -(-n // LONGEST)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, n, d = np.repeat(begin, parts) + step * LONGEST, np.repeat(n, parts) - step * LONGEST, np.repeat(d, parts)
    return begin, np.minimum(n, LONGEST), d


def encode_pictures(p: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Pictures of WIDTH pixels a line, ARGB one after the other, with so many pixels each -> files."""
    files = len(counts)
    own = np.repeat(np.arange(files), counts)
    slot = ((p.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)
    place = (own.astype(np.uint64) << np.uint64(CACHE_BITS)) | slot
    order = np.argsort(place, kind="stable")
    new = np.concatenate([[True], place[order[1:]] != place[order[:-1]]])
    hit = np.zeros(len(p), bool)
    hit[order[1:]] = ~new[1:] & (p[order[1:]] == p[order[:-1]])
    colours = np.bincount(own[order[new]], minlength=files)  # at least

    begin, n, d = _references(p, own)
    edge = np.zeros(len(p) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n, -1)
    token = np.cumsum(edge[:-1]) == 0
    token[begin] = True
    at = np.flatnonzero(token)
    kind = hit[at].astype(np.int8)  # 0: a pixel, 1: from the cache, 2: a reference
    kind[np.searchsorted(at, begin)] = 2
    plain, cached, ref, whose = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1), np.flatnonzero(kind == 2), own[at]
    channels = [((p[at[plain]] >> np.uint32(k)) & np.uint32(255)) for k in (8, 16, 0, 24)]
    near = _near(WIDTH)
    short = np.where(d < len(near), near[np.minimum(d, len(near) - 1)], 0)
    size, far = _prefixes(n), _prefixes(np.where(short > 0, short, d + 120))

    known = _groups()
    code, length = ([np.array([x[j] for x in own]) for j in range(5)] for own in ([g.code for g in known], [g.bits for g in known]))
    symbol = slot[at[cached]].astype(np.int64) + 280
    costs = []
    for k, g in enumerate(known):
        used = np.zeros(len(at), np.uint8)
        used[plain] = sum(length[j][k][c] for j, c in enumerate(channels))
        used[cached] = length[0][k][symbol]
        used[ref] = length[0][k][256 + size[0]] + length[4][k][far[0]] + size[2].astype(np.uint8) + far[2].astype(np.uint8)
        costs.append(np.bincount(whose, used, files) + g.head_size)
    best = np.argmin(costs, axis=0)
    value, used = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)

    def coded(which, *fields):
        """Put the fields of tokens, (code, symbols) or (None, bits, their number), one behind the other."""
        g, v, n = best[whose[which]], np.zeros(len(which), np.uint64), np.zeros(len(which), np.uint64)
        for j, symbols, *bits in fields:
            if j is None:
                v |= symbols.astype(np.uint64) << n
                n += bits[0].astype(np.uint64)
            else:
                v |= code[j][g, symbols] << n
                n += length[j][g, symbols]
        value[which], used[which] = v, n

    coded(plain, *enumerate(channels))
    coded(cached, (0, symbol))
    coded(ref, (0, 256 + size[0]), (None, size[1], size[2]), (4, far[0]), (None, far[1], far[2]))

    # The head of every picture, then its tokens.
    heads = np.array([1 + len(g.head) for g in known])[best]
    tokens = np.bincount(whose, minlength=files)
    start = np.cumsum(heads + tokens) - heads - tokens
    values, bits = np.zeros(len(at) + heads.sum(), np.uint64), np.zeros(len(at) + heads.sum(), np.uint64)
    lines = counts // WIDTH
    values[start] = np.uint64(SIGNATURE) | np.uint64((WIDTH - 1) << 8 | 1 << 36) | ((lines - 1).astype(np.uint64) << np.uint64(22))
    bits[start] = 40
    for k, g in enumerate(known):
        where = (start[best == k][:, None] + 1 + np.arange(len(g.head))).reshape(-1)
        values[where], bits[where] = np.tile(g.head, (best == k).sum()), np.tile(g.head_bits, (best == k).sum())
    where = np.arange(len(at)) - np.repeat(np.cumsum(tokens) - tokens, tokens) + (start + heads)[whose]
    values[where], bits[where] = value, used
    total = np.add.reduceat(bits, start).astype(np.int64)
    words = -(-total // 64)
    base = np.cumsum(words) - words
    begin = np.cumsum(bits).astype(np.int64) - bits.astype(np.int64)
    begin += np.repeat(64 * base - begin[start], heads + tokens)
    out, low = np.zeros(words.sum() + 1, np.uint64), (begin & 63).astype(np.uint64)
    np.add.at(out, begin >> 6, values << low)
    np.add.at(out, (begin >> 6) + 1, (values >> np.uint64(1)) >> (np.uint64(63) - low))
    raw = out.astype("<u8").tobytes()
    stored = [_file(raw[8 * b : 8 * b + (n + 7) // 8]) for b, n in zip(base.tolist(), total.tolist(), strict=True)]

    # Few colours, and what has hardly become shorter, in other ways too.
    first = np.cumsum(counts) - counts
    poor = (total > 29 * counts) & (counts >= 256)
    for k in np.flatnonzero((colours <= 16) & (counts >= 64) | poor).tolist():
        picture = p[first[k] : first[k] + counts[k]].reshape(-1, WIDTH)
        ways = [(), (("green",),)] if poor[k] else []
        if len(np.unique(picture)) <= 256:
            ways.append((("palette",),))
        stored[k] = min([stored[k], *(encode_one(picture, way, 0, True) for way in ways)], key=len)
    return stored


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Payloads, each a multiple of 64 bytes, as pictures of 16 RGBA pixels a line; one file after the other, of LINES lines at most. What is made of one does not depend on the others."""
    if not payloads:
        return []
    rgba = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 4)
    argb = np.ascontiguousarray(rgba[:, (2, 1, 0, 3)]).view(np.uint32)[:, 0]
    most = LINES * WIDTH
    counts = [[min(most, len(x) // 4 - k) for k in range(0, len(x) // 4, most)] for x in payloads]
    files = iter(encode_pictures(argb, np.array([n for own in counts for n in own], np.int64)))
    return [b"".join(next(files) for _ in own) for own in counts]


def decode(stored: bytes) -> np.ndarray:
    """Files one after the other -> pixel array (lines, width, 4), RGBA."""
    return decode_all([stored])[0]


def decode_all(stored: list[bytes]) -> list[np.ndarray]:
    """As decode, for many."""
    files, counts = [], []
    for x in stored:
        at, n = 0, len(files)
        while at < len(x):
            if at + 8 > len(x):
                raise DamagedImage("the file ends too early")
            end = at + 8 + struct.unpack_from("<I", x, at + 4)[0]
            files.append(x[at:end])
            at = end
        counts.append(len(files) - n)
    found = iter(decode_files(files))
    out = []
    for n in counts:
        parts = [next(found) for _ in range(n)]
        out.append(_split(np.concatenate(parts))[..., (2, 1, 0, 3)] if parts else np.zeros((0, WIDTH, 4), np.uint8))
    return out


def with_media(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored) with a media column: the text's bytes as lossless WebP.

    The payload is the text in UTF-8 (null: empty), filled with zero bytes to a positive multiple of
    64. Repeated rows are stored alike; an empty table gives an empty one. A text is held whole by its task
    (2 GB at most); its pictures have 8 KB each.
    """

    def store(batches):
        for b in slices(batches, 1):
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            media = encode_all([x + b"\0" * (-len(x) % 64 or 64 * (not x)) for x in raw])
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def grid(values: np.ndarray, parts: int = 72) -> np.ndarray:
    """Means over so many equal parts of the values; fewer values are repeated."""
    edge = np.arange(parts + 1) * len(values) // parts
    if len(values) < parts:
        return values[edge[:-1]].astype(np.float64)
    return np.add.reduceat(values, edge[:-1]) / np.diff(edge)


def media_pixels(media: DataFrame) -> DataFrame:
    """doc_id, height, width, pixels (RGBA bytes, line by line) of every row of a media column."""

    def show(batches):
        for b in slices(batches, 1):
            pictures = decode_all(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in pictures], pa.int32()), pa.array([x.shape[1] for x in pictures], pa.int32()), pa.array([x.tobytes() for x in pictures], pa.binary())], ["doc_id", "height", "width", "pixels"])

    return media.select("doc_id", "media").mapInArrow(show, "doc_id long, height int, width int, pixels binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode a media column and describe the pixels.

    feature: lines x width, the mean of each channel in hundredths, and a 64-bit hash of the
    differences between neighbours on an 8 x 9 grid of means over equal parts of all pixels. The other
    columns describe the payload that the pixels hold, and the stored bytes.
    """

    def describe(batches):
        for b in slices(batches, 2):
            out = []
            media = b.column(2).to_pylist()
            for doc, n, stored, pixels in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), media, decode_all(media), strict=True):
                payload = pixels.tobytes()
                light = pixels[..., :3].sum(axis=2, dtype=np.int64).reshape(-1)
                bits = np.packbits(np.diff(grid(light).reshape(8, 9), axis=1) > 0).tobytes().hex()
                means = ",".join(str(int(x) * 100 // (pixels.shape[0] * pixels.shape[1])) for x in pixels.sum(axis=(0, 1), dtype=np.int64))
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{pixels.shape[0]}x{pixels.shape[1]} {means} {bits}"))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(describe, FEATURES)


def op8_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written to the shared folder and read back."""
    return media_features(staged(with_media(table(spark, sf_dir, "documents")), "media"))
