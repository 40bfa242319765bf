"""Lossless WebP: a decoder for any such file, an encoder, and media columns that hold texts as pictures.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms; it gives ``height x width`` arrays of ARGB pixels. Pictures whose red, blue and
alpha codes have one symbol (grey pictures after subtract-green) are decoded in long steps: the code length at each bit
is looked up for a stretch of bits at once, and only the chain of code starts is followed one by one. The encoder chooses
copies, a palette or a predictor by what the samples are.

Defined results of :func:`store_texts`: a null or empty text is 64 zero bytes; a text of more than 2**20 bytes is
stored as several pictures after each other; equal texts give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
ROW = 64
TILE = ROW * 16384

# Fixed values of the format: order of code length codes, and offsets (x, y) of the short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_STRETCH = 1 << 15


# ---- prefix codes


def _reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the symbols, in the order in which their bits are stored."""
    codes, code = np.zeros(len(lengths), np.int64), 0
    by = np.argsort(lengths, kind="stable")
    last = 0
    for s in by[np.searchsorted(lengths[by], 1) :].tolist():
        n = int(lengths[s])
        code <<= n - last
        last = n
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return codes


class Code:
    """A prefix code for reading: symbol and length by the next ``bits`` bits. A single symbol takes no bits."""

    __slots__ = ("bits", "lengths", "single", "symbols")

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits, self.single = 0, int(used[0]) if len(used) else 0
            self.symbols, self.lengths = np.array([self.single]), np.zeros(1, np.uint8)
            return
        n = lengths[used].astype(np.int64)
        if np.sum(0.5**n) != 1:
            raise ValueError("a prefix code isn't complete")
        self.bits, self.single = int(n.max()), None
        self.symbols, self.lengths = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.uint8)
        for s, k, c in zip(used.tolist(), n.tolist(), _reversed_codes(lengths)[used].tolist(), strict=True):
            self.symbols[c :: 1 << k] = s
            self.lengths[c :: 1 << k] = k


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until none exceeds ``most``."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        parent = [0] * (2 * len(used) - 1)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        for i in range(len(used), len(parent)):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = i
            heapq.heapreplace(heap, (a[0] + b[0], i))
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [(w >> 1) + 1 for w in weights]


# ---- reading


class Bits:
    """Bits of a byte string, lowest first; zeros follow its end."""

    __slots__ = ("at", "data")

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(16), 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if code.single is not None:
            return code.single
        at = self.at
        i = int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << code.bits) - 1)
        self.at = at + int(code.lengths[i])
        return int(code.symbols[i])


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + n > size:
            raise ValueError("code lengths exceed their alphabet")
        lengths[at : at + n] = last if s == 16 else 0
        at += n
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups_of, group_bits = None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        side = 1 << group_bits
        groups_of = (_read_pixels(bits, -(-width // side), -(-height // side), False) >> np.uint32(8)) & np.uint32(0xFFFF)
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(int(groups_of.max()) + 1 if groups_of is not None else 1)]
    total = width * height
    out = np.zeros(total, np.uint32)
    if len(groups) == 1 and not cache_bits and all(c.single is not None for c in groups[0][1:4]):
        _read_grey(bits, groups[0], out, width)
        return out.reshape(height, width)
    cache = [0] * (1 << cache_bits)
    done, cached = 0, 0  # pixels written; pixels that are in the cache
    shift = 32 - cache_bits
    while done < total:
        codes = groups[int(groups_of[done // width >> group_bits, done % width >> group_bits])] if groups_of is not None else groups[0]
        s = bits.symbol(codes[0])
        if s < 256:
            red = bits.symbol(codes[1])
            blue = bits.symbol(codes[2])
            out[done] = bits.symbol(codes[3]) << 24 | red << 16 | s << 8 | blue
            done += 1
        elif s < 280:
            length = _extended(bits, s - 256)
            back = _distance(_extended(bits, bits.symbol(codes[4])), width)
            _copy(out, done, length, back)
            done += length
        else:
            for i in range(cached, done):
                p = int(out[i])
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
            cached = done
            out[done] = cache[s - 280]
            done += 1
    return out.reshape(height, width)


def _copy(out: np.ndarray, done: int, length: int, back: int) -> None:
    if back > done or done + length > len(out):
        raise ValueError("a back-reference leaves the picture")
    if back >= length:
        out[done : done + length] = out[done - back : done - back + length]
    else:
        out[done : done + length] = np.resize(out[done - back : done], length)


def _read_grey(bits: Bits, codes: list[Code], out: np.ndarray, width: int) -> None:
    """Pixels of which only green is coded."""
    green, rest = codes[0], codes[3].single << 24 | codes[1].single << 16 | codes[2].single
    done, total = 0, len(out)
    if green.single is not None and green.single < 256:
        out[:] = rest | green.single << 8
        return
    steps = np.where(green.symbols < 256, green.lengths, 0).astype(np.uint8)  # 0: a back-reference
    plain = bool((green.symbols < 256).all())
    mask = np.uint32((1 << green.bits) - 1)
    data = np.frombuffer(bits.data, np.uint8)
    while done < total:
        first = bits.at >> 3
        part = data[first : first + min(_STRETCH, (total - done) * green.bits // 8 + 4) + 2].astype(np.uint32)
        if len(part) < 3:
            raise ValueError("the picture ends early")
        words = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        windows = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & mask).astype(np.uint16).ravel()
        step = steps[windows]
        at, left = bits.at - 8 * first, total - done
        quads = np.zeros(0, np.int64)
        if plain and left >= 64:
            # codes of four symbols at once: the length of one, of two and of four codes from each bit on
            bit = np.arange(len(step))
            two = step + step[np.minimum(bit + step, len(step) - 1)]
            four = two + two[np.minimum(bit + two, len(step) - 1)]
            hop, most = four.tobytes(), len(step) - 4 * green.bits
            starts: list[int] = []
            add = starts.append
            for _ in range(left >> 2):
                if at >= most:
                    break
                add(at)
                at += hop[at]
            quads = np.array(starts, np.int64)
            half = quads + two[quads]
            quads = np.stack((quads, quads + step[quads], half, half + step[half]), axis=1).ravel()
            left -= len(quads)
        hop, most = step.tobytes(), len(step)
        singles: list[int] = []
        add = singles.append
        while at < most and left:
            n = hop[at]
            if not n:
                break
            add(at)
            at += n
            left -= 1
        places = np.concatenate((quads, np.array(singles, np.int64)))
        got = green.symbols[windows[places]]
        out[done : done + len(got)] = got.astype(np.uint32) << np.uint32(8) | np.uint32(rest)
        done += len(got)
        bits.at = 8 * first + at
        if left and at < most:
            length = _extended(bits, bits.symbol(green) - 256)
            _copy(out, done, length, _distance(_extended(bits, bits.symbol(codes[4])), width))
            done += length


# ---- transforms. Pixels as height x width x (blue, green, red, alpha) bytes where channels matter.


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _blocks(values: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(values, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The prediction of a pixel (or of many) from its neighbours, channels as integers."""
    mean = lambda a, b: (a + b) >> 1
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        nearer = np.abs(top - top_left).sum(axis=-1, keepdims=True) < np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = mean(left, top)
        return np.clip(a + np.trunc((a - top_left) / 2).astype(a.dtype), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255], left.dtype), left.shape)


def predicted(pixels: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Residuals of ``pixels`` under the block modes, or pixels of residuals."""
    height, width = pixels.shape
    if modes.min() == modes.max() and modes.min() in (1, 2):
        return _predicted_along(pixels, int(modes.min()), inverse)
    source = _channels(pixels).astype(np.int32)
    out = source.copy()
    whole = out if inverse else source  # neighbours come from here
    sign = 1 if inverse else -1
    mode = _blocks(modes, bits, height, width).copy()
    mode[0, :], mode[:, 0] = 1, 2
    mode[0, 0] = 0
    for y in range(height):
        above = whole[y - 1] if y else np.zeros((width, 4), np.int32)
        after = np.concatenate((above[1:], whole[y, :1]))  # beyond the last column comes this row's first pixel
        before = np.concatenate((above[:1], above[:-1]))
        for x in range(width):
            if x == 1:
                after[-1] = whole[y, 0]
            p = _predict(int(mode[y, x]), whole[y, x - 1] if x else above[x], above[x], before[x], after[x])
            out[y, x] = (source[y, x] + sign * p) & 255
        if inverse and width == 1:
            continue
    return np.ascontiguousarray(out.astype(np.uint8)).view(np.uint32).reshape(height, width)


def _predicted_along(pixels: np.ndarray, mode: int, inverse: bool) -> np.ndarray:
    """Residuals or pixels where the left (1) or upper (2) pixel is the prediction everywhere but on the first edges."""
    c = _channels(pixels)
    c = c if mode == 1 else c.transpose(1, 0, 2)  # along axis 1, the edge along axis 0
    out = c.copy()
    if inverse:
        out[0, 0, 3:] += np.uint8(255)  # the first prediction is opaque black
        out[:, 0] = out[:, 0].cumsum(axis=0, dtype=np.uint8)
        out = out.cumsum(axis=1, dtype=np.uint8)
    else:
        out[:, 1:] = c[:, 1:] - c[:, :-1]
        out[1:, 0] = c[1:, 0] - c[:-1, 0]
        out[0, 0, 3:] -= np.uint8(255)
    return np.ascontiguousarray(out if mode == 1 else out.transpose(1, 0, 2)).view(np.uint32).reshape(pixels.shape)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def cross_coloured(pixels: np.ndarray, elements: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Red and blue with or without what green and red tell of them."""
    c = _channels(pixels).copy()
    e = _channels(_blocks(elements, bits, *pixels.shape))
    delta = lambda factor, colour: (_signed(factor) * _signed(colour)) >> 5
    red, green, blue = c[..., 2].astype(np.int32), c[..., 1], c[..., 0].astype(np.int32)
    sign = 1 if inverse else -1
    new_red = ((red + sign * delta(e[..., 0].copy(), green.copy())) & 255).astype(np.uint8)
    full_red = new_red if inverse else red.astype(np.uint8)
    new_blue = blue + sign * (delta(e[..., 1].copy(), green.copy()) + delta(e[..., 2].copy(), full_red))
    c[..., 2], c[..., 0] = new_red, (new_blue & 255).astype(np.uint8)
    return c.view(np.uint32).reshape(pixels.shape)


def _with_green(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    c = _channels(pixels).copy()
    if inverse:
        c[..., 0] += c[..., 1]
        c[..., 2] += c[..., 1]
    else:
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
    return c.view(np.uint32).reshape(pixels.shape)


def _bundle(size: int) -> int:
    """Bits of the number of palette indices in a pixel."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _from_palette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    by = _bundle(len(table))
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if by:
        each = 8 >> by
        index = ((index[:, :, None] >> (np.arange(1 << by, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(len(pixels), -1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index[:, :width]]


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height x width, 32 bits each) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.read(3) + 2
            steps.append((kind, inner, b, _read_pixels(bits, -(-inner // (1 << b)), -(-height // (1 << b)), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _channels(_read_pixels(bits, n, 1, False)).cumsum(axis=1, dtype=np.uint8).view(np.uint32).ravel()
            steps.append((kind, inner, 0, table))
            inner = -(-inner // (1 << _bundle(n)))
        else:
            steps.append((kind, inner, 0, None))
    pixels = _read_pixels(bits, inner, height, True)
    for kind, wide, b, extra in reversed(steps):
        if kind == PREDICTOR:
            pixels = predicted(pixels, (extra >> np.uint32(8)) & np.uint32(15), b, True)
        elif kind == CROSS_COLOUR:
            pixels = cross_coloured(pixels, extra, b, True)
        elif kind == SUBTRACT_GREEN:
            pixels = _with_green(pixels, True)
        else:
            pixels = _from_palette(pixels, extra, wide)
    return pixels


# ---- writing


class Writer:
    """Bits to write, as arrays of values and widths."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.few: list[tuple[int, int]] = []

    def put(self, value: int, width: int) -> None:
        self.few.append((value, width))

    def _flush(self) -> None:
        if self.few:
            v, w = zip(*self.few, strict=True)
            self.values.append(np.array(v, np.int64))
            self.widths.append(np.array(w, np.int64))
            self.few = []

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.widths.append(widths)

    def bytes(self) -> bytes:
        self._flush()
        v, w = np.concatenate(self.values), np.concatenate(self.widths)
        out = []
        carry = np.zeros(0, np.uint8)
        for i in range(0, len(v), 1 << 18):
            part, wide = v[i : i + (1 << 18)], w[i : i + (1 << 18)]
            bit = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
            stream = np.concatenate((carry, (np.repeat(part, wide) >> bit & 1).astype(np.uint8)))
            whole = len(stream) & ~7
            out.append(np.packbits(stream[:whole], bitorder="little").tobytes())
            carry = stream[whole:]
        return b"".join([*out, np.packbits(carry, bitorder="little").tobytes()])


def _write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        wide = used[0] > 1
        for value, width in ((1, 1), (len(used) - 1, 1), (int(wide), 1), (used[0], 8 if wide else 1)):
            w.put(value, width)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    w.put(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits' value and width
    at, all_ = 0, lengths.tolist()
    while at < len(all_):
        run = at
        while run < len(all_) and all_[run] == all_[at]:
            run += 1
        n = run - at
        if all_[at] == 0 and n >= 3:
            n = min(n, 138)
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif all_[at] and n >= 4:
            tokens.append((all_[at], 0, 0))
            n = min(n - 1, 6)
            tokens.append((16, n - 3, 2))
            n += 1
        else:
            tokens.append((all_[at], 0, 0))
            n = 1
        at += n
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = _reversed_codes(own)
    last = max(i for i in range(19) if own[LENGTH_ORDER[i]])
    w.put(max(0, last - 3), 4)
    for i in range(max(4, last + 1)):
        w.put(int(own[LENGTH_ORDER[i]]), 3)
    w.put(0, 1)
    single = np.count_nonzero(own) < 2
    for s, extra, width in tokens:
        if not single:
            w.put(int(codes[s]), int(own[s]))
        w.put(extra, width)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their width of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def _symbols(flat: np.ndarray, width: int, cache_bits: int, lz: bool) -> list[tuple]:
    """Pixels as (place, green symbol, red, blue, alpha, extra value and width, distance prefix, its extra value and width)."""
    out, seen, i = [], {}, 0
    cache = [0] * (1 << cache_bits)
    near = {_distance(c + 1, width): c + 1 for c in range(len(NEAR) - 1, -1, -1)}
    values = flat.tolist()
    while i < len(values):
        n, back = 0, 0
        key = tuple(values[i : i + 3])
        if lz and len(key) == 3 and (at := seen.get(key)) is not None:
            back = i - at
            while n < 4096 and i + n < len(values) and values[at + n] == values[i + n]:
                n += 1
        if n >= 3:
            p, e, b = _prefix(n)
            out.append((i, 256 + p, None, None, None, e, b, *_prefix(near.get(back, back + len(NEAR)))))
        else:
            n, v = 1, values[i]
            k = (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache[k] == v:
                out.append((i, 280 + k, None, None, None, 0, 0, None, 0, 0))
            else:
                out.append((i, v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24, 0, 0, None, 0, 0))
        for j in range(i, i + n):
            if lz:
                seen[tuple(values[j : j + 3])] = j
            if cache_bits:
                cache[(0x1E35A7BD * values[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[j]
        i += n
    return out


def _write_pixels(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, lz: bool = False, groups: tuple[int, np.ndarray] | None = None) -> None:
    height, width = pixels.shape
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    which = np.zeros(pixels.shape, np.int64)
    if main:
        w.put(groups is not None, 1)
        if groups is not None:
            w.put(groups[0] - 2, 3)
            _write_pixels(w, groups[1].astype(np.uint32) << np.uint32(8), False)
            which = _blocks(groups[1], groups[0], height, width)
    parts = _symbols(pixels.ravel(), width, cache_bits, lz)
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    count = int(which.max()) + 1
    histograms = [[np.zeros(n, np.int64) for n in sizes] for _ in range(count)]
    group = which.ravel()[[p[0] for p in parts]].tolist()
    for g, p in zip(group, parts, strict=True):
        for h, s in zip(histograms[g], (*p[1:5], p[7]), strict=True):
            if s is not None:
                h[s] += 1
    lengths = [[code_lengths(h, 15) for h in hs] for hs in histograms]
    for each in lengths:
        for x in each:
            _write_code(w, x)
    codes = [[_reversed_codes(x) if np.count_nonzero(x) > 1 else None for x in each] for each in lengths]
    for g, p in zip(group, parts, strict=True):
        for k, s, extra, bits in ((0, p[1], p[5], p[6]), (1, p[2], 0, 0), (2, p[3], 0, 0), (3, p[4], 0, 0), (4, p[7], p[8], p[9])):
            if s is not None:
                if codes[g][k] is not None:
                    w.put(int(codes[g][k][s]), int(lengths[g][k][s]))
                w.put(extra, bits)


def _file(w: Writer) -> bytes:
    body = b"\x2f" + w.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _header(w: Writer, width: int, height: int, alpha: bool) -> None:
    for value, bits in ((width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        w.put(value, bits)


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, lz: bool = False, groups: tuple[int, np.ndarray] | None = None) -> bytes:
    """A lossless WebP file of ARGB ``pixels``.

    ``transforms``, in order: ``(PREDICTOR, bits, modes)``, ``(CROSS_COLOUR, bits, elements)``, ``(SUBTRACT_GREEN,)``,
    ``(PALETTE,)``; ``lz``: with back-references; ``groups``: bits and numbers of the blocks' prefix code groups.
    """
    height, width = pixels.shape
    w = Writer()
    _header(w, width, height, bool((pixels >> np.uint32(24) != 255).any()))
    for kind, *extra in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(extra[0] - 2, 3)
            values = extra[1].astype(np.uint32)
            _write_pixels(w, values << np.uint32(8) if kind == PREDICTOR else values, False)
            pixels = (predicted if kind == PREDICTOR else cross_coloured)(pixels, extra[1], extra[0], False)
        elif kind == SUBTRACT_GREEN:
            pixels = _with_green(pixels, False)
        else:
            table = np.unique(pixels)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(table) - 1, 8)
            c = _channels(table)
            steps = np.concatenate((c[:1], c[1:] - c[:-1])).view(np.uint32).reshape(1, -1)
            _write_pixels(w, steps, False)
            by = _bundle(len(table))
            index = np.searchsorted(table, pixels).astype(np.uint32)
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << by)))).reshape(height, -1, 1 << by)
            pixels = (index << (np.arange(1 << by, dtype=np.uint32) * np.uint32(8 >> by))).sum(axis=2, dtype=np.uint32) << np.uint32(8)
    w.put(0, 1)
    _write_pixels(w, pixels, True, cache_bits, lz, groups)
    return _file(w)


_ONE_SYMBOL = ((1, 1), (0, 1), (0, 1), (0, 1))  # simple, one symbol, of one bit, 0
_OPAQUE = ((1, 1), (0, 1), (1, 1), (255, 8))
#: Least length of a copy, and the longest that one length code tells.
COPY, LONGEST = 16, 4096
#: A transform is taken if it saves this share of the bits, by the entropy of what is left.
SAVES = 0.05
#: Bits of a copy, about.
COPY_BITS = 30


def copies(raw: bytes) -> list[tuple[int, int, int]]:
    """Copies in a byte string, in its order and without overlap: (place, length, how far back).

    A copy begins at the byte that is the most frequent one (in prose, the space), where the ``COPY`` bytes from there on
    stood at the last such place that has them.
    """
    x = np.frombuffer(raw, np.uint8)
    if len(x) < 2 * COPY:
        return []
    at = np.flatnonzero(x[: len(x) - COPY] == np.bincount(x).argmax())
    words = np.ndarray((len(x) - 7,), "<u8", raw, 0, (1,))
    h = words[at] * np.uint64(0x9E3779B97F4A7C15) ^ words[at + 8]
    by = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[by][1:] == h[by][:-1])
    out, done = [], 0
    order = np.argsort(by[same + 1])
    for i, j in zip(at[by[same + 1]][order].tolist(), at[by[same]][order].tolist(), strict=True):
        if i < done or raw[i : i + COPY] != raw[j : j + COPY]:
            continue
        n, step = COPY, COPY
        while step:  # as far as both agree
            if raw[i + n : i + n + step] == raw[j + n : j + n + step] and i + n + step <= len(raw):
                n += step
                step *= 2
            else:
                step //= 2
        for k in range(0, n, LONGEST):
            if n - k >= 3:
                out.append((i + k, min(LONGEST, n - k), i - j))
                done = i + k + min(LONGEST, n - k)
    return out


def _entropy(x: np.ndarray) -> float:
    """Bits of the samples by their own frequencies."""
    n = np.bincount(x, minlength=256).astype(float)
    n = n[n > 0]
    return float(n @ np.log2(n.sum() / n))


def encode_grey(samples: np.ndarray) -> bytes:
    """An opaque grey picture of ``height x width`` 8-bit samples.

    Samples that few values make up are indices into a palette, several in a pixel; where neighbours are alike, what the
    left or upper one doesn't predict is stored; else green with subtract-green. Each only if the entropy says so. One
    optimal prefix code holds samples and the lengths of copies.
    """
    height, width = samples.shape
    flat = np.ascontiguousarray(samples).ravel()
    w = Writer()
    _header(w, width, height, False)
    found = copies(flat.tobytes())
    literal = np.ones(len(flat), bool)
    for at, n, _ in found:
        literal[at : at + n] = False
    best, how, coded, wide = (_entropy(flat[literal]) + COPY_BITS * len(found)) * (1 - SAVES), "green", flat, width
    values = np.unique(flat)
    if 1 < len(values) <= 16:
        by = _bundle(len(values))
        index = np.searchsorted(values, samples)
        index = np.pad(index, ((0, 0), (0, -width % (1 << by)))).reshape(height, -1, 1 << by)
        packed = (index << (np.arange(1 << by) * (8 >> by))).sum(axis=2).astype(np.uint8)
        if (cost := _entropy(packed.ravel()) + 8 * len(values)) < best:
            best, how, coded, wide = cost, "palette", packed.ravel(), packed.shape[1]
    if not found and how == "green":
        grey = np.uint32(0xFF000000) | samples.astype(np.uint32) << np.uint32(8)
        for mode in (1, 2):
            left = ((_predicted_along(grey, mode, False) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).ravel()
            if (cost := _entropy(left)) < best:
                best, how, coded = cost, mode, left
    alpha = _OPAQUE
    if how == "palette":
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(values) - 1, 8)
        table = np.uint32(0xFF000000) | values.astype(np.uint32) * np.uint32(0x010101)
        c = _channels(table)
        _write_pixels(w, np.concatenate((c[:1], c[1:] - c[:-1])).view(np.uint32).reshape(1, -1), False)
    else:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        if how != "green":
            w.put(1, 1)
            w.put(PREDICTOR, 2)
            w.put(7, 3)  # blocks of 512
            _write_pixels(w, np.full((-(-height // 512), -(-width // 512)), how << 8, np.uint32), False)
            alpha = _ONE_SYMBOL
    for value in (0, 0, 0):  # no other transform, cache or groups
        w.put(value, 1)
    found = copies(coded.tobytes()) if how == "palette" else found
    _write_green(w, coded, found, alpha)
    return _file(w)


def _write_green(w: Writer, coded: np.ndarray, found: list[tuple[int, int, int]], alpha: tuple) -> None:
    """Pixels of which only green differs, and copies of earlier ones."""
    lengths_of = [_prefix(n) for _, n, _ in found]
    backs_of = [_prefix(back + len(NEAR)) for *_, back in found]
    literal = np.ones(len(coded), bool)
    for at, n, _ in found:
        literal[at : at + n] = False
    counts = np.zeros(280, np.int64)
    counts[:256] = np.bincount(coded[literal], minlength=256)
    backs = np.zeros(40, np.int64)
    for (p, *_), (q, *_) in zip(lengths_of, backs_of, strict=True):
        counts[256 + p] += 1
        backs[q] += 1
    lengths, far = code_lengths(counts, 15), code_lengths(backs, 15)
    _write_code(w, lengths)
    for value, bits in (*_ONE_SYMBOL, *_ONE_SYMBOL, *alpha):
        w.put(value, bits)
    _write_code(w, far)
    codes, far_codes = _reversed_codes(lengths), _reversed_codes(far)
    many, several = np.count_nonzero(lengths) > 1, np.count_nonzero(far) > 1
    at = 0
    for (start, n, _), (p, e, bits), (q, f, more) in zip([*found, (len(coded), 0, 0)], [*lengths_of, (0, 0, 0)], [*backs_of, (0, 0, 0)], strict=True):
        part = coded[at:start]
        if many and len(part):
            w.put_all(codes[part], lengths[part])
        if n:
            if many:
                w.put(int(codes[256 + p]), int(lengths[256 + p]))
            w.put(e, bits)
            if several:
                w.put(int(far_codes[q]), int(far[q]))
            w.put(f, more)
        at = start + n


# ---- media columns


def store(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text; its stored form: pictures of at most ``TILE`` samples each."""
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % ROW if raw else ROW)
    samples = np.frombuffer(payload, np.uint8)
    return len(raw), b"".join(encode_grey(samples[i : i + TILE].reshape(-1, ROW)) for i in range(0, len(samples), TILE))


def pictures(media: bytes) -> Iterator[np.ndarray]:
    """Pixels of the pictures that follow each other in a stored form."""
    at = 0
    while at < len(media):
        after = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield decode(media[at:after])
        at = after


def read_back(media: bytes) -> np.ndarray:
    """The samples of a stored form."""
    return np.concatenate([((p >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).ravel() for p in pictures(media)])


def feature(samples: np.ndarray) -> str:
    """Rows, mean, variance and mean step of the samples, and their share in eight equal ranges (in thousandths)."""
    x = np.bincount(samples, minlength=256)
    n, v = len(samples), np.arange(256)
    total, squares = int(x @ v), int(x @ (v * v))
    step = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))
    shares = ",".join(str(int(k) * 1000 // n) for k in x.reshape(8, 32).sum(axis=1))
    return f"rows={n // ROW};mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};step={step * 1000 // n};shares={shares}"


def decode_column(df: DataFrame, column: str, into: str = "pixels") -> DataFrame:
    """``df`` with ``{into}: struct<width:int, height:int, argb:binary>`` in place of ``column`` of lossless WebP files:
    rows of pixels, each 4 bytes as a little-endian number. Null where there is no file; what isn't one is an error."""
    names = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])
        for b in it:
            found = [None if raw is None else decode(raw) for raw in b.column(column).to_pylist()]
            shown = [None if p is None else {"width": p.shape[1], "height": p.shape[0], "argb": p.astype("<u4").tobytes()} for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(shown, kind) if n == column else b.column(n) for n in names], [into if n == column else n for n in names])

    fields = [f"`{into}` struct<width:int,height:int,argb:binary>" if n == column else f"`{n}` {k}" for n, k in df.dtypes]
    return df.mapInArrow(run, ", ".join(fields))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Digests and features of the texts as read back from their pictures; with ``with_media`` the pictures too."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for text in b.column("text"):
                n, media = store(text.as_py())
                samples = read_back(media)
                raw = samples.tobytes()
                out.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), media if with_media else None))
            cols = list(zip(*out, strict=True))
            arrays = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols[:7], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            if with_media:
                arrays.append(pa.array(cols[7], pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", media binary" if with_media else ""))
