"""Progressive JPEG media columns: files become full-resolution RGB tensors.

Each scan of a file refines coefficient arrays: DC first and refinement, AC by spectral selection and successive approximation.
After the last scan all blocks of a component are dequantised and inverse-transformed at once in numpy, chroma is upsampled
to the image's size, and the colours are converted. Files of the same scans and tables are read at once, a code of each at a
step; others, and those with anything odd, one by one. The module also writes such files, for pages that have none and for tests.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
K = np.arange(8)
#: COSINE[x, u]: the inverse transform of one axis.
COSINE = np.cos((2 * K[:, None] + 1) * K[None, :] * np.pi / 16) * np.where(K == 0, np.sqrt(0.125), 0.5)


UNZIGZAG = np.argsort(ZIGZAG)

#: Bits of a refining code, with the sign that follows if it is of a new coefficient.
SPENT = [(code >> 8) + (code & 15 > 0) for code in range(17 << 8)]
#: The largest coefficient of files that are read at once.
MOST = (1 << 15) - 1
#: What a refining code is: of a new coefficient, one that ends blocks, none.
NEW, ENDS, NONE = 1 << 8, 1 << 9, 1 << 10
#: Pixels of files that are read at once (they are taken from four times as many bytes), and the number of files below which a step in Python for each is faster.
AT_ONCE, FEW = 1 << 23, 32


class Corrupt(ValueError):
    """A file that isn't a progressive or baseline JPEG of 8 bits and 1 or 3 components, or that ends too early."""


class Bits:
    """A scan's bits, as 32 of them from each byte on, so that a read costs the same in a large scan; stuffed zeros are gone,
    restart markers end a segment."""

    __slots__ = ("at", "bits", "bytes", "n")

    def __init__(self, raw: bytes):
        raw = raw.replace(b"\xff\x00", b"\xff")
        self.n = 8 * len(raw)
        self.bytes = np.frombuffer(raw + b"\xff" * 11, np.uint8)
        self.bits = _window(self.bytes).tolist()
        self.at = 0

    def single(self, at: np.ndarray) -> np.ndarray:
        """The bits at some places."""
        return self.bytes[at >> 3].astype(np.int64) >> (7 - (at & 7)) & 1


def _table(counts: bytes, symbols: bytes) -> list[int]:
    """Of each 16-bit prefix, code length << 8 | symbol; 0 where no code begins so."""
    out: list[int] = []
    i = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out += [length << 8 | symbols[i]] * (1 << (16 - length))
            i += 1
    if len(out) > 1 << 16:
        raise Corrupt("Huffman code too long")
    return out + [0] * ((1 << 16) - len(out))


class Table(list):
    @cached_property
    def numbers(self) -> np.ndarray:
        return np.array(self)

    @cached_property
    def refining(self) -> np.ndarray:
        """Of each prefix what it says in a refining scan: zeros passed << 11, NEW, ENDS or NONE, and bits spent."""
        code = self.numbers
        zeros, size = code >> 4 & 15, code & 15
        return np.where(size > 0, NEW, np.where(zeros < 15, ENDS, 0)) | np.where(code == 0, NONE, 0) | zeros << 11 | np.array(SPENT)[code]


@cache
def _cached_table(counts: bytes, symbols: bytes) -> Table:
    return Table(_table(counts, symbols))


@lru_cache(maxsize=64)
def _order(mcus: tuple[int, int], shapes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(which, i) of the blocks of an interleaved scan: of shapes (h, v, blocks_x) which component, and which block of it."""
    my, mx = (x.ravel() for x in np.indices(mcus))
    parts = [(k, (my * v + y) * blocks_x + mx * h + x) for k, (h, v, blocks_x) in enumerate(shapes) for y in range(v) for x in range(h)]
    return np.tile([k for k, _ in parts], len(my)), np.stack([i for _, i in parts], 1).ravel()


class Component:
    def __init__(self, name: int, h: int, v: int, q: int):
        self.name, self.h, self.v, self.q = name, h, v, q
        self.dc = self.ac = 0


class Decoder:
    """Reads one file; coefficients: for each component an array of blocks, each of 64 numbers in zigzag order."""

    def __init__(self, data: bytes, wait: bool = False):
        """If told to wait, its scans are only found and put into `waiting`."""
        self.data, self.quant, self.huffman = data, {}, {}
        self.wait, self.waiting = wait, []
        self.components: list[Component] = []
        self.restart, self.scans = 0, 0
        try:
            self._segments()
        except (IndexError, KeyError, StopIteration, ValueError, ZeroDivisionError) as e:
            raise Corrupt(str(e)) from e

    def _segments(self):
        data = self.data
        if data[:2] != b"\xff\xd8":
            raise Corrupt("no start of image")
        at = 2
        while True:
            while data[at] != 0xFF:
                at += 1
            while data[at] == 0xFF:
                at += 1
            marker = data[at]
            at += 1
            if marker == 0xD9:
                break
            if marker == 0x01 or 0xD0 <= marker <= 0xD7:
                continue
            size = int.from_bytes(data[at : at + 2], "big")
            if at + size > len(data):
                raise Corrupt("ends within a segment")
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = _cached_table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body, marker == 0xC2)
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Corrupt("lossless, hierarchical or arithmetic coding")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                at = self._scan(body, at)
        if not self.components or not self.scans:
            raise Corrupt("no image")

    def _quantisation(self, body: bytes):
        while body:
            wide, n = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            self.quant[n] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int64)
            body = body[1 + size :]

    def _frame(self, body: bytes, progressive: bool):
        if self.components or body[0] != 8:
            raise Corrupt("not one frame of 8 bits")
        self.progressive = progressive
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if not self.height or not self.width or body[5] not in (1, 3):
            raise Corrupt("size or components")
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        if len(self.components) == 1:
            self.components[0].h = self.components[0].v = 1
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.blocks_x, c.blocks_y = self.mcus_x * c.h, self.mcus_y * c.v
            c.own_x, c.own_y = -(-(-(-self.width * c.h // self.hmax)) // 8), -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.blocks = None if self.wait else np.zeros((c.blocks_x * c.blocks_y, 64), np.int64)

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0]
        chosen = []
        for i in range(n):
            c = next(c for c in self.components if c.name == body[1 + 2 * i])
            c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            chosen.append(c)
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        data, end, segments, begin = self.data, at, [], at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise Corrupt("ends within a scan")
            m = data[end + 1]
            if m == 0:
                end += 2
            elif 0xD0 <= m <= 0xD7:
                segments.append(data[begin:end])
                begin = end = end + 2
            else:
                break
        segments.append(data[begin:end])
        if self.wait:
            tables = [self.huffman.get(c.dc if first == 0 else 16 | c.ac) for c in chosen]
            self.waiting.append(([self.components.index(c) for c in chosen], tables, (first, last, high, low), segments))
            self.scans += 1
            return end
        if n == 1:
            c = chosen[0]
            each, index = 1, (np.arange(c.own_y)[:, None] * c.blocks_x + np.arange(c.own_x)).ravel()
            which = np.zeros(len(index), np.int64)
        else:
            each = sum(c.v * c.h for c in chosen)
            which, index = _order((self.mcus_y, self.mcus_x), tuple((c.h, c.v, c.blocks_x) for c in chosen))
        step = (self.restart or len(index)) * each
        for k, raw in enumerate(segments):
            units = chosen, which[k * step : (k + 1) * step], index[k * step : (k + 1) * step]
            bits = Bits(raw)
            if not self.progressive:
                self._baseline(bits, units)
            elif first == 0:
                if last:
                    raise Corrupt("DC and AC in one scan")
                self._dc_first(bits, units, low) if high == 0 else self._dc_refine(bits, units, low)
            elif n > 1:
                raise Corrupt("AC of several components in one scan")
            elif high == 0:
                self._ac_first(bits, units, first, last, low)
            else:
                self._ac_refine(bits, units, first, last, low)
            if bits.at > bits.n + 7:
                raise Corrupt("a scan ends too early")
        self.scans += 1
        return end

    def _dc_first(self, bits: Bits, units, low: int):
        stream, at = bits.bits, 0
        chosen, which, index = units
        tables, before, found = [self.huffman.get(c.dc) for c in chosen], [0] * len(chosen), []
        for k in which.tolist():
            if tables[k] is None:
                raise KeyError(chosen[k].dc)
            code = tables[k][stream[at >> 3] >> (32 - (at & 7) - 16) & 0xFFFF]
            at += code >> 8
            size = code & 0xFF
            if size:
                v = stream[at >> 3] >> (32 - (at & 7) - size) & ((1 << size) - 1)
                at += size
                before[k] += v if v >> (size - 1) else v - (1 << size) + 1
            found.append(before[k] << low)
        values = np.array(found, np.int64)
        for k, c in enumerate(chosen):
            c.blocks[index[which == k], 0] = values[which == k]
        bits.at = at

    def _dc_refine(self, bits: Bits, units, low: int):
        chosen, which, index = units
        one = bits.single(np.arange(len(index))) << low
        for k, c in enumerate(chosen):
            c.blocks[index[which == k], 0] |= one[which == k]
        bits.at = len(index)

    def _ac_first(self, bits: Bits, units, first: int, last: int, low: int):
        stream, at, run = bits.bits, 0, 0
        (c,), _, index = units
        table = self.huffman[16 | c.ac] if len(index) else None
        places, values = [], []
        for i in index.tolist():
            if run:
                run -= 1
                continue
            base, k = i << 6, first
            while k <= last:
                code = table[stream[at >> 3] >> (32 - (at & 7) - 16) & 0xFFFF]
                at += code >> 8
                zeros, size = code >> 4 & 15, code & 15
                if size:
                    k += zeros
                    v = stream[at >> 3] >> (32 - (at & 7) - size) & ((1 << size) - 1)
                    at += size
                    if k > 63:
                        raise IndexError("list assignment index out of range")
                    places.append(base + k)
                    values.append(v << low if v >> (size - 1) else -((1 << size) - 1 - v << low))
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    if code == 0:
                        raise Corrupt("no such code")
                    run = (1 << zeros) - 1
                    if zeros:
                        run += stream[at >> 3] >> (32 - (at & 7) - zeros) & ((1 << zeros) - 1)
                        at += zeros
                    break
        c.blocks.ravel()[np.array(places, np.int64)] = values
        bits.at = at

    def _ac_refine(self, bits: Bits, units, first: int, last: int, low: int):
        (c,), _, index = units
        if len(index) and first <= last <= 63:
            own = c.blocks[index, first : last + 1]
            right, at = _refine(self.huffman[16 | c.ac], bits.bytes, own, np.array([0]), np.array([bits.n]), np.array([0, len(own)]), low)
            if right[0]:
                c.blocks[index, first : last + 1] = own
                bits.at = int(at[0])
                return
        self._ac_refine_by_numbers(bits, units, first, last, low)

    def _ac_refine_by_numbers(self, bits: Bits, units, first: int, last: int, low: int):
        stream, at, run = bits.bits, 0, 0
        (c,), _, index = units
        table, blocks = self.huffman[16 | c.ac] if len(index) else None, c.blocks.tolist()
        one = 1 << low
        for i in index.tolist():
            block, k = blocks[i], first
            if not run:
                while k <= last:
                    code = table[stream[at >> 3] >> (32 - (at & 7) - 16) & 0xFFFF]
                    if code == 0:
                        raise Corrupt("no such code")
                    at += code >> 8
                    zeros, size = code >> 4 & 15, code & 15
                    new = 0
                    if size:
                        new = one if stream[at >> 3] >> (32 - (at & 7) - 1) & 1 else -one
                        at += 1
                    elif zeros != 15:
                        run = 1 << zeros
                        if zeros:
                            run += stream[at >> 3] >> (32 - (at & 7) - zeros) & ((1 << zeros) - 1)
                            at += zeros
                        break
                    while k <= last:
                        v = block[k]
                        if v:
                            if stream[at >> 3] >> (32 - (at & 7) - 1) & 1 and not abs(v) & one:
                                block[k] = v + one if v > 0 else v - one
                            at += 1
                        elif zeros == 0:
                            if new:
                                block[k] = new
                            k += 1
                            break
                        else:
                            zeros -= 1
                        k += 1
            if run:
                while k <= last:
                    v = block[k]
                    if v:
                        if stream[at >> 3] >> (32 - (at & 7) - 1) & 1 and not abs(v) & one:
                            block[k] = v + one if v > 0 else v - one
                        at += 1
                    k += 1
                run -= 1
        c.blocks[:] = blocks
        bits.at = at

    def _baseline(self, bits: Bits, units):
        stream, at = bits.bits, 0
        chosen, which, index = units
        before = {c.name: 0 for c in chosen}
        for c, i in zip([chosen[k] for k in which.tolist()], index.tolist()):
            block, k = [0] * 64, 0
            while k < 64:
                code = self.huffman[c.dc if k == 0 else 16 | c.ac][stream[at >> 3] >> (32 - (at & 7) - 16) & 0xFFFF]
                if code == 0:
                    raise Corrupt("no such code")
                at += code >> 8
                zeros, size = (code >> 4 & 15, code & 15) if k else (0, code & 0xFF)
                k += zeros
                v = 0
                if size:
                    v = stream[at >> 3] >> (32 - (at & 7) - size) & ((1 << size) - 1)
                    at += size
                    v = v if v >> (size - 1) else v - (1 << size) + 1
                elif k and zeros != 15:
                    break
                if k == 0:
                    before[c.name] += v
                    v = before[c.name]
                block[k] = v
                k += 1
            c.blocks[i] = block
        bits.at = at

    def coefficients(self) -> list[np.ndarray]:
        """For each component its quantised coefficients, blocks_y x blocks_x x 64 in zigzag order."""
        return [c.blocks.reshape(c.blocks_y, c.blocks_x, 64) for c in self.components]

    def shape(self) -> tuple:
        """What files have in common whose pixels can be computed at once."""
        return self.height, self.width, tuple((c.h, c.v, self.quant[c.q].tobytes()) for c in self.components)

    def rgb(self) -> np.ndarray:
        """height x width x 3, uint8."""
        return self.pixels(self.coefficients())

    def pixels(self, coefficients: list[np.ndarray]) -> np.ndarray:
        """The pixels of coefficients of this file, or of several of its shape() along a first axis."""
        full = []
        for q, c in zip(coefficients, self.components):
            p = plane(q, self.quant[c.q])[..., : -(-self.height * c.v // self.vmax), : -(-self.width * c.h // self.hmax)]
            full.append(upsample(p, self.vmax / c.v, self.hmax / c.h)[..., : self.height, : self.width])
        out = np.empty((*full[0].shape, 3), np.uint8)
        if len(full) == 1:
            out[:] = full[0].round().clip(0, 255)[..., None]
            return out
        y, b, r = full[0], full[1] - 128, full[2] - 128
        for k, p in enumerate((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b)):
            out[..., k] = p.round(out=p).clip(0, 255, out=p)
        return out


def plane(quantised: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """A component's samples from its coefficients: all blocks are dequantised and inverse-transformed at once. Other axes may
    come first."""
    *more, h, w, _ = quantised.shape
    flat = (quantised * quant).take(UNZIGZAG, -1).astype(float).reshape(-1, h, w, 8, 8)
    return (COSINE @ flat @ COSINE.T).transpose(0, 1, 3, 2, 4).reshape(*more, 8 * h, 8 * w) + 128


def upsample(p: np.ndarray, v: float, h: float) -> np.ndarray:
    """Linear interpolation between sample centres, to v and h times the size."""
    for axis, f in ((-2, v), (-1, h)):
        if f != 1:
            n = p.shape[axis]
            at = ((np.arange(round(n * f)) + 0.5) / f - 0.5).clip(0, n - 1)
            a = at.astype(int)
            b, t = np.minimum(a + 1, n - 1), at - a
            shape = (-1, 1) if axis == -2 else (1, -1)
            p = p.take(a, axis) * (1 - t.reshape(shape)) + p.take(b, axis) * t.reshape(shape)
    return p


def decode(data: bytes) -> np.ndarray:
    d = Decoder(data)
    if not _dequantised(d):
        raise Corrupt("no quantisation table")
    return d.rgb()


# --- reading many files at once ----------------------------------------------------------------------------------------


def decode_all(files: list[bytes]) -> list[np.ndarray | Corrupt]:
    """decode() of several files; of those it raises Corrupt for, the error."""
    out: list = [None] * len(files)
    alike, shapes = defaultdict(list), defaultdict(list)
    # those of about the same length take about as many steps
    for i in sorted(range(len(files)), key=lambda i: -len(files[i])):
        try:
            d = Decoder(files[i], wait=True)
            if _plain(d):
                alike[_signature(d)].append((i, d))
        except Corrupt:
            pass  # it is read alone, to find the same error
    for group in alike.values():
        while len(group) > 1:
            size = np.cumsum([d.height * d.width for _, d in group])
            n = max(1, int(np.searchsorted(size, AT_ONCE, "right")))
            now, group = group[:n], group[n:]
            if n == 1:
                continue
            shapes.clear()
            for (i, d), right, q in zip(now, *_read_together([d for _, d in now])):
                if right:
                    shapes[d.shape()].append((i, d, q))
            for same in shapes.values():
                pixels = same[0][1].pixels([np.stack(q) for q in zip(*(q for _, _, q in same))])
                for (i, _, _), x in zip(same, pixels):
                    out[i] = x
    for i, data in enumerate(files):
        if out[i] is None:
            try:
                out[i] = decode(data)
            except Corrupt as e:
                out[i] = e
    return out


def _dequantised(d: Decoder) -> bool:
    return all(len(d.quant.get(c.q, ())) == 64 for c in d.components)


def _plain(d: Decoder) -> bool:
    """Whether a file has only scans that _read_together knows: progressive ones without restarts."""
    for chosen, tables, (first, last, high, low), segments in d.waiting:
        coded = first > 0 or high == 0
        if low > 13 or len(segments) > 1 or len(set(chosen)) < len(chosen) or coded and (tables[0] is None or any(t is not tables[0] for t in tables)):
            return False
        if last if first == 0 else len(chosen) > 1 or not first <= last <= 63:
            return False
    return d.progressive and not d.restart and _dequantised(d)


def _signature(d: Decoder) -> tuple:
    """What files have in common that can be read at once; tables are kept for good, so their ids tell them apart."""
    return tuple((c.h, c.v) for c in d.components), tuple((*chosen, id(tables[0]) if first or not high else 0, first, last, high, low) for chosen, tables, (first, last, high, low), _ in d.waiting)


def _read_together(files: list[Decoder]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """(which files were read without anything odd, of each the coefficients() of its components)."""
    right = np.ones(len(files), bool)
    parts = len(files[0].components)
    wide, high = ([np.array([getattr(d.components[k], x) for d in files]) for k in range(parts)] for x in ("blocks_x", "blocks_y"))
    begin = [np.r_[0, np.cumsum(w * h)] for w, h in zip(wide, high)]
    blocks = [np.zeros((b[-1], 64), np.int16) for b in begin]

    @cache
    def places(k: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each file's blocks begin in a scan of component k alone, the blocks)."""
        w, h = (np.array([getattr(d.components[k], x) for d in files]) for x in ("own_x", "own_y"))
        at = np.r_[0, np.cumsum(w * h)]
        i = np.arange(at[-1]) - np.repeat(at[:-1], w * h)
        y, x = np.divmod(i, np.repeat(w, w * h))
        return at, np.repeat(begin[k][:-1], w * h) + y * np.repeat(wide[k], w * h) + x

    @cache
    def interleaved(chosen: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each file's blocks begin in a scan of components, of each block which of them, and the block)."""
        orders = [_order((d.mcus_y, d.mcus_x), tuple((d.components[k].h, d.components[k].v, d.components[k].blocks_x) for k in chosen)) for d in files]
        n = [len(i) for _, i in orders]
        which, index = (np.concatenate(x) for x in zip(*orders))
        return np.r_[0, np.cumsum(n)], which, index + np.stack([begin[k][:-1] for k in chosen])[which, np.repeat(np.arange(len(files)), n)]

    for s, (chosen, tables, (first, last, refines, low), _) in enumerate(files[0].waiting):
        raws = [d.waiting[s][3][0].replace(b"\xff\x00", b"\xff") for d in files]
        length = np.array([len(r) for r in raws])
        stream = np.frombuffer((b"\xff" * 11).join([*raws, b""]), np.uint8)
        start = 8 * (np.cumsum(length + 11) - length - 11)
        end = start + 8 * length
        if first == 0:
            if len(chosen) == 1:
                of, index = places(chosen[0])
                which = np.zeros(len(index), np.int64)
            else:
                of, which, index = interleaved(tuple(chosen))
            if refines:
                at = start + np.diff(of)
                # a scan that is too short is found by its end; what is read for it then doesn't matter
                place = np.repeat(start - of[:-1], np.diff(of)) + np.arange(len(index))
                bit = (stream.take(place >> 3, mode="clip") >> (7 - (place & 7)) & 1) << low
                for j, k in enumerate(chosen):
                    blocks[k][index[which == j], 0] |= bit[which == j].astype(np.int16)
            else:
                good, at, values = _dc_values(tables[0], stream, start, end, of, which, len(chosen), low)
                right &= good
                for j, k in enumerate(chosen):
                    blocks[k][index[which == j], 0] = values[which == j]
        else:
            (k,) = chosen
            of, index = places(k)
            if refines:
                own = blocks[k][index, first : last + 1]
                good, at = _refine(tables[0], stream, own, start, end, of, low)
                blocks[k][index, first : last + 1] = own
            else:
                good, at, place, values = _ac_values(tables[0], stream, start, end, of, last - first + 1, low)
                block, i = np.divmod(place, last - first + 1)
                blocks[k][index[block], first + i] = values
            right &= good
        right &= at <= end + 7
    return right, [[blocks[k][begin[k][i] : begin[k][i + 1]].reshape(high[k][i], wide[k][i], 64) for k in range(parts)] for i in range(len(files))]


def _window(stream: np.ndarray) -> np.ndarray:
    """32 bits of a stream of bytes from each byte on."""
    return np.ndarray(len(stream) - 3, ">u4", stream, strides=(1,)).astype(np.int64)


def _some(window: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of n bits, 25 at most, at some places."""
    return window.take(at >> 3, mode="clip") >> (32 - (at & 7) - n) & (1 << n) - 1


def _chain(window: np.ndarray, steps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where codes begin in streams that begin and end at some bits, and in which): each is followed by the next after its
    step, whatever it means. What follows the last code that counts is told too."""
    found, at, till = [], start, end
    while len(at) >= FEW:
        for _ in range(8):
            found.append(at)
            at = np.minimum(at + steps.take(window.take(at >> 3) >> (16 - (at & 7)) & 0xFFFF), till)
        on = at < till
        at, till = at[on], till[on]
    if len(at):
        steps = steps.tolist()
        for x, z in zip(at.tolist(), till.tolist()):
            base, own, one = x & ~7, window[x >> 3 : (z >> 3) + 1].tolist(), []
            x, z = x - base, z - base
            while x < z:
                one.append(x)
                x += steps[own[x >> 3] >> (16 - (x & 7)) & 0xFFFF]
            found.append(np.array(one, np.int64) + base)
    at = np.sort(np.concatenate(found))
    stream = np.searchsorted(start, at, "right") - 1
    on = at < end[stream]
    return at[on], stream[on]


def _dc_values(table: Table, stream: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, which: np.ndarray, parts: int, low: int):
    """(which files are right, where their scans end, the values of the blocks) of first DC scans."""
    table, window = table.numbers, _window(stream)
    at, own = _chain(window, np.maximum((table >> 8) + (table & 0xFF), 1), start, end)
    n, need = np.bincount(own, minlength=len(start)), np.diff(of)
    right = n >= need
    i = np.repeat(np.cumsum(n) - n - of[:-1], need) + np.arange(of[-1])
    at = np.r_[at, 0].take(i, mode="clip")
    code = table.take(_some(window, at, 16))
    size = code & 0xFF
    file = np.repeat(np.arange(len(start)), need)
    # a code that there isn't has no bits; the tables of one file alone read on there
    right[file[(code == 0) | (size > 16)]] = False
    size = np.minimum(size, 16)
    at = at + (code >> 8)
    v = _some(window, at, size)
    step = np.where((size > 0) & (v >> np.maximum(size - 1, 0) == 0), v - (1 << size) + 1, v)
    values = np.empty(len(step), np.int64)
    for k in range(parts):
        mine = which == k
        total = np.cumsum(step[mine])
        first = np.searchsorted(file[mine], np.arange(len(start)))
        values[mine] = total - np.r_[0, total].take(first)[file[mine]]
    values <<= low
    right[file[np.abs(values) > MOST]] = False
    return right, (at + size)[of[1:] - 1], values.clip(-MOST, MOST)


def _ac_values(table: Table, stream: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, wide: int, low: int):
    """(which files are right, where their scans end, places among their blocks' coefficients, their values) of first AC scans.

    How long a code is doesn't depend on where it stands. Coefficients are counted on over the ends of blocks; codes that end a
    block begin at one's first coefficient or later, so that what they end is told by the coefficients since the code before."""
    table, window = table.numbers, _window(stream)
    zeros, size = table >> 4 & 15, table & 15
    at, own = _chain(window, np.maximum((table >> 8) + np.where(size > 0, size, np.where(zeros < 15, zeros, 0)), 1), start, end)
    code = table.take(_some(window, at, 16))
    zeros, size = code >> 4 & 15, code & 15
    at = at + (code >> 8)
    ends = (size == 0) & (zeros < 15)
    n = np.where(ends, 0, zeros + 1)
    run = np.where(ends, (1 << zeros) + _some(window, at, np.where(ends, zeros, 0)), 0)
    # parts of a file's codes, each up to one that ends blocks, the last one perhaps without
    first = np.r_[True, ends[:-1] | (own[1:] != own[:-1])][: len(own)]
    part, begins = np.cumsum(first) - 1, np.flatnonzero(first)
    total = np.r_[0, np.cumsum(n)]
    length = np.diff(np.r_[total[begins], total[-1]])
    blocks = length // wide + np.add.reduceat(run, begins) if len(begins) else length
    before = np.cumsum(blocks) - blocks
    file = own[begins]
    before += of[:-1][file] - before[np.searchsorted(file, file)]  # blocks before each part
    f = before[part] * wide + total[:-1] - total[begins][part]
    limit = of[1:][own] * wide
    used = f < limit
    right = np.zeros(len(start), bool)
    after = np.where(ends, (f // wide + run) * wide, f + n)
    at = at + np.where(ends, zeros, size)
    stop = np.zeros(len(start), np.int64)
    final = np.flatnonzero(used & (after >= limit))  # of each file the one code that completes its blocks
    right[own[final]], stop[own[final]] = True, at[final]
    right[own[used & ((code == 0) | ~ends & (f % wide + n > wide))]] = False
    new = used & (size > 0) & right[own]
    size, at = size[new], at[new] - size[new]
    v = _some(window, at, size)
    values = np.where(v >> (size - 1), v, v - (1 << size) + 1) << low
    right[own[new][np.abs(values) > MOST]] = False
    return right, stop, (f + zeros)[new], values.clip(-MOST, MOST)


def _refine(table: Table, stream: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(which files are right, where their scans end) of refining AC scans, which change `own`, the files' blocks, in place.

    A step for each code of every file and none for each coefficient: the zeros that a code passes tell where it ends, the others
    that lie between have a bit each, read at the end. A file isn't right if a code passes its block's end, or there is none."""
    wide = own.shape[1]
    there = own != 0
    zero = np.ones(own.size + 16, bool)  # with some that no file has
    np.equal(own.ravel(), 0, out=zero[:-16])
    zero = np.flatnonzero(zero)
    passed = np.searchsorted(zero, np.arange(0, own.size + 1, wide))  # zeros before each block
    one = np.zeros(own.size - passed[-1], bool)  # bits of the others
    window, limits = _window(stream), of[1:] * wide
    right, wrong, stop = np.zeros(len(start), bool), np.zeros(len(start), bool), np.zeros(len(start), np.int64)
    bit = lambda at: stream.take(at >> 3, mode="clip") >> (7 - (at & 7)) & 1

    def read(codes: list[tuple]) -> None:
        """What codes mean: of each its file, what it says, the first coefficient after the code before, the one after its last,
        the others that aren't zero before the former, and where its corrections begin and end."""
        file, code, f, till, first, begun, after = (np.concatenate(x) for x in zip(*codes))
        limit = limits.take(file)
        used = np.flatnonzero(f < limit)
        if len(used) < len(f):
            file, code, f, till, first, begun, after, limit = (x.take(used) for x in (file, code, f, till, first, begun, after, limit))
        odd = (code & NONE > 0) | (code & ENDS == 0) & (till > (f // wide + 1) * wide)
        wrong[file[odd]] = True
        full = np.flatnonzero(till == limit)
        right[file[full]], stop[file[full]] = True, after[full]
        count = after - begun
        some = np.flatnonzero((count > 0) & ~odd)
        count, first, from_ = count.take(some), first.take(some), begun.take(some)
        ahead = np.cumsum(count) - count
        within = np.arange(ahead[-1] + count[-1] if len(some) else 0)
        one[np.repeat(first - ahead, count) + within] = bit(np.repeat(from_ - ahead, count) + within)
        new = np.flatnonzero((code & NEW > 0) & ~odd)
        own.reshape(-1)[till.take(new) - 1] = (2 * bit(begun.take(new) - 1) - 1) << low

    file = np.arange(len(start))
    at, f, z, last = start, of[:-1] * wide, passed[of[:-1]], of[1:]
    c = f - z
    while len(file) >= FEW:
        found = []
        for _ in range(16):
            code = table.refining.take(window.take(at >> 3, mode="clip") >> (16 - (at & 7)) & 0xFFFF)
            z2, begun = z + (code >> 11), at + (code & 255)
            till = zero.take(z2, mode="clip")
            c2 = till - z2
            after = begun + c2
            after -= c
            till += 1
            z2 += 1
            e = (code & ENDS).nonzero()[0]
            if len(e):
                block = f.take(e) // wide
                block += 1
                n = code.take(e) >> 11
                if n.any():
                    b = begun.take(e)
                    block = np.minimum(block + (1 << n) - 1 + _some(window, b, n), last.take(e))
                    b += n
                    begun[e] = b
                t, past = block * wide, passed.take(block, mode="clip")
                till[e], z2[e] = t, past
                t -= past
                c2[e] = t
                t += begun.take(e)
                t -= c.take(e)
                after[e] = t
            found.append((file, code, f, till, c, begun, after))
            at, f, z, c = after, till, z2, c2
        read(found)
        on = f < last * wide
        if not on.all():
            file, at, f, z, c, last = file[on], at[on], f[on], z[on], c[on], last[on]
    found = []
    for i, *state in zip(file.tolist(), end[file].tolist(), at.tolist(), f.tolist(), z.tolist(), last.tolist()):
        rest = _refine_one(table, window, zero, passed, wide, *state)
        found.append((np.full(len(rest[0]), i), *rest))
    if found:
        read(found)
    v = own[there]
    own[there] = v + np.where(one & (np.abs(v) >> low & 1 == 0), np.sign(v) << low, v.dtype.type(0))
    return right & ~wrong, stop


def _refine_one(table: Table, window: np.ndarray, zero: np.ndarray, passed: np.ndarray, wide: int, stop: int, at: int, f: int, z: int, last: int) -> list[np.ndarray]:
    """The rest of a file's codes for _refine: (what they say, coefficients they begin at, those after their last, those that aren't
    zero before the former, bits their corrections begin and end at). It ends at whatever isn't right."""
    base, byte, first = f // wide, at >> 3, f
    zeros_left = zero[z : passed[last]].tolist() + [1 << 62] * 16
    ahead = (passed[base : last + 1] - z).tolist()
    stream, at = window[byte : (stop >> 3) + 8].tolist(), at - 8 * byte
    codes, tills, passes, begun = [], [], [], []
    n, end, b, z, begin = last - base, (base + 1) * wide, 0, 0, z
    try:
        while b < n:
            code = table[stream[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
            zeros = code >> 4 & 15
            if code & 15 or zeros == 15:
                at += SPENT[code]
                z += zeros
                t = zeros_left[z]
                if t >= end:
                    break
                z += 1
                codes.append(NEW if code & 15 else 0)
                begun.append(at)
                passes.append(z)
                at += t - f - zeros
                f = t + 1
                tills.append(f)
                if f == end:
                    b += 1
                    end += wide
            else:
                if code == 0:
                    break
                at += code >> 8
                run = 1 << zeros
                if zeros:
                    run += stream[at >> 3] >> (32 - (at & 7) - zeros) & run - 1
                    at += zeros
                b = min(b + run, n)
                t = (base + b) * wide
                codes.append(ENDS)
                begun.append(at)
                tills.append(t)
                at += t - f - ahead[b] + z
                f, z = t, ahead[b]
                passes.append(z)
                end = f + wide
    except IndexError:
        pass
    # at the end of code and place there may be one more than of the others
    code, till, z, begun = (np.array(x[: len(tills)], np.int64) for x in (codes, tills, passes, begun))
    f = np.r_[first, till][:-1]
    c = f - np.r_[0, z][:-1] - begin
    begun += 8 * byte
    return [code, f, till, c, begun, begun + till - z - begin - c]


# --- writing -----------------------------------------------------------------------------------------------------------

#: One code for all tables: every symbol has 8 bits and none is all ones.
COUNTS = bytes([0] * 7 + [255, 0] + [0] * 7)
DC_COUNTS = bytes([0, 0, 0, 12] + [0] * 12)
BASE_QUANT = np.array([16, 11, 12, 14, 12, 10, 16, 14, 13, 14, 18, 17, 16, 19, 24, 40, 26, 24, 22, 22, 24, 49, 35, 37, 29, 40, 58, 51, 61, 60, 57, 51, 56, 55, 64, 72, 92, 78, 64, 68, 87, 69, 55, 56, 80, 109, 81, 87, 95, 98, 103, 104, 103, 62, 77, 113, 121, 112, 100, 120, 92, 101, 103, 99])
SYMBOLS = bytes(range(255))
#: Samples of pictures that are written at once.
TOGETHER = 1 << 20
#: (components, first, last, high, low): the usual ten scans of a colour file.
SCANS = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)]


class Writer:
    def __init__(self):
        self.value, self.n, self.whole = 0, 0, []

    def put(self, v: int, n: int):
        self.value = self.value << n | v
        self.n += n
        if self.n >= 4096:  # a large number is slow to add to
            rest = self.n % 8
            self.whole.append((self.value >> rest).to_bytes(self.n // 8, "big"))
            self.value, self.n = self.value & (1 << rest) - 1, rest

    def done(self) -> bytes:
        pad = -self.n % 8
        raw = b"".join(self.whole) + (self.value << pad | (1 << pad) - 1).to_bytes((self.n + pad) // 8, "big")
        return raw.replace(b"\xff", b"\xff\x00")


def _magnitude(w: Writer, v: int, size: int):
    w.put(v if v > 0 else v + (1 << size) - 1, size)


def _write_scan(blocks: list[list[int]], spec: tuple) -> bytes:
    """An AC scan of one page, coefficient by coefficient."""
    _, first, last, high, low = spec
    w = Writer()
    run, waiting = 0, []  # blocks to skip; their correction bits

    def flush():
        nonlocal run, waiting
        while run:
            size = min(run.bit_length() - 1, 14)
            now = min(run, (2 << size) - 1)
            w.put(size << 4, 8)
            w.put(now - (1 << size), size)
            run -= now
        for b in waiting:
            w.put(b, 1)
        waiting = []

    for block in blocks:
        own = [(abs(v) >> low) for v in block[first : last + 1]]
        if not any(own):
            run += 1
            if run == 32767:
                flush()
            continue
        if high == 0:
            final = max(i for i, v in enumerate(own) if v)
            flush()
            zeros = 0
            for i in range(final + 1):
                v = own[i]
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    w.put(0xF0, 8)
                    zeros -= 16
                size = v.bit_length()
                w.put(zeros << 4 | size, 8)
                _magnitude(w, v if block[first + i] > 0 else -v, size)
                zeros = 0
            if final < last - first:
                run += 1
            continue
        new = [i for i, v in enumerate(own) if v == 1]
        final, zeros, corrections = new[-1] if new else -1, 0, []
        if final >= 0:
            flush()
        for i, v in enumerate(own):
            if v > 1:
                corrections.append(v & 1)
            elif v == 0:
                zeros += 1
                if zeros == 16 and i < final:
                    w.put(0xF0, 8)
                    for b in corrections:
                        w.put(b, 1)
                    zeros, corrections = 0, []
            else:
                w.put(zeros << 4 | 1, 8)
                w.put(block[first + i] > 0, 1)
                for b in corrections:
                    w.put(b, 1)
                zeros, corrections = 0, []
        if zeros or corrections:
            run += 1
            waiting += corrections
            if run == 32767 or len(waiting) > 900:
                flush()
    flush()
    return w.done()


def _blocks(p: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """A component's quantised coefficients from its samples, whose sides are multiples of 8."""
    h, w = p.shape[0] // 8, p.shape[1] // 8
    f = COSINE.T @ (p - 128).reshape(h, 8, w, 8).transpose(0, 2, 1, 3) @ COSINE
    f = f.reshape(h, w, 64).take(ZIGZAG, 2)
    f /= quant
    return np.rint(f, out=f).astype(np.int64)


def _padded(p: np.ndarray, h: int, w: int) -> np.ndarray:
    return p.take(np.minimum(np.arange(h), p.shape[0] - 1), 0).take(np.minimum(np.arange(w), p.shape[1] - 1), 1)


def _packed(value: np.ndarray, n: np.ndarray, count: np.ndarray, more: np.ndarray | None = None, ones: np.ndarray | None = None) -> list[bytes]:
    """The streams of numbers of n bits each, in order and so many in each, filled up with ones to whole bytes. After each number
    there may be more single bits, in order those of `ones`."""
    wide = n if more is None else n + more
    end = np.cumsum(wide)
    bits = np.diff(np.r_[0, end][np.r_[0, np.cumsum(count)]])
    size = (bits + 7) // 8
    begin = np.cumsum(size) - size
    pad = 8 * size - bits
    words = np.zeros(int(size.sum()) // 8 + 2, np.uint64)

    def put(value: np.ndarray, n: np.ndarray, at: np.ndarray) -> None:
        """Numbers at increasing places: each lies in one or two words of 64 bits."""
        value, word, left = value.astype(np.uint64), at >> 6, 64 - (at & 63) - n
        if len(word):
            first = np.r_[0, np.flatnonzero(word[1:] != word[:-1]) + 1]
            own = value << np.maximum(left, 0).astype(np.uint64)
            two = np.flatnonzero(left < 0)
            over = -left[two]
            own[two] = value[two] >> over.astype(np.uint64)
            words[word[first]] |= np.bitwise_or.reduceat(own, first)
            words[word[two] + 1] |= value[two] << (64 - over).astype(np.uint64)

    at = end - wide + np.repeat(8 * begin - (np.cumsum(bits) - bits), count)
    put(value, n, at)
    some = np.flatnonzero(pad)  # with no bits there is no place either
    put((1 << pad[some]) - 1, pad[some], 8 * begin[some] + bits[some])
    raw = words.astype(">u8").tobytes()
    if more is not None and len(ones):
        single = np.zeros(8 * len(raw), np.uint8)
        single[np.repeat(at + n - np.cumsum(more) + more, more) + np.arange(len(ones))] = ones
        raw = (np.frombuffer(raw, np.uint8) | np.packbits(single)).tobytes()
    return [raw[i : i + k].replace(b"\xff", b"\xff\x00") for i, k in zip(begin.tolist(), size.tolist())]


#: Of small numbers their bits; ZRL[q]: q times the code for 16 zeros.
LENGTH = np.array([k.bit_length() for k in range(1 << 16)])
ZRL = np.array([0, 0xF0, 0xF0F0, 0xF0F0F0])


def _write_ac(blocks: np.ndarray, page: np.ndarray, pages: int, spec: tuple) -> list[bytes]:
    """What _write_scan gives for each page's blocks, of all pages at once."""
    chosen, first, last, high, low = spec
    wide, some = last - first + 1, np.ascontiguousarray(blocks[:, first : last + 1], np.int16).ravel()
    own = np.abs(some) >> low
    there = np.flatnonzero(own)  # places of coefficients, of all blocks in a row
    fresh = own[there] == 1 if high else None
    new = there[fresh] if high else there
    row = new // wide
    k = new - row * wide
    ahead = np.diff(row, prepend=-1) == 0
    before = np.where(ahead, np.r_[0, k[:-1]][: len(k)], -1)
    final = np.full(len(blocks), -1)
    final[row] = k
    # a run of blocks that end early begins where one has something new, or the one before ends late or is another page's
    early = final < wide - 1
    begins = early & ((final >= 0) | np.r_[True, (page[1:] != page[:-1]) | ~early[:-1]])
    at = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    run = np.bincount(group[early], minlength=len(at)).astype(np.int64)
    size = LENGTH[np.minimum(run, 65535)] - 1
    values, lengths, keys, hard = [size << 4 + size | run - (1 << size)], [8 + size], [2 * (64 * at + 63)], page[at[run >= 32767]].tolist()
    sign = some[new] > 0
    if not high:
        zeros, v = k - before - 1, own[new].astype(np.int64)
        n = LENGTH[v]
        values.append(ZRL[zeros >> 4] << 8 + n | ((zeros & 15) << 4 | n) << n | np.where(sign, v, v ^ (1 << n) - 1))
        lengths.append(8 * (zeros >> 4) + 8 + n)
        keys.append(2 * (64 * row + k))
    else:
        # zeros before each new one, and before what came before it
        passed = new - np.flatnonzero(fresh)
        since = np.where(ahead, np.r_[0, passed[:-1]][: len(passed)], row * wide - np.searchsorted(there, row * wide)) if len(row) else passed
        zeros = passed - since
        values.append(((zeros & 15) << 4 | 1) << 1 | sign)
        lengths.append(np.full(len(row), 9))
        keys.append(2 * (64 * row + k))
        # each sixteenth zero since the last new one, before the final one
        n = zeros >> 4
        far = np.repeat(since + 16 - 16 * (np.cumsum(n) - n), n) + 16 * np.arange(n.sum()) - 1
        far = np.flatnonzero(own == 0)[far] if len(far) else far
        r = far // wide
        values.append(np.full(len(r), 0xF0))
        lengths.append(np.full(len(r), 8))
        keys.append(2 * (far + (64 - wide) * r))
        # corrections follow the next code of their block, or else its run: how many follow each, by keys
        codes = np.sort(np.r_[new, far])
        place = there[~fresh]
        ahead = np.cumsum(fresh)[~fresh] + (np.searchsorted(far, place) if len(far) else 0)
        r = place // wide
        late = np.r_[codes, 1 << 60][ahead] >= wide * (r + 1)
        follow = np.bincount(ahead[~late], minlength=len(codes))
        runs = np.bincount(group[r[late]], minlength=len(at))
        hard += page[at[runs > 900]].tolist()
        ones = own[place] & 1
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    more = None
    if high:
        # codes and runs lie between each other as in `key`
        run_ = order < len(at)
        more = np.empty(len(order), np.int64)
        more[run_], more[~run_] = runs[order[run_]], follow
    out = _packed(np.concatenate(values)[order], np.concatenate(lengths)[order], np.diff(np.searchsorted(key[order], 128 * np.searchsorted(page, np.arange(pages + 1)))), more, ones if high else None)
    for p in set(hard):  # very long runs and many corrections are cut
        out[p] = _write_scan(blocks[page == p].tolist(), spec)
    return out


def _write_dc(values: list[np.ndarray], high: int, low: int) -> list[bytes]:
    """DC scans of pages: of each an array of MCUs by blocks, luma first, and the last two of chroma."""
    if high:
        flat = np.concatenate([v.ravel() for v in values]) >> low & 1
        return _packed(flat, np.ones(len(flat), np.int64), np.array([v.size for v in values]))
    steps = []
    for v in values:
        v = v >> low
        luma = v[:, :-2]
        steps.append(np.concatenate([np.diff(luma.ravel(), prepend=0).reshape(luma.shape), np.diff(v[:, -2:], axis=0, prepend=0)], 1).ravel())
    d = np.concatenate(steps)
    n = LENGTH[np.abs(d)]
    return _packed(n << n | np.where(d > 0, d, d + (1 << n) - 1), 4 + n, np.array([len(x) for x in steps]))


def encode(rgb: np.ndarray, quality: int = 75, halved: bool = True) -> tuple[bytes, list[np.ndarray]]:
    """(a progressive JPEG of an RGB image, the quantised coefficients in it); chroma is of half size if `halved`."""
    return encode_all([rgb], quality, halved)[0]


def encode_all(images: list[np.ndarray], quality: int = 75, halved: bool = True) -> list[tuple[bytes, list[np.ndarray]]]:
    """encode() of several images, whose scans are written at once."""
    quant = np.clip((BASE_QUANT * (5000 / quality if quality < 50 else 200 - 2 * quality) + 50) // 100, 1, 255).astype(np.int64)
    f = 2 if halved else 1
    found, dc, scanned = [], [], [[], [], []]
    for rgb in images:
        x = rgb.astype(float)
        y = x @ [0.299, 0.587, 0.114]
        b, r = (x[:, :, 2] - y) / 1.772 + 128, (x[:, :, 0] - y) / 1.402 + 128
        my, mx = -(-y.shape[0] // (8 * f)), -(-y.shape[1] // (8 * f))
        planes = [_padded(p, 8 * f * my, 8 * f * mx) for p in (y, b, r)]
        if halved:
            planes[1:] = [(p[::2, ::2] + p[::2, 1::2] + p[1::2, ::2] + p[1::2, 1::2]) / 4 for p in planes[1:]]
        quantised = [_blocks(p, quant).reshape(-1, 64) for p in planes]
        luma = quantised[0].reshape(my, f, mx, f, 64)
        dc.append(np.concatenate([luma[..., 0].transpose(0, 2, 1, 3).reshape(my * mx, f * f), quantised[1][:, :1], quantised[2][:, :1]], 1))
        own_y, own_x = -(-y.shape[0] // 8), -(-y.shape[1] // 8)  # a scan of luma alone leaves out blocks that only fill up
        for k, q in enumerate((quantised[0].reshape(f * my, f * mx, 64)[:own_y, :own_x].reshape(-1, 64), *quantised[1:])):
            scanned[k].append(q)
        found.append([q.reshape(f * my if k == 0 else my, -1, 64) for k, q in enumerate(quantised)])
    numbers = np.arange(len(images))
    blocks, page = [np.concatenate(q) for q in scanned], [np.repeat(numbers, [len(x) for x in q]) for q in scanned]
    written = [_write_dc(dc, spec[3], spec[4]) if spec[1] == 0 else _write_ac(blocks[spec[0][0]], page[spec[0][0]], len(images), spec) for spec in SCANS]
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    tables = seg(0xC4, b"\0" + DC_COUNTS + bytes(range(12)) + b"\x10" + COUNTS + SYMBOLS)
    heads = [seg(0xDA, bytes([len(spec[0])]) + b"".join(bytes([c + 1, 0]) for c in spec[0]) + bytes([spec[1], spec[2], spec[3] << 4 | spec[4]])) for spec in SCANS]
    out = []
    for i, rgb in enumerate(images):
        frame = seg(0xC2, b"\x08" + rgb.shape[0].to_bytes(2, "big") + rgb.shape[1].to_bytes(2, "big") + bytes([3, 1, 0x11 * f, 0, 2, 0x11, 0, 3, 0x11, 0]))
        scans = b"".join(h + w[i] for h, w in zip(heads, written))
        out.append((b"\xff\xd8" + seg(0xDB, b"\0" + quant.astype(np.uint8).tobytes()) + frame + tables + scans + b"\xff\xd9", found[i]))
    return out


def picture(url: str, html: str) -> np.ndarray:
    """A picture of a page: a pixel for every byte of its html, row by row, as bright as the byte, in about as many rows as
    columns and 8 at least; tinted by its address. What the last row lacks is black."""
    raw = np.frombuffer(html.encode("utf-8", "surrogatepass"), np.uint8)
    w = max(8, math.isqrt(max(len(raw), 1) - 1) + 1)
    h = max(8, -(-len(raw) // w))
    shade = np.zeros(h * w)
    shade[: len(raw)] = raw
    tint = np.frombuffer(hashlib.sha256(url.encode("utf-8", "surrogatepass")).digest()[:6], np.uint8) / 255 - 0.5
    shade, x, y, out = shade.reshape(h, w), np.linspace(0, 1, w), np.linspace(0, 1, h)[:, None], np.empty((h, w, 3), np.uint8)
    for k in range(3):
        p = x * tint[k] + y * tint[3 + k]
        p *= 40
        p += shade
        out[:, :, k] = p.clip(0, 255, out=p)
    return out


# --- tables ------------------------------------------------------------------------------------------------------------


def _keep_memory() -> None:
    """After a large array is freed, the allocator keeps memory of that size instead of giving it back after every step."""
    np.empty((1 << 25) - (1 << 16), np.uint8)


def _written(quality: int):
    """Of batches (page_id, url, html) those of render()."""

    def run(batches):
        _keep_memory()
        for batch in batches:
            made, held, size = [], [], 0
            for u, h in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                held.append(picture(u or "", h or ""))
                size += held[-1].size
                if size > TOGETHER:
                    made += [data for data, _ in encode_all(held, quality)]
                    held, size = [], 0
            if held:
                made += [data for data, _ in encode_all(held, quality)]
            yield pa.record_batch([batch["page_id"], pa.array(made, pa.binary())], ["page_id", "image"])

    return run


def _read(key: str):
    """Of batches (a key, image) those of tensors()."""

    def run(batches):
        _keep_memory()
        for batch in batches:
            files = batch["image"].to_pylist()
            ends = np.cumsum([len(data or b"") for data in files]) // (4 * AT_ONCE)
            for begin, n in zip(*np.unique(ends, return_index=True, return_counts=True)[1:]):
                some = files[begin : begin + n]
                read = iter(decode_all([data for data in some if data is not None]))
                found = [None if data is None else next(read) for data in some]
                h, w, rgb, error = zip(*((None, None, None, x and (str(x) or "corrupt")) if x is None or isinstance(x, Corrupt) else (*x.shape[:2], x.tobytes(), None) for x in found))
                yield pa.record_batch([batch[0][begin : begin + n], pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(rgb, pa.binary()), pa.array(error, pa.string())], [key, "height", "width", "rgb", "error"])

    return run


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def render(pages: DataFrame, quality: int = 75) -> DataFrame:
    """(page_id, image): for each row of pages (page_id, url, html) a progressive JPEG of picture(); null url and html count as
    empty."""
    return _pages(pages).mapInArrow(_written(quality), "page_id bigint, image binary")


def tensors(media: DataFrame, key: str = "page_id", image: str = "image") -> DataFrame:
    """(key, height, width, rgb, error) for every row of media: rgb is height x width x 3 bytes, row by row.

    A null image gives nulls; one that can't be read gives nulls and says why in error. Repeated rows and null keys give a row
    each, an empty table an empty one; other columns aren't read. A narrow pass: no shuffle.
    """
    some = media.select(F.col(key).cast("bigint").alias("key"), F.col(image).cast("binary").alias("image"))
    return some.mapInArrow(_read(key), f"{key} bigint, height int, width int, rgb binary, error string")


def page_tensors(pages: DataFrame, quality: int = 75) -> DataFrame:
    """The tensors of the pictures of all pages: each is written as a progressive JPEG and read again, in the same worker."""
    write, read = _written(quality), _read("page_id")
    return _pages(pages).mapInArrow(lambda batches: read(write(batches)), "page_id bigint, height int, width int, rgb binary, error string")
