"""Progressive JPEG in numpy: coefficient arrays from scans, pixels from coefficients, and a lossless payload writer.

`coefficients` reads any progressive Huffman-coded file scan by scan. `pixels` dequantises, applies the inverse
transform, upsamples chroma and converts to RGB. `write` stores bytes as coefficients, the format's unit, so that
they come back exactly; `read` is its inverse for many files at once, and leaves other files to `coefficients`.

How bytes become coefficients: a block has 64 of each. The first byte of a block is its DC value (0..255). The other
bytes b are AC values of size 8: b itself from 128 on, b - 255 below, which are just the 256 values with eight
magnitude bits. AC values are sent without their last bit in spectral bands, the last bit in a refinement scan; DC
values bit by bit in nine scans. Codes of one bit suffice, as each scan needs one symbol only.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: natural positions of coefficients in zigzag order.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_DATA_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
#: Files of the writer are one minimum coded unit wide: six blocks, four of luma in a square and one of either chroma.
UNIT = 6
MOST_UNITS = 65535 // 16
_DC, _AC, _REFINE = 0x00, 0x10, 0x11


@dataclass
class Component:
    """One colour component: sampling factors, quantisation table and coefficients (rows, columns, 64 in zigzag order)."""

    h: int
    v: int
    table: int
    wide: int = 0
    high: int = 0
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Frame:
    """A decoded file before the inverse transform."""

    height: int
    width: int
    components: dict[int, Component]
    tables: dict[int, np.ndarray]
    comments: list[bytes]


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        bit = self.bits[self.at] if self.at < len(self.bits) else 1
        self.at += 1
        return bit

    def some(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = 2 * value + self.one()
        return value

    def signed(self, n: int) -> int:
        value = self.some(n)
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = 2 * code + self.one()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code *= 2
    return out


def _first_ac(bits: _Bits, block: np.ndarray, codes: dict, low: int, high: int, shift: int, rest: int) -> int:
    """A block's band in a first scan. rest: blocks that still end at once; returns what is left of it."""
    if rest:
        return rest - 1
    k = low
    while k <= high:
        run, size = divmod(bits.symbol(codes), 16)
        if size:
            k += run
            block[k] = bits.signed(size) * (1 << shift)
            k += 1
        elif run == 15:
            k += 16
        else:
            return (1 << run) + bits.some(run) - 1
    return 0


def _refine_ac(bits: _Bits, block: np.ndarray, codes: dict, low: int, high: int, shift: int, rest: int) -> int:
    """A block's band in a refinement scan: a bit for each value known as non-zero, and new ones of magnitude 1."""
    step, k = 1 << shift, low

    def correct(k: int) -> None:
        if bits.one():
            block[k] += step if block[k] > 0 else -step

    if not rest:
        while k <= high:
            run, size = divmod(bits.symbol(codes), 16)
            new = 0
            if size:
                new = step if bits.one() else -step
            elif run < 15:
                rest = (1 << run) + bits.some(run)
                break
            while k <= high:
                if block[k]:
                    correct(k)
                elif run == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
    if rest:
        for j in range(k, high + 1):
            if block[j]:
                correct(j)
        return rest - 1
    return 0


def _scan(frame: Frame, chosen: list[tuple[Component, dict, dict]], low: int, high: int, before: int, shift: int, data: bytes, restart: int) -> None:
    """Adds one scan to the coefficients of its components."""
    most_h, most_v = max(c.h for c in frame.components.values()), max(c.v for c in frame.components.values())
    if len(chosen) == 1:
        c = chosen[0][0]
        units = [[(0, y, x)] for y in range(c.high) for x in range(c.wide)]
    else:
        across, down = -(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v))
        units = [[(i, y * c.v + v, x * c.h + h) for i, (c, _, _) in enumerate(chosen) for v in range(c.v) for h in range(c.h)] for y in range(down) for x in range(across)]
    parts = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    for p, part in enumerate(parts):
        bits, last, rest = _Bits(part.replace(b"\xff\x00", b"\xff")), [0] * len(chosen), 0
        for unit in units[p * restart : (p + 1) * restart] if restart else units:
            for i, y, x in unit:
                c, dc, ac = chosen[i]
                block = c.values[y, x]
                if low == 0 and before == 0:
                    last[i] += bits.signed(bits.symbol(dc))
                    block[0] = last[i] * (1 << shift)
                elif low == 0:
                    block[0] |= bits.one() << shift
                else:
                    rest = (_first_ac if before == 0 else _refine_ac)(bits, block, ac, low, high, shift, rest)


def coefficients(data: bytes) -> Frame:
    """Reads a progressive file: all scans, accumulated in coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, restart = 2, 0
    frame, codes = Frame(0, 0, {}, {}, []), {}
    while at < len(data):
        kind = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("no marker")
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            frame.comments.append(body)
        elif kind == 0xDB:
            while body:
                wide, number = divmod(body[0], 16)
                frame.tables[number] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            frame.height, frame.width = struct.unpack(">HH", body[1:5])
            for i in range(body[5]):
                number, factors, table = body[6 + 3 * i : 9 + 3 * i]
                frame.components[number] = Component(factors >> 4, factors & 15, table)
            most_h, most_v = max(c.h for c in frame.components.values()), max(c.v for c in frame.components.values())
            for c in frame.components.values():
                c.wide, c.high = -(-(-(-frame.width * c.h // most_h)) // 8), -(-(-(-frame.height * c.v // most_v)) // 8)
                c.values = np.zeros((-(-frame.height // (8 * most_v)) * c.v, -(-frame.width // (8 * most_h)) * c.h, 64), np.int32)
        elif kind == 0xDA:
            n = body[0]
            chosen = []
            for i in range(n):
                number, pick = body[1 + 2 * i], body[2 + 2 * i]
                chosen.append((frame.components[number], codes.get(pick >> 4, {}), codes.get(16 + (pick & 15), {})))
            low, high, both = body[1 + 2 * n : 4 + 2 * n]
            found = _DATA_END.search(data, at)
            to = found.start() if found else len(data)
            _scan(frame, chosen, low, high, both >> 4, both & 15, data[at:to], restart)
            at = to
        elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("only progressive Huffman-coded files are read")
    return frame


def _kernel() -> np.ndarray:
    """The inverse transform of 64 zigzag coefficients as one matrix of integers, scaled by 2**20: sums are exact in any order."""
    x = np.arange(8)
    base = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0) / 2  # sample, frequency
    both = np.einsum("yv,xu->vuyx", base, base).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << 20))


KERNEL = _kernel()


def samples(blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """8-bit samples (n, 8, 8) of zigzag coefficient blocks (n, 64)."""
    flat = (blocks.astype(np.float64) * table) @ KERNEL
    return np.clip(np.floor(flat / (1 << 20) + 0.5) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-resolution RGB from luma and upsampled chroma, in 16-bit fixed point."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    red = y + ((91881 * cr + half) >> 16)
    green = y - ((22554 * cb + 46802 * cr + half) >> 16)
    blue = y + ((116130 * cb + half) >> 16)
    return np.clip(np.stack([red, green, blue], -1), 0, 255).astype(np.uint8)


def pixels(frame: Frame) -> np.ndarray:
    """(height, width, 3) RGB of a frame with one or three components; chroma is upsampled by repetition."""
    planes = []
    most_h, most_v = max(c.h for c in frame.components.values()), max(c.v for c in frame.components.values())
    for c in frame.components.values():
        rows, columns = c.values.shape[:2]
        plane = samples(c.values.reshape(-1, 64), frame.tables[c.table]).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
        planes.append(plane.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    return to_rgb(*planes[:3])


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def _one_code(number: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([number, 1, *[0] * 15, symbol]))


def _start(parts: list[tuple[int, int]], low: int, high: int, before: int, shift: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for p in parts for x in p), low, high, before * 16 + shift]))


_ALL = [(1, 0), (2, 0), (3, 0)]
#: The writer's scans: what is sent and its header. DC bits come in order of blocks, AC values by component.
_SCANS = [("dc", 8, _start(_ALL, 0, 0, 0, 8))]
_SCANS += [("dc", k, _start(_ALL, 0, 0, k + 1, k)) for k in range(7, -1, -1)]
_SCANS += [("band", (c, low, high), _start([(c, 0)], low, high, 0, 1)) for c, low, high in ((1, 1, 7), (1, 8, 63), (2, 1, 63), (3, 1, 63))]
_SCANS += [("last", c, _start([(c, 1)], 1, 63, 1, 0)) for c in (1, 2, 3)]
_TABLES = _segment(0xDB, bytes([0, *[1] * 64])) + _one_code(_DC, 0) + _one_code(_AC, 0x07) + _one_code(_REFINE, 0x00)
_SLOTS = {1: slice(0, 4), 2: slice(4, 5), 3: slice(5, 6)}


def _head(units: int, payload: int) -> bytes:
    frame = _segment(0xC2, bytes([8]) + struct.pack(">HH", 16 * units, 16) + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return b"\xff\xd8" + _segment(0xFE, b"payload " + struct.pack(">Q", payload)) + _TABLES + frame


def _units(payload: int) -> int:
    return -(-payload // (64 * UNIT))


def write(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload of a positive multiple of 64 bytes; one too long for an image becomes several, one after another."""
    most = MOST_UNITS * UNIT * 64
    chunks = [p[a : a + most] for p in payloads for a in range(0, len(p), most)]
    units = np.array([_units(len(c)) for c in chunks], np.int64)
    flat = np.frombuffer(b"".join(c + bytes(u * UNIT * 64 - len(c)) for c, u in zip(chunks, units.tolist(), strict=True)), np.uint8).reshape(-1, UNIT, 64)
    bounds = np.concatenate([[0], np.cumsum(units)])
    odd = (flat ^ (flat < 128)) & 1  # last magnitude bit
    sent = []
    for kind, what, _ in _SCANS:
        if kind == "dc":
            sent.append((flat[:, :, 0] >> what & 1) if what < 8 else np.zeros(flat.shape[:2], np.uint8))
        elif kind == "band":
            c, low, high = what
            sent.append((flat[:, _SLOTS[c], low : high + 1] >> 1).reshape(len(flat), -1))
        else:
            bits = odd[:, _SLOTS[what], :].copy()
            bits[:, :, 0] = 0  # the code for a block without new values
            sent.append(np.packbits(bits, axis=-1).reshape(len(flat), -1))
    files = []
    for i, chunk in enumerate(chunks):
        a, b = bounds[i], bounds[i + 1]
        out = [_head(int(units[i]), len(chunk))]
        for (kind, _, start), data in zip(_SCANS, sent, strict=True):
            out.append(start)
            if kind == "dc":
                bits = data[a:b].ravel()
                bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
                out.append(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
            elif kind == "band":
                out.append(data[a:b].tobytes())  # below 128: no byte to escape
            else:
                out.append(data[a:b].tobytes().replace(b"\xff", b"\xff\x00"))
        out.append(b"\xff\xd9")
        files.append(b"".join(out))
    merged, at = [], 0
    for p in payloads:
        n = -(-len(p) // most)
        merged.append(files[at] if n == 1 else b"".join(files[at : at + n]))
        at += n
    return merged


def _own_scans(data: bytes, at: int) -> tuple[int, int, list[bytes], int] | None:
    """If the file at this place is the writer's: its units, its payload's size, its scans' data, and where it ends."""
    if data[at + 2 : at + 6] != b"\xff\xfe\x00\x12" or data[at + 6 : at + 14] != b"payload ":
        return None
    size = struct.unpack(">Q", data[at + 14 : at + 22])[0]
    units = _units(size)
    head = _head(units, size)
    if not 0 < units <= MOST_UNITS or data[at : at + len(head)] != head:
        return None
    at += len(head)
    out = []
    for kind, what, start in _SCANS:
        if data[at : at + len(start)] != start:
            return None
        at += len(start)
        if kind == "band":
            c, low, high = what
            to = at + units * (4 if c == 1 else 1) * (high - low + 1)
            out.append(data[at:to])
        else:
            to = _DATA_END.search(data, at).start()  # type: ignore[union-attr]
            out.append(data[at:to].replace(b"\xff\x00", b"\xff"))
        at = to
    return (units, size, out, at + 2) if data[at : at + 2] == b"\xff\xd9" else None


def read(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and pixels (height, 16, 3) of the writer's files, from their coefficients."""
    owner, units, sizes, scans = [], [], [], []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            got = _own_scans(data, at)
            if got is None:
                raise ValueError("not a file of this writer; coefficients() reads others")
            owner.append(i)
            units.append(got[0])
            sizes.append(got[1])
            scans.append(got[2])
            at = got[3]
    total = int(sum(units))
    values = np.zeros((total, UNIT, 64), np.int16)
    bounds = np.concatenate([[0], np.cumsum(units)]).astype(np.int64)
    for k, (kind, what, _) in enumerate(_SCANS):
        if kind == "dc":
            if what == 8:
                continue  # all differences are zero
            bits = np.concatenate([np.unpackbits(np.frombuffer(s[k], np.uint8))[: UNIT * u] for s, u in zip(scans, units, strict=True)])
            values[:, :, 0] |= bits.reshape(total, UNIT).astype(np.int16) << what
            continue
        sent = np.frombuffer(b"".join(s[k] for s in scans), np.uint8)
        c = what[0] if kind == "band" else what
        mine = values[:, _SLOTS[c], :]
        if kind == "band":
            sevens = sent.reshape(total, -1, what[2] - what[1] + 1).astype(np.int16)
            mine[:, :, what[1] : what[2] + 1] = np.where(sevens >= 64, sevens, sevens - 127) * 2
        else:
            bits = np.unpackbits(sent).reshape(total, -1, 64)[:, :, 1:].astype(np.int16)
            mine[:, :, 1:] += np.where(mine[:, :, 1:] > 0, bits, -bits)
    raw = np.where(values < 0, values + 255, values).astype(np.uint8)
    table = np.ones(64)
    planes = {c: samples(values[:, s, :].reshape(-1, 64), table).reshape(total, -1, 8, 8) for c, s in _SLOTS.items()}
    luma = planes[1].reshape(total, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(total * 16, 16)
    chroma = [planes[c].reshape(total * 8, 8).repeat(2, 0).repeat(2, 1) for c in (2, 3)]
    rgb = to_rgb(luma, *chroma)
    payloads, images = [b""] * len(files), [[] for _ in files]  # type: ignore[var-annotated]
    for i, n, a, b in zip(owner, sizes, bounds[:-1], bounds[1:], strict=True):
        payloads[i] += raw[a:b].tobytes()[:n]
        images[i].append(rgb[16 * a : 16 * b])
    return payloads, [x[0] if len(x) == 1 else np.concatenate(x) for x in images]
