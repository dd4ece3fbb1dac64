"""JPEG pictures: baseline, extended and progressive Huffman coding of 8 bits; grey, YCbCr, RGB, CMYK and YCCK.

Codes are read one after the other in Python, at about a million a second; all else is done on whole planes. For
millions of photographs inject a native decoder. Chroma planes of fewer samples are repeated, not smoothed; the inverse
transform is in floats, so pixels may differ by some steps from other decoders'.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

from orrery.contracts import ImageError
from orrery.functions.images import check_size

#: Row and column of the coefficients in the order of the file: along diagonals, in turns up and down.
ZIGZAG = sorted(range(64), key=lambda n: (n // 8 + n % 8, n // 8 if (n // 8 + n % 8) % 2 else n % 8))
BASIS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)
RESTART, SCAN_END = re.compile(rb"\xff+[\xd0-\xd7]"), re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
SLACK = 64 * 4 + 8  # bytes that one block may read, however broken


@dataclass
class Plane:
    name: int
    across: int
    down: int
    quant: int
    wide: int = 0  # blocks, whole units
    high: int = 0
    used_wide: int = 0  # blocks that hold pixels
    used_high: int = 0
    values: np.ndarray = field(default=None, repr=False)


def _table(counts: bytes, symbols: bytes) -> list[int]:
    """Length * 256 + symbol of the code that the next 16 bits begin with; 0 where there is none."""
    out, at = np.zeros(1 << 16, np.int32), 0
    k = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            out[at : at + (1 << (16 - length))] = length << 8 | symbol
            at += 1 << (16 - length)
        k += n
    if at > 1 << 16:
        raise ImageError("a code table is not valid")
    return out.tolist()


def _windows(part: bytes) -> memoryview:
    """The 5 bytes from each byte on, as one number."""
    raw = np.frombuffer(part.replace(b"\xff\x00", b"\xff") + b"\0" * (SLACK + 4), np.uint8).astype(np.uint64)
    out = np.zeros(len(raw) - 4, np.uint64)
    for k in range(5):
        out |= raw[k : len(raw) - 4 + k] << np.uint64(32 - 8 * k)
    return memoryview(out)


def _whole(win, p, v, at, dc, ac, before):
    """One block of a sequential scan into v[at:]: the place after it and the block's first value."""
    w = win[p >> 3] >> 8 - (p & 7) & 0xFFFFFFFF
    e = dc[w >> 16]
    n, s = e >> 8, e & 255
    if not e or s > 15:
        raise ImageError("the image's data is broken")
    p += n + s
    if s:
        x = w >> 32 - n - s & (1 << s) - 1
        before += x if x >> s - 1 else x - (1 << s) + 1
    v[at] = before
    k = 1
    while k < 64:
        w = win[p >> 3] >> 8 - (p & 7) & 0xFFFFFFFF
        e = ac[w >> 16]
        if not e:
            raise ImageError("the image's data is broken")
        n, s = e >> 8, e & 15
        k += e >> 4 & 15
        p += n + s
        if not s:
            if e & 255 != 0xF0:
                break
            k += 1
            continue
        if k > 63:
            raise ImageError("the image's data is broken")
        x = w >> 32 - n - s & (1 << s) - 1
        v[at + k] = x if x >> s - 1 else x - (1 << s) + 1
        k += 1
    return p, before


def _first(win, p, v, at, ac, low, high, shift, run):
    """Higher coefficients of a block, their upper bits; run: blocks that have none."""
    if run:
        return p, run - 1
    k = low
    while k <= high:
        w = win[p >> 3] >> 8 - (p & 7) & 0xFFFFFFFF
        e = ac[w >> 16]
        if not e:
            raise ImageError("the image's data is broken")
        n, s, r = e >> 8, e & 15, e >> 4 & 15
        if not s and r < 15:
            return p + n + r, (1 << r) + (w >> 32 - n - r & (1 << r) - 1) - 1
        k += r
        p += n + s
        if s:
            if k > high:
                raise ImageError("the image's data is broken")
            x = w >> 32 - n - s & (1 << s) - 1
            v[at + k] = (x if x >> s - 1 else x - (1 << s) + 1) << shift
        k += 1
    return p, 0


def _more(win, p, v, at, ac, low, high, shift, run):
    """One more bit of a block's higher coefficients."""
    bit = 1 << shift
    k = low
    while k <= high and not run:
        w = win[p >> 3] >> 8 - (p & 7) & 0xFFFFFFFF
        e = ac[w >> 16]
        if not e or e & 15 > 1:
            raise ImageError("the image's data is broken")
        n, s, r = e >> 8, e & 15, e >> 4 & 15
        if not s and r < 15:
            run = (1 << r) + (w >> 32 - n - r & (1 << r) - 1)
            p += n + r
            break
        p += n + s
        new = (bit if w >> 31 - n & 1 else -bit) if s else 0
        while k <= high:
            x = v[at + k]
            if x:
                if win[p >> 3] >> 39 - (p & 7) & 1 and not abs(x) & bit:
                    v[at + k] = x + bit if x > 0 else x - bit
                p += 1
            elif r:
                r -= 1
            else:
                if new:
                    v[at + k] = new
                break
            k += 1
        k += 1
    if run:
        for k in range(at + k, at + high + 1):
            x = v[k]
            if x:
                if win[p >> 3] >> 39 - (p & 7) & 1 and not abs(x) & bit:
                    v[k] = x + bit if x > 0 else x - bit
                p += 1
        run -= 1
    return p, run


def _units(planes: list[Plane], of: list[int]) -> np.ndarray:
    """Places of the blocks of each unit of a scan, units by rows."""
    if len(of) == 1:
        own = planes[of[0]]
        return (np.arange(own.used_high)[:, None] * own.wide + np.arange(own.used_wide)).reshape(-1, 1) * 64
    rows, cols = planes[of[0]].high // planes[of[0]].down, planes[of[0]].wide // planes[of[0]].across
    y, x = (a.reshape(-1, 1, 1) for a in np.mgrid[:rows, :cols])
    parts = []
    for k in of:
        own = planes[k]
        at = (y * own.down + np.arange(own.down)[:, None]) * own.wide + x * own.across + np.arange(own.across)
        parts.append(at.reshape(rows * cols, -1) * 64)
    return np.concatenate(parts, 1)


def _scan(parts: list[bytes], planes: list[Plane], of: list[int], tables, interval: int, spectrum, progressive: bool) -> None:
    units = _units(planes, of)
    slots = of if len(of) == 1 else [k for k in of for _ in range(planes[k].across * planes[k].down)]
    low, high, past, shift = spectrum
    views = {k: memoryview(planes[k].values) for k in of}
    interval = interval or len(units)
    if len(parts) < -(-len(units) // interval):
        raise ImageError("the image is cut short")
    for turn, begin in enumerate(range(0, len(units), interval)):
        win, p, run, before = _windows(parts[turn]), 0, 0, dict.fromkeys(of, 0)
        last = (len(win) - SLACK) * 8
        for unit in units[begin : begin + interval].tolist():
            for k, at in zip(slots, unit):
                v, (dc, ac) = views[k], tables[k]
                if not progressive:
                    p, before[k] = _whole(win, p, v, at, dc, ac, before[k])
                elif low:
                    p, run = (_more if past else _first)(win, p, v, at, ac, low, high, shift, run)
                elif past:
                    if win[p >> 3] >> 39 - (p & 7) & 1:
                        v[at] |= 1 << shift
                    p += 1
                else:
                    w = win[p >> 3] >> 8 - (p & 7) & 0xFFFFFFFF
                    e = dc[w >> 16]
                    n, s = e >> 8, e & 255
                    if not e or s > 15:
                        raise ImageError("the image's data is broken")
                    p += n + s
                    if s:
                        x = w >> 32 - n - s & (1 << s) - 1
                        before[k] += x if x >> s - 1 else x - (1 << s) + 1
                    v[at] = before[k] << shift
                if p > last:
                    raise ImageError("the image is cut short")


def _frame(body: bytes) -> tuple[int, int, list[Plane]]:
    depth, height, width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or n not in (1, 3, 4) or len(body) < 6 + 3 * n:
        raise ImageError("the image's header is not valid")
    check_size(width, height, 3 * width * height)
    planes = [Plane(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    if not all(1 <= x <= 4 for p in planes for x in (p.across, p.down)):
        raise ImageError("the image's header is not valid")
    if n == 1:
        planes[0].across = planes[0].down = 1
    most_x, most_y = max(p.across for p in planes), max(p.down for p in planes)
    for p in planes:
        p.wide, p.high = -(-width // (8 * most_x)) * p.across, -(-height // (8 * most_y)) * p.down
        p.used_wide, p.used_high = -(-(-(-width * p.across // most_x)) // 8), -(-(-(-height * p.down // most_y)) // 8)
        p.values = np.zeros(p.wide * p.high * 64, np.int32)
    return width, height, planes


def _parse(data: bytes):
    """Width, height, planes with their coefficients, quantisation tables and the colour transform told, if any."""
    at, frame, quants, codes, interval, adobe, scans = 2, None, {}, {}, 0, None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ImageError("the image's data is broken")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8, 64).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            (interval,) = struct.unpack_from(">H", body)
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif kind in (0xC0, 0xC1, 0xC2) and frame is None:
            frame, progressive = _frame(body), kind == 0xC2
        elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
            raise ImageError("this kind of JPEG is not read")
        elif kind == 0xDA:
            if frame is None:
                raise ImageError("the image's header is not valid")
            names = [p.name for p in frame[2]]
            of = [names.index(body[1 + 2 * k]) for k in range(body[0])]
            low, high, bits = body[1 + 2 * body[0] :][:3]
            if not of or low > high or high > 63 or (progressive and low and len(of) > 1):
                raise ImageError("the image's header is not valid")
            tables = {k: (codes.get(body[2 + 2 * n] >> 4, [0] * 65536), codes.get(16 + (body[2 + 2 * n] & 15), [0] * 65536)) for n, k in enumerate(of)}
            end = SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            _scan(RESTART.split(data[at:stop]), frame[2], of, tables, interval, (low, high, bits >> 4, bits & 15), progressive)
            at, scans = stop, scans + 1
    if not scans:
        raise ImageError("the image is cut short")
    return *frame, quants, adobe


def parse(data: bytes):
    try:
        return _parse(data)
    except (IndexError, ValueError, KeyError, struct.error) as e:
        raise ImageError("the image's data is broken") from e


def decode_jpeg(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes."""
    width, height, planes, quants, adobe = parse(data)
    most_x, most_y = max(p.across for p in planes), max(p.down for p in planes)
    out = []
    for p in planes:
        if p.quant not in quants:
            raise ImageError("the image's header is not valid")
        blocks = np.zeros((p.wide * p.high, 64), np.float32)
        blocks[:, ZIGZAG] = p.values.reshape(-1, 64) * quants[p.quant]
        blocks = BASIS.T @ blocks.reshape(-1, 8, 8) @ BASIS
        plane = blocks.reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.high, 8 * p.wide)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        out.append(plane[np.arange(height) * p.down // most_y][:, np.arange(width) * p.across // most_x])
    if len(out) == 1:
        return np.repeat(out[0][:, :, None], 3, 2).astype(np.uint8)
    plain = adobe == 0 or (adobe is None and (len(out) == 4 or bytes(p.name for p in planes) == b"RGB"))
    if not plain:
        y, b, r = out[0], out[1] - 128, out[2] - 128
        # What each chroma plane adds to a colour.
        out[:3] = (np.clip(np.rint(c), 0, 255) for c in (y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b))
    if len(out) == 4:  # stored as what is left of the light
        key = out.pop() / 255
        out = [np.rint(c * key) for c in out]
    return np.stack(out, 2).astype(np.uint8)
