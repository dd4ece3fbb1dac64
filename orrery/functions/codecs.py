"""Pixels out of file formats: PNG, BMP, the first frame of a GIF, the first page of a TIFF, and JPEG. Others are injected.

Pixels are RGB as the file stores them, before any orientation. Transparency is dropped, as the encoder takes no alpha; 16 bits
a channel give their upper 8, fewer than 8 are spread over the whole range.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from orrery.contracts import ImageError
from orrery.functions.images import Tiff, check_size
from orrery.functions.jpeg import decode_jpeg

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            break
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IEND":
            return
    raise ImageError("the image is cut short")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Lines (filter byte first) to plain bytes; step: bytes of a pixel, at least one."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1 + step), np.int32)  # a line above and a pixel before of zeros
    for y, line in enumerate(rows, 1):
        kind, raw, above = int(line[0]), line[1:].astype(np.int32), out[y - 1]
        if kind == 0:
            out[y, step:] = raw
        elif kind == 2:
            out[y, step:] = (raw + above[step:]) & 255
        elif kind == 1:  # sums along the line, each channel for itself
            for c in range(step):
                out[y, step + c :: step] = np.cumsum(raw[c::step]) & 255
        elif kind in (3, 4):
            own, up, before = out[y].tolist(), above.tolist(), raw.tolist()
            for x, value in enumerate(before, step):
                a, b, c = own[x - step], up[x], up[x - step]
                if kind == 3:
                    own[x] = (value + (a + b) // 2) & 255
                else:
                    guess = a + b - c
                    own[x] = (value + min((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]) & 255
            out[y] = own
        else:
            raise ImageError("a line has an unknown filter")
    return out[1:, step:].astype(np.uint8)


def _samples(lines: np.ndarray, width: int, channels: int, depth: int, scaled: bool) -> np.ndarray:
    """Lines of packed samples to height x width x channels bytes."""
    if depth == 16:
        return lines[:, ::2].reshape(len(lines), width, channels)
    if depth == 8:
        return lines.reshape(len(lines), width, channels)
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    values = (bits * (1 << np.arange(depth)[::-1])).sum(2)[:, :width, None]
    return (values * (255 // ((1 << depth) - 1)) if scaled else values).astype(np.uint8)


# First column and row, and strides, of the seven passes of interlaced files.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def decode_png(data: bytes) -> np.ndarray:
    parts, palette, head = [], None, None
    for kind, body in _chunks(data):
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or head[3] not in CHANNELS or head[2] not in DEPTHS[head[3]] or head[4] or head[5] or head[6] > 1 or (head[3] == 3 and palette is None):
        raise ImageError("the image's header is not valid")
    width, height, depth, colour, _, _, laced = head
    check_size(width, height, 3 * width * height)
    channels = CHANNELS[colour]
    step, tool = max(1, channels * depth // 8), zlib.decompressobj()
    passes = [p for p in PASSES if p[0] < width and p[1] < height] if laced else [(0, 0, 1, 1)]
    shapes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    sizes = [(1 + -(-w * channels * depth // 8)) * h for w, h in shapes]
    try:
        raw = np.frombuffer(tool.decompress(b"".join(parts), sum(sizes)), np.uint8)  # never more than the header says
    except zlib.error as e:
        raise ImageError(f"the image's data is broken: {e}") from e
    if len(raw) < sum(sizes):
        raise ImageError("the image is cut short")
    out, at = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, dx, dy), (w, h), size in zip(passes, shapes, sizes):
        lines = _unfilter(raw[at : at + size].reshape(h, -1), step)
        out[y::dy, x::dx] = _samples(lines, w, channels, depth, colour != 3)
        at += size
    if colour == 3:
        if out.max(initial=0) >= len(palette):
            raise ImageError("a pixel is outside the palette")
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, 2) if channels < 3 else out[:, :, :3]


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed, 24 or 32 bits, bottom-up or top-down."""
    if len(data) < 54:
        raise ImageError("the image is cut short")
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (24, 32) or packed or width < 0:
        raise ImageError("only uncompressed bitmaps of 24 or 32 bits are read")
    check_size(width, abs(height), 3 * width * abs(height))
    line = -(-width * bits // 32) * 4
    if start + line * abs(height) > len(data):
        raise ImageError("the image is cut short")
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(pixels if height < 0 else pixels[::-1])


def unlzw(data: bytes, bits: int, most: int, high_first: bool) -> bytes:
    """At most ``most`` bytes of Lempel-Ziv-Welch codes over symbols of ``bits`` bits. high_first: as TIFF packs them, whose
    codes also grow one code earlier."""
    clear, size, held, n, out, made = 1 << bits, bits + 1, 0, 0, [], 0
    table, before = [bytes([k]) for k in range(clear)] + [b"", b""], None
    for byte in data:
        if high_first:
            held = held << 8 | byte
        else:
            held |= byte << n
        n += 8
        while n >= size:
            if high_first:
                code = held >> n - size
                held &= (1 << n - size) - 1
            else:
                code = held & (1 << size) - 1
                held >>= size
            n -= size
            if code == clear:
                del table[clear + 2 :]
                size, before = bits + 1, None
                continue
            if code == clear + 1:
                return b"".join(out)[:most]
            if code > len(table) or (code == len(table) and before is None):
                raise ImageError("the image's data is broken")
            entry = table[code] if code < len(table) else before + before[:1]
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            out.append(entry)
            made += len(entry)
            if made >= most:
                return b"".join(out)[:most]
            before = entry
            if len(table) + high_first >= 1 << size and size < 12:
                size += 1
    return b"".join(out)


def decode_gif(data: bytes) -> np.ndarray:
    """The first frame on a black screen; a transparent pixel keeps its colour in the palette."""
    if len(data) < 13:
        raise ImageError("the image is cut short")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    check_size(width, height, 3 * width * height)

    def colours(at: int, flags: int) -> tuple[np.ndarray | None, int]:
        n = 2 << (flags & 7) if flags & 128 else 0
        return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3) if n else None, at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    try:
        palette, at = colours(13, flags)
        while data[at] == 0x21:
            at = blocks(at + 2)[1]
        if data[at] != 0x2C:
            raise ImageError("the image is cut short")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        if left + w > width or top + h > height:
            raise ImageError("the frame does not fit the screen")
        local, at = colours(at + 10, own)
        palette, bits = palette if local is None else local, data[at]
        if palette is None or not 1 <= bits <= 8:
            raise ImageError("the image's header is not valid")
        pixels = np.frombuffer(unlzw(blocks(at + 1)[0], bits, w * h, False), np.uint8)
    except (IndexError, ValueError, struct.error) as e:
        raise ImageError("the image is cut short") from e
    if len(pixels) < w * h:
        raise ImageError("the image is cut short")
    if pixels.max(initial=0) >= len(palette):
        raise ImageError("a pixel is outside the palette")
    rows = np.concatenate([np.arange(a, h, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))]) if own & 64 else np.arange(h)
    out = np.zeros((height, width, 3), np.uint8)
    out[top + rows, left : left + w] = palette[pixels.reshape(h, w)]
    return out


def _unpack_runs(data: bytes) -> bytes:
    """Runs and stretches, as PackBits has them."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        out.append(data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
        at += 2 + n if n < 128 else 2 if n > 128 else 1
    return b"".join(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """The first page: grey, palette, RGB or CMYK in strips or tiles; plain, LZW, deflate or PackBits."""
    file = Tiff(data)
    tags = {}
    for tag, kind, count, value, scalar in file.directory(file.root)[0]:
        form = {1: "B", 3: "H", 4: "I"}.get(kind)
        if form is None:
            continue
        if count > len(data):
            raise ImageError("an offset is out of bounds")
        size = {"B": 1, "H": 2, "I": 4}[form] * count
        packed = struct.pack(file.order + "I", value)
        tags[tag] = list(struct.unpack(file.order + form * count, packed[:size]) if size <= 4 else file._unpack(form * count, value))
    one = lambda tag, default: (tags.get(tag) or [default])[0]
    width, height, packing, kind, channels = one(256, 0), one(257, 0), one(259, 1), one(262, 1), one(277, 1)
    depth, apart, guess = one(258, 1), one(284, 1) == 2, one(317, 1)
    check_size(width, height, 3 * width * height)
    least = {0: 1, 1: 1, 2: 3, 3: 1, 5: 4}.get(kind)
    if least is None or not least <= channels <= 8 or depth not in (1, 2, 4, 8, 16) or (depth < 8 and channels > 1) or any(d != depth for d in tags.get(258, [])) or guess not in (1, 2) or (guess == 2 and depth < 8):
        raise ImageError("this kind of TIFF is not read")
    tiled = 322 in tags
    w, h = (one(322, 0), one(323, 0)) if tiled else (width, min(height, one(278, height)))
    starts, sizes = tags.get(324 if tiled else 273, []), tags.get(325 if tiled else 279, [])
    if not (0 < w <= width + 65535 and 0 < h <= height + 65535):
        raise ImageError("the image's header is not valid")
    check_size(w, h, 3 * w * h)
    across, down, each = -(-width // w), -(-height // h), 1 if apart else channels
    if min(len(starts), len(sizes)) < across * down * (channels if apart else 1):
        raise ImageError("the image is cut short")
    out = np.zeros((height, width, channels), np.uint8)
    for k in range(across * down * (channels if apart else 1)):
        plane, (y, x) = k // (across * down), divmod(k % (across * down), across)
        rows = h if tiled else min(h, height - y * h)
        line = -(-w * each * depth // 8)
        part, most = data[starts[k] : starts[k] + sizes[k]], line * rows
        try:
            part = part if packing == 1 else unlzw(part, 8, most, True) if packing == 5 else zlib.decompressobj().decompress(part, most) if packing in (8, 32946) else _unpack_runs(part) if packing == 32773 else None
        except zlib.error as e:
            raise ImageError(f"the image's data is broken: {e}") from e
        if part is None:
            raise ImageError("this kind of TIFF is not read")
        if len(part) < most:
            raise ImageError("the image is cut short")
        lines = np.frombuffer(part, np.uint8, most).reshape(rows, line)
        if depth == 16:
            wide = lines.view(file.order + "u2").reshape(rows, w, each)
            block = ((np.cumsum(wide, 1, dtype=np.uint16) if guess == 2 else wide) >> 8).astype(np.uint8)
        else:
            block = _samples(lines, w, each, depth, kind != 3)
            block = np.cumsum(block, 1, dtype=np.uint8) if guess == 2 else block
        y, x = y * h, x * w
        out[y : y + h, x : x + w, plane : plane + each] = block[: height - y, : width - x]
    if kind == 3:
        table = np.array(tags.get(320, []), np.uint16)
        if len(table) != 3 << depth:
            raise ImageError("the image's header is not valid")
        return (table.reshape(3, -1).T >> 8).astype(np.uint8)[out[:, :, 0]]
    if kind == 5:
        light = 255 - out[:, :, :4].astype(np.float32)
        return np.rint(light[:, :, :3] * light[:, :, 3:] / 255).astype(np.uint8)
    return out[:, :, :3] if kind == 2 else np.repeat(255 - out[:, :, :1] if kind == 0 else out[:, :, :1], 3, 2)


def decode(data: bytes) -> np.ndarray:
    """RGB pixels by what the bytes say they are, whatever the file's name."""
    if data[:8] == SIGNATURE:
        return decode_png(data)
    if data[:2] == b"\xff\xd8":
        return decode_jpeg(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return decode_gif(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return decode_tiff(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ImageError("the format needs a decoder that is not here")
