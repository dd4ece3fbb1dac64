import random
import struct
import time
import zlib

import numpy as np
import pytest

from orrery.contracts import ImageError
from orrery.functions import codecs, images, jpeg

CODES = {k: format(k, "08b") if k < 128 else format(256 + k - 128, "09b") for k in range(256)}  # 128 of 8 bits, 128 of 9
TABLE = bytes([0] * 7 + [128, 128] + [0] * 7) + bytes(range(256))


def magnitude(x):
    n = abs(x).bit_length()
    return n, format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else ""


def sequential(v, before):
    n, bits = magnitude(v[0] - before)
    out, run = CODES[n] + bits, 0
    for x in v[1:]:
        if not x:
            run += 1
            continue
        out += CODES[0xF0] * (run // 16)
        n, bits = magnitude(x)
        out, run = out + CODES[run % 16 << 4 | n] + bits, 0
    return out + CODES[0] * (run > 0)


def cut(x, shift):
    return abs(x) >> shift if x >= 0 else -(abs(x) >> shift)


def first_scan(blocks, low, high, shift):
    """Blocks without values are counted and told together."""
    out, waiting = "", 0

    def told():
        n = waiting.bit_length() - 1
        return CODES[n << 4] + (format(waiting - (1 << n), f"0{n}b") if n else "") if waiting else ""

    for v in blocks:
        own, run = "", 0
        for x in (cut(x, shift) for x in v[low : high + 1]):
            if not x:
                run += 1
                continue
            own += CODES[0xF0] * (run // 16)
            n, bits = magnitude(x)
            own, run = own + CODES[run % 16 << 4 | n] + bits, 0
        if own:
            out, waiting = out + told() + own, 0
        if run:
            waiting += 1
    return out + told()


def later_scan(blocks, low, high, shift):
    out = ""
    for v in blocks:
        own = [cut(x, shift) for x in v[low : high + 1]]
        last = max((k for k, x in enumerate(own) if abs(x) == 1), default=-1)
        run, fixes = 0, ""
        for k, x in enumerate(own):
            if not x:
                run += 1
                continue
            while run > 15 and k <= last:
                out, fixes, run = out + CODES[0xF0] + fixes, "", run - 16
            if abs(x) > 1:
                fixes += str(abs(x) & 1)
                continue
            out, fixes, run = out + CODES[run << 4 | 1] + str(int(x > 0)) + fixes, "", 0
        if run or fixes:
            out += CODES[0] + fixes
    return out


def segment(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def stuffed(bits):
    return int(bits.ljust(-(-len(bits) // 8) * 8, "1") or "1" * 8, 2).to_bytes(max(1, -(-len(bits) // 8)), "big").replace(b"\xff", b"\xff\0")


def write(width, height, values, factors, quant, progressive=False, interval=0, adobe=None, names=(1, 2, 3, 4)):
    """A JPEG of the coefficients (blocks by rows x 64 in the file's order) of each plane."""
    n, (mx, my) = len(values), (max(f[0] for f in factors), max(f[1] for f in factors))
    cols, rows = -(-width // (8 * mx)), -(-height // (8 * my))
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes(quant)) + b"".join(segment(0xC4, bytes([t]) + TABLE) for t in (0, 16))
    head += segment(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, adobe])) if adobe is not None else b""
    head += segment(0xDD, struct.pack(">H", interval)) if interval else b""
    head += segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([names[k], factors[k][0] << 4 | factors[k][1], 0]) for k in range(n)))

    def units(of):
        if len(of) == 1:
            across, down = factors[of[0]]
            wide, high = -(-(-(-width * across // mx)) // 8), -(-(-(-height * down // my)) // 8)
            return [[(of[0], values[of[0]][y * cols * across + x])] for y in range(high) for x in range(wide)]
        return [[(k, values[k][(y * factors[k][1] + j) * cols * factors[k][0] + x * factors[k][0] + i]) for k in of for j in range(factors[k][1]) for i in range(factors[k][0])] for y in range(rows) for x in range(cols)]

    def scan(of, low, high, past, shift, coded):
        out = segment(0xDA, bytes([len(of)]) + b"".join(bytes([names[k], 0]) for k in of) + bytes([low, high, past << 4 | shift]))
        every = units(of)
        step = interval or len(every)
        parts = [stuffed(coded(every[a : a + step])) for a in range(0, len(every), step)]
        return out + parts[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + p for k, p in enumerate(parts[1:]))

    def whole(part):
        out, before = "", dict.fromkeys(range(n), 0)
        for unit in part:
            for k, v in unit:
                out, before[k] = out + sequential(v, before[k]), v[0]
        return out

    def lead(shift):
        def coded(part):
            out, before = "", dict.fromkeys(range(n), 0)
            for unit in part:
                for k, v in unit:
                    size, bits = magnitude((v[0] >> shift) - before[k])
                    out, before[k] = out + CODES[size] + bits, v[0] >> shift
            return out
        return coded

    if not progressive:
        return head + scan(list(range(n)), 0, 63, 0, 0, whole) + b"\xff\xd9"
    flat = lambda f, *a: lambda part: f([v for unit in part for _, v in unit], *a)
    out = head + scan(list(range(n)), 0, 0, 0, 1, lead(1))
    for k in range(n):
        out += scan([k], 1, 5, 0, 2, flat(first_scan, 1, 5, 2)) + scan([k], 6, 63, 0, 2, flat(first_scan, 6, 63, 2))
        out += scan([k], 1, 63, 2, 1, flat(later_scan, 1, 63, 1))
    out += scan(list(range(n)), 0, 0, 1, 0, lambda part: "".join(str(v[0] & 1) for unit in part for _, v in unit))
    for k in range(n):
        out += scan([k], 1, 63, 1, 0, flat(later_scan, 1, 63, 0))
    return out + b"\xff\xd9"


def coefficients(rng, width, height, factors):
    mx, my = max(f[0] for f in factors), max(f[1] for f in factors)
    cols, rows = -(-width // (8 * mx)), -(-height // (8 * my))
    out = []
    for across, down in factors:
        used = [-(-(-(-width * across // mx)) // 8), -(-(-(-height * down // my)) // 8)]
        plane = []
        for y in range(rows * down):
            for x in range(cols * across):
                v = [rng.randrange(-60, 60)] + [0] * 63
                if x < used[0] and y < used[1]:  # scans of one plane skip blocks without pixels
                    for _ in range(rng.choice([0, 0, 1, 3, 30, 63])):
                        v[rng.randrange(1, 64)] = rng.choice([-1, 1, 2, -3, 7, rng.randrange(-40, 40)])
                plane.append(v)
        out.append(plane)
    return out


SHAPES = [(8, 8, [(1, 1)]), (37, 21, [(2, 2), (1, 1), (1, 1)]), (33, 50, [(2, 1), (1, 1), (1, 1)]), (19, 9, [(1, 1)] * 3), (30, 30, [(1, 1)] * 4), (25, 70, [(1, 2), (1, 1), (1, 2)])]


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_coefficients(progressive):
    """What a writer of baseline and progressive scans puts in comes out, with and without restarts."""
    rng = random.Random(3)
    for width, height, factors in SHAPES:
        for interval in (0, 2):
            values = coefficients(rng, width, height, factors)
            data = write(width, height, values, factors, range(1, 65), progressive, interval)
            w, h, planes, quants, _ = jpeg.parse(data)
            assert (w, h) == (width, height) and quants[0].tolist() == list(range(1, 65))
            assert [p.values.reshape(-1, 64).tolist() for p in planes] == values
            assert codecs.decode(data).shape == (height, width, 3)


def test_jpeg_pixels():
    """Planes by the sum of cosines, one pixel after the other; colours of each kind of file."""
    rng = random.Random(4)
    order, at = [], (0, 0)  # walked, as the standard's figure shows it
    for _ in range(64):
        order.append(at)
        y, x = at
        if (y + x) % 2 == 0:
            at = (y, x + 1) if y == 0 and x < 7 else (y + 1, x) if x == 7 else (y - 1, x + 1)
        else:
            at = (y + 1, x) if x == 0 and y < 7 else (y, x + 1) if y == 7 else (y + 1, x - 1)
    quant = [1 + k // 4 for k in range(64)]
    v = coefficients(rng, 8, 8, [(1, 1)])[0][0]
    v[3], v[17] = 5, -9
    grey = codecs.decode(write(8, 8, [[v]], [(1, 1)], quant))
    size = lambda u: 0.5**0.5 if u == 0 else 1.0
    for y in range(8):
        for x in range(8):
            s = sum(v[k] * quant[k] * size(a) * size(b) * np.cos((2 * y + 1) * a * np.pi / 16) * np.cos((2 * x + 1) * b * np.pi / 16) for k, (a, b) in enumerate(order)) / 4
            assert abs(int(grey[y, x, 0]) - min(255, max(0, s + 128))) <= 0.51 and len(set(grey[y, x].tolist())) == 1
    flat = lambda levels, **more: codecs.decode(write(20, 11, [[[c - 128] + [0] * 63] * 6 for c in levels], [(1, 1)] * len(levels), [8] * 64, **more))[5, 7].tolist()
    assert flat((150, 128, 128)) == [150] * 3 and flat((100, 128, 200)) == [201, 49, 100] and flat((100, 160, 128)) == [100, 89, 157]
    assert flat((10, 200, 60), adobe=0) == flat((10, 200, 60), names=b"RGB") == [10, 200, 60] and flat((200, 100, 50, 255), adobe=0) == [200, 100, 50]
    assert flat((200, 100, 50, 51)) == [40, 20, 10] and flat((150, 128, 128, 255), adobe=2) == [150] * 3
    half = codecs.decode(write(32, 16, [[[0] + [0] * 63] * 8, [[72] + [0] * 63, [-72] + [0] * 63], [[0] * 64] * 2], [(2, 2), (1, 1), (1, 1)], [8] * 64))
    assert (half[:, :16] == half[0, 0]).all() and (half[:, 16:] == half[0, 31]).all() and half[0, 0, 2] > 200 and half[0, 31, 2] < 50


def test_jpeg_broken():
    rng = random.Random(5)
    for progressive in (False, True):
        data = write(40, 40, coefficients(rng, 40, 40, [(2, 2), (1, 1), (1, 1)]), [(2, 2), (1, 1), (1, 1)], [2] * 64, progressive)
        for size in (2, 30, 700, len(data) // 3):
            with pytest.raises(ImageError):
                codecs.decode(data[:size])
        for _ in range(150):  # an error of ours or some picture, never anything else
            hurt = bytearray(data)
            for _ in range(rng.randrange(1, 6)):
                hurt[rng.randrange(2, len(hurt))] = rng.randrange(256)
            try:
                assert codecs.decode(bytes(hurt)).ndim == 3
            except ImageError:
                pass
    with pytest.raises(ImageError):
        codecs.decode(data.replace(b"\xff\xc2", b"\xff\xc9"))
    turned = tiff(4, 4, np.zeros((4, 4, 3), np.uint8), extra=[(0x0112, 3, [6])])
    values = coefficients(rng, 24, 16, [(1, 1)])
    raw = tiff(4, 4, np.zeros((4, 4, 3), np.uint8), extra=[(0x0112, 3, [3])])
    shot = write(264, 256, coefficients(rng, 264, 256, [(1, 1)]), [(1, 1)], [2] * 64)
    held = raw[:4] + struct.pack("<I", len(raw) + len(shot)) + raw[8:] + shot + struct.pack("<HHHIIHHIII", 2, 0x0201, 4, 1, len(raw), 0x0202, 4, 1, len(shot), 0)
    assert (images.load(held, "raw", codecs.decode) == codecs.decode(shot)).all()  # a preview's pixels
    plain = write(24, 16, values, [(1, 1)], [2] * 64)
    told = plain[:2] + segment(0xE1, b"Exif\0\0" + turned) + plain[2:]
    assert (images.load(told, "standard", codecs.decode) == np.rot90(codecs.decode(plain), -1)).all()


def lzw(data, bits, high_first):
    """Codes of data by a plain table of strings, packed."""
    clear = 1 << bits
    out, table, size, own = [(clear, bits + 1)], {}, bits + 1, b""
    fresh = lambda: {bytes([k]): k for k in range(clear)} | {None: 0, "end": 0}
    table = fresh()
    for byte in data:
        byte = bytes([byte])
        if own + byte in table:
            own += byte
            continue
        out.append((table[own], size))
        table[own + byte] = len(table)
        if len(table) + high_first > 1 << size:
            size += 1
        if len(table) >= 4094:
            out.append((clear, min(12, size)))
            table, size = fresh(), bits + 1
        own = byte
    out += [(table[own], size)]
    size += len(table) + 1 + high_first > 1 << size and size < 12
    out.append((clear + 1, size))
    if high_first:
        text = "".join(format(code, f"0{n}b") for code, n in out)
        return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    text = "".join(format(code, f"0{n}b") for code, n in reversed(out))
    return int(text, 2).to_bytes(-(-len(text) // 8), "little")


@pytest.mark.parametrize("high_first", [False, True])
def test_lzw(high_first):
    rng = random.Random(6)
    for n in (1, 2, 300, 5000, 60000):
        for most in (2, 5, 256):
            data = bytes(rng.randrange(most) for _ in range(n))
            assert codecs.unlzw(lzw(data, 8, high_first), 8, n, high_first) == data
    assert codecs.unlzw(lzw(b"\1" * 9000, 2, high_first), 2, 9000, high_first) == b"\1" * 9000


def gif(pixels, palette, laced=False, at=(0, 0), screen=None, local=False):
    h, w = pixels.shape
    bits = max(2, (len(palette) - 1).bit_length())
    rows = [y for a, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, step)] if laced else range(h)
    packed = lzw(pixels[list(rows)].tobytes(), bits, False)
    table, flag = palette.tobytes(), 0x80 | (len(palette) - 1).bit_length() - 1
    sw, sh = screen or (w, h)
    out = b"GIF89a" + struct.pack("<HHBBB", sw, sh, 0 if local else flag, 0, 0) + (b"" if local else table)
    out += b"\x21\xf9\x04\x01\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", *at, w, h, (flag if local else 0) | 64 * laced) + (table if local else b"") + bytes([bits])
    return out + b"".join(bytes([len(packed[k : k + 255])]) + packed[k : k + 255] for k in range(0, len(packed), 255)) + b"\0\x3b"


def test_gif():
    rng = np.random.default_rng(7)
    for colours in (2, 4, 256):
        palette = rng.integers(0, 256, (colours, 3), np.uint8)
        pixels = rng.integers(0, colours, (21, 70)).astype(np.uint8)
        for laced in (False, True):
            for local in (False, True):
                assert (codecs.decode(gif(pixels, palette, laced, local=local)) == palette[pixels]).all()
    placed = codecs.decode(gif(pixels, palette, at=(3, 2), screen=(80, 30)))
    assert placed.shape == (30, 80, 3) and (placed[2:23, 3:73] == palette[pixels]).all() and placed.sum() == palette[pixels].sum()
    whole = gif(pixels, palette)
    for broken in (whole[:6], whole[:800], whole[:-40], gif(pixels, palette, screen=(5, 5)), gif(pixels, palette)[:13] + b"\x3b"):
        with pytest.raises(ImageError):
            codecs.decode(broken)


def runs(data):
    """Each byte a stretch of one, but for long runs."""
    out, k = b"", 0
    while k < len(data):
        n = next((n for n in range(1, 128) if data[k + n : k + n + 1] != data[k : k + 1]), 128)
        out += bytes([257 - n, data[k]]) if n > 1 else bytes([0, data[k]])
        k += n
    return out + b"\x80"


PACK = {1: bytes, 5: lambda d: lzw(d, 8, True), 8: zlib.compress, 32773: runs}


def tiff(width, height, pixels, packing=1, kind=2, depth=8, big=False, rows=3, tile=None, apart=False, guess=1, extra=()):
    order, channels = ">" if big else "<", pixels.shape[2]
    w, h = tile or (width, rows)
    parts = []
    for planes in [[c] for c in range(channels)] if apart else [list(range(channels))]:
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = pixels[y : y + h, x : x + w][:, :, planes].astype(np.int64)
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if guess == 2:
                    block = np.diff(block, axis=1, prepend=0) % (1 << depth)
                if depth == 16:
                    raw = block.astype(order + "u2").tobytes()
                else:
                    bits = block[..., None] >> np.arange(depth)[::-1] & 1
                    raw = b"".join(np.packbits(line.reshape(-1).astype(bool)).tobytes() for line in bits)
                parts.append(PACK[packing](raw))
    tags = [(256, 4, [width]), (257, 3, [height]), (258, 3, [depth] * channels), (259, 3, [packing]), (262, 3, [kind]), (277, 3, [channels]), (284, 3, [1 + apart]), (317, 3, [guess]), *extra]
    starts = np.cumsum([8] + [len(p) for p in parts]).tolist()
    tags += [(322, 3, [w]), (323, 3, [h])] if tile else [(278, 3, [rows])]
    tags += [(324 if tile else 273, 4, starts[:-1]), (325 if tile else 279, 4, [len(p) for p in parts])]
    place = starts[-1]
    head, tail, beyond = b"", b"", place + 6 + 12 * len(tags)
    for tag, form, values in sorted(tags):
        packed = struct.pack(order + {3: "H", 4: "I"}[form] * len(values), *values)
        if len(packed) > 4:
            head += struct.pack(order + "HHII", tag, form, len(values), beyond + len(tail))
            tail += packed
        else:
            head += struct.pack(order + "HHI", tag, form, len(values)) + packed.ljust(4, b"\0")
    return (b"MM\0*" if big else b"II*\0") + struct.pack(order + "I", place) + b"".join(parts) + struct.pack(order + "H", len(tags)) + head + b"\0" * 4 + tail


def test_tiff():
    rng = np.random.default_rng(9)
    width, height = 37, 20
    rgb = rng.integers(0, 256, (height, width, 3), np.int64)
    for packing in PACK:
        for big in (False, True):
            for guess in (1, 2):
                assert (codecs.decode(tiff(width, height, rgb, packing, big=big, guess=guess)) == rgb).all()
                assert (codecs.decode(tiff(width, height, rgb * 256 + 9, packing, depth=16, big=big, guess=guess)) == rgb).all()
            assert (codecs.decode(tiff(width, height, rgb, packing, tile=(16, 16), big=big)) == rgb).all()
            assert (codecs.decode(tiff(width, height, rgb, packing, apart=True, big=big)) == rgb).all()
    assert (codecs.decode(tiff(width, height, np.concatenate([rgb, rgb[:, :, :1]], 2))) == rgb).all()
    for depth in (1, 2, 4, 8):
        few = rng.integers(0, 1 << depth, (height, width, 1))
        want = np.repeat(few * (255 // ((1 << depth) - 1)), 3, 2)
        assert (codecs.decode(tiff(width, height, few, kind=1, depth=depth)) == want).all() and (codecs.decode(tiff(width, height, few, kind=0, depth=depth)) == 255 - want).all()
        table = rng.integers(0, 256, (3, 1 << depth))
        assert (codecs.decode(tiff(width, height, few, kind=3, depth=depth, extra=[(320, 3, (table * 257).reshape(-1).tolist())])) == table.T[few[:, :, 0]]).all()
    ink = np.concatenate([rgb, np.full((height, width, 1), 51)], 2)
    assert np.abs(codecs.decode(tiff(width, height, ink, kind=5)).astype(int) - (255 - rgb) * 204 / 255).max() <= 0.51
    turned = tiff(width, height, rgb, extra=[(0x0112, 3, [8])])
    assert (images.load(turned, "standard", codecs.decode) == np.rot90(rgb)).all()
    whole = tiff(width, height, rgb, 5)
    for broken in (whole[:9], whole[:-30], tiff(width, height, rgb, kind=6), tiff(width, height, rgb, kind=3), whole.replace(struct.pack("<HHII", 256, 4, 1, 37), struct.pack("<HHII", 256, 4, 1, 0)), whole[:60] + b"\xff" * 400 + whole[460:]):
        with pytest.raises(ImageError):
            codecs.decode(broken)


def test_jpeg_speed():
    """A picture of half a million pixels, a value in two of them."""
    rng = random.Random(1)
    values = [[[5] + [rng.choice([0, 1, -2]) for _ in range(40)] + [0] * 23 for _ in range(400)] * 20]
    data = write(800, 640, values, [(1, 1)], [4] * 64)
    began = time.perf_counter()
    assert codecs.decode(data).shape == (640, 800, 3)
    assert time.perf_counter() - began < 20
