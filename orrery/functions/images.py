"""Pixels to model input, and previews out of RAW containers. Codecs are injected: what is here starts at RGB bytes."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.contracts import ImageError

SIDE = 256
MAX_PIXELS, MAX_WORKING = 100_000_000, 512 << 20
MAX_IFDS, MAX_ENTRIES, MAX_BOXES, MAX_PREVIEW = 64, 1024, 1024, 64 << 20

# The encoder's channel means and deviations, and the vendor's box identifiers.
MEAN = (0.48145466, 0.4578275, 0.40821073)
STD = (0.26862954, 0.2613026, 0.2757771)
CR3_PREVIEW = bytes.fromhex("eaf42b5e1c984b88b9fbb7dc406e4d16")
CR3_METADATA = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")


def resized_size(width: int, height: int) -> tuple[int, int]:
    """Short edge SIDE, the other in proportion, rounded down."""
    return (SIDE, height * SIDE // width) if width < height else (width * SIDE // height, SIDE)


def crop_offset(room: int) -> int:
    """Half the room, halves to even."""
    return int(np.rint(room / 2))


def working_bytes(width: int, height: int, decoded: int) -> int:
    w, h = resized_size(width, height)
    return 2 * decoded + 3 * width * height + 3 * w * h + 3 * SIDE * SIDE + 4 * 3 * SIDE * SIDE


def check_size(width: int, height: int, decoded: int) -> None:
    if width == 0 or height == 0:
        raise ImageError("the image has no pixels")
    if width * height > MAX_PIXELS or working_bytes(width, height, decoded) > MAX_WORKING:
        raise ImageError(f"{width} x {height} is too large")


def _weights(size: int, out: int) -> np.ndarray:
    """Bicubic (a = -0.5) weights, out x size, antialiased, in 22-bit fixed point."""
    scale = size / out
    wide = max(scale, 1.0)
    center = (np.arange(out) + 0.5) * scale
    low = np.maximum((center - 2 * wide + 0.5).astype(np.int64), 0)
    high = np.minimum((center + 2 * wide + 0.5).astype(np.int64), size)
    at = np.arange(size)
    x = np.abs((at[None, :] - center[:, None] + 0.5) / wide)
    w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    w = np.where((at >= low[:, None]) & (at < high[:, None]), w, 0.0)
    w = w / w.sum(1, keepdims=True) * (1 << 22)
    return np.where(w < 0, np.ceil(w - 0.5), np.floor(w + 0.5)).astype(np.int64)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """H x W x 3 bytes to height x width x 3: across, then down, each rounded and clamped to bytes."""
    def apply(w, x):
        return np.clip((np.einsum("os,s...->o...", w, x.astype(np.int64)) + (1 << 21)) >> 22, 0, 255).astype(np.uint8)

    if pixels.shape[1] != width:
        pixels = apply(_weights(pixels.shape[1], width), pixels.transpose(1, 0, 2)).transpose(1, 0, 2)
    return pixels if pixels.shape[0] == height else apply(_weights(pixels.shape[0], height), pixels)


def prepare(pixels: np.ndarray) -> np.ndarray:
    """RGB bytes to 3 x SIDE x SIDE floats: resized, cropped in the middle, scaled by the channel's mean and deviation."""
    height, width = pixels.shape[:2]
    check_size(width, height, pixels.nbytes)
    w, h = resized_size(width, height)
    left, top = crop_offset(w - SIDE), crop_offset(h - SIDE)
    cut = resize(pixels, w, h)[top : top + SIDE, left : left + SIDE].astype(np.float32) / np.float32(255)
    return ((cut - np.array(MEAN, np.float32)) / np.array(STD, np.float32)).transpose(2, 0, 1)


def orient(pixels: np.ndarray, exif: int) -> np.ndarray:
    """Upright pixels for EXIF orientation 1 to 8."""
    if exif in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    flips = {2: (0, 1), 3: (1, 1), 4: (1, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}.get(exif, (0, 0))
    return pixels[:: -1 if flips[0] else 1, :: -1 if flips[1] else 1]


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height in a JPEG's frame header."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                return None
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + length
    return None


def exif_orientation(jpeg: bytes) -> int | None:
    """Orientation (1 to 8) that a JPEG's own EXIF block gives."""
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        length = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] == 0xE1 and jpeg[at + 4 : at + 10] == b"Exif\0\0":
            try:
                return Tiff(jpeg[at + 10 : at + 2 + length]).orientation()
            except ImageError:
                return None
        at += 2 + length
    return None


class Tiff:
    """Directories of a TIFF-like container. An entry is (kind, count, value as a long, value as it stands)."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II*\0": "<", b"IIU\0": "<", b"MM\0*": ">"}.get(data[:4])
        if self.order is None:
            raise ImageError("the header is not known")
        self.root = self._unpack("I", 4)[0]

    def _unpack(self, form: str, at: int) -> tuple:
        if at > len(self.data):
            raise ImageError("an offset is out of bounds")
        try:
            return struct.unpack_from(self.order + form, self.data, at)
        except struct.error as e:
            raise ImageError("the container is cut short") from e

    def directory(self, at: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
        """(tag, kind, count, long, scalar or -1) of each entry, and where the next directory is."""
        (n,) = self._unpack("H", at)
        if n > MAX_ENTRIES:
            raise ImageError("too many entries")
        flat = self._unpack("HHII" * n + "I", at + 2)
        out = []
        for k in range(n):
            tag, kind, count, value = flat[4 * k : 4 * k + 4]
            short = self._unpack("H", at + 2 + 12 * k + 8)[0]
            out.append((tag, kind, count, value, -1 if count != 1 else short if kind == 3 else value if kind in (4, 13) else -1))
        return out, flat[-1]

    def orientation(self) -> int | None:
        """Of the first directory; the last entry counts."""
        found = [scalar for tag, _, _, _, scalar in self.directory(self.root)[0] if tag == 0x0112] if self.root else []
        return found[-1] if found and 1 <= found[-1] <= 8 else None

    def _below(self, count: int, value: int, waiting: int) -> list[int]:
        if waiting + count > MAX_IFDS:
            raise ImageError("too many directories")
        return [value] if count == 1 else list(self._unpack("I" * count, value)) if count else []

    def previews(self) -> list[tuple[int, int]]:
        """Place and length of each embedded JPEG. Of the directories that wait, the last found is read first: a directory's
        next before those below it. One that is met twice is an error."""
        waiting, seen, out = [self.root], set(), []
        while waiting:
            at = waiting.pop()
            if at == 0:
                continue
            if at in seen:
                raise ImageError("the directories run in a circle")
            seen.add(at)
            if len(seen) > MAX_IFDS:
                raise ImageError("too many directories")
            entries, following = self.directory(at)
            tags = {tag: scalar for tag, _, _, _, scalar in entries}
            for tag, kind, count, value, _ in entries:
                if tag == 0x014A and kind in (4, 13):
                    waiting += self._below(count, value, len(waiting))
            whole = [(tags.get(a, -1), tags.get(b, -1)) for a, b in ((0x0201, 0x0202), (0x0111, 0x0117)) if a == 0x0201 or tags.get(0x0103) in (6, 7)]
            out += [own for own in whole if min(own) >= 0]
            out += [(value, count) for tag, kind, count, value, _ in entries if tag == 0x002E and kind in (1, 7) and count > 4][-1:]
            waiting.append(following)
        return out


def _boxes(data: bytes, at: int, end: int, budget: list[int]):
    while at < end:
        budget[0] -= 1
        if budget[0] < 0:
            raise ImageError("too many boxes")
        if at + 8 > end:
            raise ImageError("an offset is out of bounds")
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            raise ImageError("an offset is out of bounds")
        yield data[at + 4 : at + 8], at + head, at + size
        at += size


def _cr3(data: bytes) -> tuple[list[tuple[int, int]], int | None]:
    spans, turned, budget = [], None, [MAX_BOXES]
    for kind, a, b in _boxes(data, 0, len(data), budget):
        if kind == b"uuid" and data[a : a + 16] == CR3_PREVIEW:
            for inner, x, end in _boxes(data, a + 24, b, budget):
                if inner == b"PRVW":
                    length = int.from_bytes(data[x + 12 : x + 16], "big")
                    spans.append((x + 16, length if x + 16 + length <= end else len(data)))
        elif kind == b"moov":
            for inner, x, end in _boxes(data, a, b, budget):
                if inner == b"uuid" and data[x : x + 16] == CR3_METADATA:
                    found = [data[y:stop] for name, y, stop in _boxes(data, x + 16, end, budget) if name == b"CMT1"]
                    turned = Tiff(found[0]).orientation() if found else None
                    break
    return spans, turned


def raw_preview(data: bytes) -> tuple[bytes, int | None]:
    """The JPEG preview of most pixels (the first, if tied), with a short edge of SIDE at least, and the container's
    orientation."""
    turned = None
    if data[:8] == b"FUJIFILM":
        if data[:15] != b"FUJIFILMCCD-RAW" or len(data) < 92:
            raise ImageError("the header is not known")
        spans = [struct.unpack_from(">II", data, 84)]
    elif data[4:8] == b"ftyp":
        spans, turned = _cr3(data)
    else:
        container = Tiff(data)
        spans, turned = container.previews(), container.orientation()
    best, size, outside = None, (0, 0), False
    for at, length in spans:
        outside |= at + length > len(data)
        part = data[at : at + length]
        if at + length > len(data) or not 2 <= length <= MAX_PREVIEW or part[:2] != b"\xff\xd8":
            continue
        found = jpeg_size(part)
        if found and (best is None or found[0] * found[1] > size[0] * size[1]):
            best, size = part, found
    if best is None:
        raise ImageError("an offset is out of bounds" if outside else "there is no preview")
    if min(size) < SIDE:
        raise ImageError(f"the preview has {size[0]} x {size[1]} pixels only")
    return best, turned


def load(data: bytes, kind: str, decode) -> np.ndarray:
    """Upright RGB pixels of a file's bytes. decode turns the bytes of a common format into pixels as they are stored; a raw
    file gives its largest preview. A JPEG's own orientation goes before its container's; a TIFF's is that of its first page."""
    turned = None
    if kind == "raw":
        data, turned = raw_preview(data)
    if data[:2] == b"\xff\xd8":
        if (found := jpeg_size(data)) is not None:
            check_size(*found, 3 * found[0] * found[1])  # before any pixel is decoded
        turned = exif_orientation(data) or turned
    elif data[:4] in (b"II*\0", b"MM\0*"):
        turned = Tiff(data).orientation()
    return orient(decode(data), turned or 1)


def size_columns(width: Column, height: Column) -> dict[str, Column]:
    """resized_width, resized_height, left, top, working_bytes and accepted, as expressions: what resized_size(),
    crop_offset(), working_bytes() of three bytes a pixel and check_size() say."""
    wide = width >= height
    w = F.when(wide, F.floor(F.try_divide(width * SIDE, height))).otherwise(SIDE).cast("long")
    h = F.when(wide, SIDE).otherwise(F.floor(F.try_divide(height * SIDE, width))).cast("long")
    pixels = width.cast("long") * height
    work = 9 * pixels + 3 * w * h + 3 * SIDE * SIDE + 12 * SIDE * SIDE
    accepted = (width > 0) & (height > 0) & (pixels <= MAX_PIXELS) & F.coalesce(work <= MAX_WORKING, F.lit(False))
    return {"resized_width": w, "resized_height": h, "left": F.rint((w - SIDE) / 2).cast("long"), "top": F.rint((h - SIDE) / 2).cast("long"), "working_bytes": work, "accepted": accepted}
