"""Result sinks on the driver: at most ``top`` rows reach them."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_EVEN, Decimal

from orrery.errors import PathEncodingError


def escape_path(path: bytes) -> str:
    """Backslash, tab, newline and return as escapes, other controls as \\u{..}; a path that is not UTF-8 byte by byte."""
    short = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
    try:
        text = path.decode()
    except UnicodeDecodeError:
        return "".join("\\\\" if b == 0x5C else chr(b) if 0x20 <= b <= 0x7E else f"\\x{b:02x}" for b in path)
    return "".join(short.get(c) or (f"\\u{{{ord(c):x}}}" if ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in text)


def score_text(score: float) -> str:
    """Three places, exact ties to even."""
    return str(Decimal(score).quantize(Decimal("0.001"), ROUND_HALF_EVEN))


def render(rows: list[tuple[float, bytes]], form: str = "text", quiet: bool = False) -> bytes:
    """rows as text (TSV), json, paths or nul."""
    if form == "json":
        try:
            return (json.dumps([{"score": s, "path": p.decode()} for s, p in rows], indent=2, ensure_ascii=False) + "\n").encode()
        except UnicodeDecodeError as e:
            raise PathEncodingError(path=e.object) from e
    if form in ("paths", "nul"):
        return b"".join(p + (b"\n" if form == "paths" else b"\0") for _, p in rows)
    head = "" if quiet or not rows else "score\tpath\n"
    return (head + "".join(f"{score_text(s)}\t{escape_path(p)}\n" for s, p in rows)).encode()
