"""Path expressions over native bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind.
STANDARD = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff"]
RAW = ["cr2", "nef", "arw", "dng", "rw2", "pef", "raf", "cr3"]


def extension(path: Column) -> Column:
    """Lower-cased extension of a path (string); '' for none. '.png' and a bare 'png' have none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def image_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(STANDARD), "standard").when(ext.isin(RAW), "raw")


def url_path(url: Column) -> Column:
    """Path of a URL, without scheme, host, query and fragment."""
    return F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)


def components(path: Column) -> Column:
    """Key that orders binary paths part by part, where bytes would put 'a.jpg' before 'a/x.jpg'."""
    return F.split(F.decode(path, "ISO-8859-1"), "/")


def display(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/").encode() + b"/"), path)


def relative(root: str, path: Column) -> Column:
    return F.substring(path, F.lit(len(root.rstrip("/").encode()) + 2), F.octet_length(path))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of NUL-joined parts."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def escaped(text: Column) -> Column:
    """One line of text: backslash, tab, newline and return as escapes, other controls as \\u{..}."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in [*range(32), *range(127, 160)]:
        name = {9: "\\t", 10: "\\n", 13: "\\r"}.get(c, f"\\u{{{c:x}}}")
        out = F.replace(out, F.lit(chr(c)), F.lit(name))
    return F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f\\]"), out).otherwise(text)
