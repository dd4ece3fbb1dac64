"""File scan in rounds: byte-exact paths, nanosecond times, symbolic links never followed, hidden files included. Any
unreadable entry, or a time before 1970, ends the scan."""

from __future__ import annotations

import os
import stat
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orrery.contracts import FILES
from orrery.errors import EntryError, EpochError, FolderError, RootKindError, RootMissingError
from orrery.functions.paths import RAW, STANDARD
from orrery.sources.shared import new_folder

LISTED = 50_000


def resolve_root(path: str) -> str:
    """Canonical directory, or ScanError."""
    try:
        found = os.path.realpath(path, strict=True)
    except OSError as e:
        raise RootMissingError(path=path, cause=str(e)) from e
    if not os.path.isdir(found):
        raise RootKindError(path=found)
    return found


def is_supported(name: bytes) -> bool:
    stem, dot, ext = name.rpartition(b".")
    return bool(stem) and dot == b"." and ext.lower().decode("ascii", "replace") in {*STANDARD, *RAW}


def snapshot(path: bytes, shown: bytes) -> tuple[bytes, int, int] | None:
    try:
        info = os.lstat(path)
    except OSError as e:
        raise EntryError(path=shown, cause=str(e)) from e
    if not stat.S_ISREG(info.st_mode):
        return None
    if info.st_mtime_ns < 0:
        raise EpochError(path=shown, mtime_ns=info.st_mtime_ns)
    return shown, info.st_mtime_ns, info.st_size


def listed(root: bytes, folders: list[bytes], limit: int):
    """Supported names and folders at and below some folders of the root, as (path, is a folder); once ``limit`` entries have
    been seen, what is left is told as folders, for others to list. Nothing is read but names and their kinds."""
    left, seen = list(reversed(folders)), 0
    while left:
        below = left.pop()
        if seen >= limit:
            yield below, True
            continue
        try:
            with os.scandir(os.path.join(root, below) if below else root) as entries:
                for e in entries:
                    seen += 1
                    path = os.path.join(below, e.name) if below else e.name
                    if e.is_dir(follow_symlinks=False):
                        left.append(path)
                    elif is_supported(e.name) and e.is_file(follow_symlinks=False):
                        yield path, False
        except OSError as e:
            raise FolderError(path=e.filename, cause=str(e)) from e


def discover(spark: SparkSession, root: str, limit: int = LISTED) -> DataFrame:
    """path, mtime_ns, size of the supported files below root, in byte order of path.

    Folders are listed in rounds, breadth first: in each a task lists what it was dealt and what it finds there, up to ``limit``
    entries, and the folders left over are dealt anew to all tasks in the next round. Then files are dealt once more for
    their times and sizes, so a single folder with all files keeps one task busy with its names alone. Rounds are written to the
    shared folder, and the driver sees counts."""
    base, kept = resolve_root(root).encode("utf-8", "surrogateescape"), new_folder(spark, "scan")
    parts = max(2, spark.sparkContext.defaultParallelism)

    def look(batches):
        for batch in batches:
            rows = listed(base, batch["path"].to_pylist(), limit)
            while part := list(islice(rows, 10_000)):
                yield pa.record_batch([pa.array([p for p, _ in part], pa.binary()), pa.array([d for _, d in part], pa.bool_())], ["path", "folder"])

    def stat_all(batches):
        for batch in batches:
            rows = [row for p in batch["path"].to_pylist() if (row := snapshot(os.path.join(base, p), p))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.binary(), pa.int64(), pa.int64()))], ["path", "mtime_ns", "size"])

    level, rounds = spark.createDataFrame([(b"",)], "path binary"), []
    while True:
        rounds.append(f"{kept}/round-{len(rounds)}")
        level.mapInArrow(look, "path binary, folder boolean").write.parquet(rounds[-1])
        told = spark.read.schema("path binary, folder boolean").parquet(rounds[-1])
        level = told.where("folder").select("path").repartition(parts)
        if level.isEmpty():
            break
    names = spark.read.schema("path binary, folder boolean").parquet(*rounds).where("not folder").select("path")
    return names.repartition(parts).mapInArrow(stat_all, FILES).orderBy("path")
