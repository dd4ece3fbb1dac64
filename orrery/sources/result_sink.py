"""Results written by all tasks, as a data source: ``result_lines``.

Rows (score, path) arrive in range partitions of their rank. Each task renders its rows to a part, byte by byte as sinks.render()
does for one list, and commits its number and size; the driver then moves the parts into place in order of partition and
adds what stands before, between and after them: the header of text, the brackets and commas of JSON. The files by name, one after the
other, are the output. Nothing but these messages reaches the driver. A task that fails leaves a file that no commit names, and
a job that fails deletes all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from orrery.errors import FormError, PathEncodingError
from orrery.sources.sinks import render

FORMS = ("text", "json", "paths", "nul")
ROWS = 4096


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


def pieces(rows, form: str):
    """The bytes of one part, without what belongs to the whole."""
    first = True
    held: list[tuple[float, bytes]] = []

    def told() -> bytes:
        if form != "json":
            return render(held, form, quiet=True)
        body = b",\n".join(b"  " + json.dumps({"score": s, "path": _text(p)}, indent=2, ensure_ascii=False).replace("\n", "\n  ").encode() for s, p in held)
        return body if first else b",\n" + body

    for row in rows:
        held.append((row[0], bytes(row[1])))
        if len(held) == ROWS:
            yield told(), len(held)
            first, held = False, []
    if held:
        yield told(), len(held)


def _text(path: bytes) -> str:
    try:
        return path.decode()
    except UnicodeDecodeError as e:
        raise PathEncodingError(path=path) from e


class ResultWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.form = options["path"].rstrip("/"), options.get("form", "text")
        self.quiet = options.get("quiet", "false").lower() == "true"
        if self.form not in FORMS:
            raise FormError(known=", ".join(FORMS), form=self.form)

    def write(self, iterator):
        where, path = _open(f"{self.path}/_parts")
        where.create_dir(path, recursive=True)
        number, name, n = TaskContext.get().partitionId(), f"{path}/{uuid.uuid4().hex}", 0
        with where.open_output_stream(name) as out:
            for data, rows in pieces(iterator, self.form):
                out.write(data)
                n += rows
        return Part(number, name, n)

    def commit(self, messages) -> None:
        where, path = _open(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        json_form = self.form == "json"
        head = b"[\n" if json_form and parts else b"[]\n" if json_form else b"score\tpath\n" if self.form == "text" and parts and not self.quiet else b""

        def put(name: str, data: bytes) -> None:
            with where.open_output_stream(f"{path}/{name}") as out:
                out.write(data)

        if head:
            put("part-000000-0", head)
        for k, part in enumerate(parts, 1):
            if json_form and k > 1:
                put(f"part-{k:06}-0", b",\n")
            where.move(part.name, f"{path}/part-{k:06}-1")
        if json_form and parts:
            put(f"part-{len(parts) + 1:06}-0", b"\n]\n")
        where.delete_dir(f"{path}/_parts") if where.get_file_info(f"{path}/_parts").type == fs.FileType.Directory else None
        put("_SUCCESS", b"")

    def abort(self, messages) -> None:
        where, path = _open(f"{self.path}/_parts")
        if where.get_file_info(path).type == fs.FileType.Directory:
            where.delete_dir(path)


class ResultSink(DataSource):
    @classmethod
    def name(cls):
        return "result_lines"

    def writer(self, schema, overwrite):
        return ResultWriter(self.options)


def write_results(rows: DataFrame, path: str, order: list[Column | str], score: str = "score", key: str = "path", form: str = "text", quiet: bool = False) -> None:
    """rows by ``order`` to a folder that doesn't exist yet, as text (TSV), json, paths or nul. key: bytes of a path; score: double."""
    rows.sparkSession.dataSource.register(ResultSink)
    names = [c for c in (score, key)]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    dealt.write.format("result_lines").mode("append").option("path", path).option("form", form).option("quiet", str(quiet).lower()).save()


def read_bytes(path: str) -> bytes:
    """The files of a written folder one after the other; for small results and tests."""
    where, own = _open(path)
    files = sorted(f.path for f in where.get_file_info(fs.FileSelector(own)) if f.type == fs.FileType.File and "/part-" in f.path)
    return b"".join(where.open_input_stream(f).readall() for f in files)
