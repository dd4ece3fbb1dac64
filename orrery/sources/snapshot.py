"""The index: Parquet snapshots and deltas behind a manifest that is swapped atomically.

A commit writes its changes beside the snapshot, then replaces the manifest; readers see one or the other. Reading takes
the last change of each key over the snapshot. When MOST_DELTAS have gathered they are merged into a new snapshot, so a
row is rewritten once in so many commits. One
writer at a time holds an exclusive lock. Staged rebuilds are validated before the swap; dropping one leaves the live
index untouched. All of it lives in one folder that driver and executors share, on a file system with atomic rename; data
is on disk before a manifest names it.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.contracts import CHANGES, FORMAT_VERSION, IMAGES, QUERIES, Contract, IndexError_, InvalidVectorError
from orrery.errors import DuplicateChangeError, FormatError, IndexPathError, ManifestError, MetadataError, RootMismatchError, vector_error
from orrery.functions.vectors import is_stored
from orrery.operators.reconcile import apply_changes


MOST_DELTAS, QUERY_FOLDERS = 32, 256


def _bucket(query: Column) -> Column:
    """The folder that a query's rows are in."""
    return F.pmod(F.xxhash64(query), F.lit(QUERY_FOLDERS)).cast("int")


def _sync(path: str) -> None:
    """Wait until a file's bytes or a folder's names are on disk."""
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def sync(folder: str) -> None:
    for at, _, names in os.walk(folder):
        for path in [*(os.path.join(at, n) for n in names), at]:
            _sync(path)


class Index:
    def __init__(self, spark: SparkSession, path: str, contract: Contract, root: str = ""):
        """Open or create. A root other than the one bound is an error; a changed contract clears its own side only;
        formats before 2 are cleared, format 2 is taken over, newer ones are rejected."""
        path = os.path.realpath(path)
        if path.endswith(".lock"):
            raise IndexPathError(path=path, cause="an index may not be named like a lock")
        if not os.path.isdir(os.path.dirname(path)):
            raise IndexPathError(path=path, cause="its folder does not exist")
        if os.path.isfile(path):
            raise IndexPathError(path=path, cause="is a file")
        self.spark, self.path, self.contract = spark, path, contract
        os.makedirs(path, exist_ok=True)
        old = self._load()
        if old is not None and old.get("version", 0) > FORMAT_VERSION:
            raise FormatError(found=old["version"], known=FORMAT_VERSION)
        if old is None or old.get("version", 0) < 2:
            self._swap({"version": FORMAT_VERSION, "root": root, "image": contract.image, "query": contract.query, "images": None, "queries": None})
            return
        if root and old.get("root") and old["root"] != root:
            raise RootMismatchError(bound=old["root"], asked=root)
        new = old | {"version": FORMAT_VERSION, "root": old.get("root") or root, "image": contract.image, "query": contract.query}
        if old.get("image") != contract.image:
            new["images"], new["deltas"] = None, []
        if old.get("query") != contract.query:
            new["queries"] = None
        if new != old:
            self._swap(new)

    @contextmanager
    def locked(self, on_wait=lambda: None):
        """Exclusive over processes for one request; on_wait is called once if another holds it."""
        with open(self.path + ".lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                on_wait()
                fcntl.flock(f, fcntl.LOCK_EX)
            yield self

    def _load(self) -> dict | None:
        try:
            with open(f"{self.path}/manifest.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return None
        except ValueError as e:
            raise ManifestError(cause=str(e)) from e

    def _swap(self, manifest: dict) -> None:
        temp = f"{self.path}/.manifest-{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, f"{self.path}/manifest.json")
        _sync(self.path)
        self._clean(manifest)

    def _clean(self, manifest: dict) -> None:
        """Snapshots that neither this manifest nor the one before it names (a reader may still be on that)."""
        now = {manifest.get("images"), manifest.get("queries"), *manifest.get("deltas", ())}
        used = now | getattr(self, "_before", set())
        self._before = now
        for name in os.listdir(self.path):
            if name.startswith(("images-", "queries-", "delta-")) and name not in used:
                shutil.rmtree(f"{self.path}/{name}", ignore_errors=True)

    def metadata(self, key: str):
        found = self._load() or {}
        if key not in found:
            raise MetadataError(key=key)
        return found[key]

    def _table(self, kind: str, schema) -> DataFrame:
        name = self.metadata(kind)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], schema)

    def _changes(self, columns: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """The deltas with seq, and of each path the last change (seq, op, mtime_ns, size): found on narrow columns."""
        deltas = (self._load() or {}).get("deltas", [])
        if not deltas:
            return None, None
        schema = T.StructType([*CHANGES.fields, T.StructField("seq", T.LongType())])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for name in deltas])
        last = rows.groupBy("path").agg(F.max_by(F.struct("seq", "op", "mtime_ns", "size"), "seq").alias("c")).select("path", "c.*")
        return rows.select("path", "seq", *columns), last

    def images(self) -> DataFrame:
        base = self._table("images", IMAGES)
        rows, last = self._changes(["op", "mtime_ns", "size", "embedding"])
        if rows is None:
            return base
        newest = rows.where("op = 'upsert'").join(last.select("path", "seq"), ["path", "seq"]).select(*base.columns)
        return base.join(last.select("path"), "path", "left_anti").unionByName(newest)

    def files(self) -> DataFrame:
        """Keys and versions; no vector is read, of the snapshot or of a delta."""
        base, (rows, last) = self._table("images", IMAGES).select("path", "mtime_ns", "size"), self._changes([])
        return base if rows is None else apply_changes(base, last)

    def queries(self) -> DataFrame:
        return self._table("queries", QUERIES).select("query", "embedding")

    def count(self) -> int:
        return self.files().count()

    def vectors(self) -> DataFrame:
        """path, embedding; a vector that breaks its contract fails the job."""
        bad = F.raise_error(F.lit("a stored vector is invalid"))
        return self.images().select("path", F.when(is_stored(F.col("embedding"), self.contract.dim), F.col("embedding")).otherwise(bad.cast("array<float>")).alias("embedding"))

    def _write(self, kind: str, rows: DataFrame) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        sync(f"{self.path}/{name}")
        return name

    def commit(self, changes: DataFrame) -> None:
        """Upserts and deletes (CHANGES), all or nothing. A key may come once. Rows are computed once: vectors are checked while they
        are written, keys by what was written; a delta that fails is deleted, and no manifest has named it."""
        changes = changes.select(*[f.name for f in CHANGES.fields])
        seen = Observation()
        invalid = (F.col("op") == "upsert") & ~is_stored(F.col("embedding"), self.contract.dim)
        name = self._delta(changes.observe(seen, F.count_if(invalid).alias("invalid"), F.count("*").alias("n")))
        written = self.spark.read.schema(CHANGES).parquet(f"{self.path}/{name}")
        try:
            if seen.get["invalid"]:
                row = written.where(invalid).select("path", "embedding").first()
                raise vector_error(bytes(row.path), row.embedding, self.contract.dim) or InvalidVectorError("a new vector is invalid")
            if row := written.groupBy("path").count().where("count > 1").first():
                raise DuplicateChangeError(path=bytes(row.path), n=row["count"])
        except IndexError_:
            shutil.rmtree(f"{self.path}/{name}", ignore_errors=True)
            raise
        self._append(name)

    def _delta(self, changes: DataFrame) -> str:
        return self._write("delta", changes.withColumn("seq", F.lit((self._load() or {}).get("seq", 0) + 1).cast("long")))

    def _append(self, name: str) -> None:
        now = self._load()
        deltas = [*now.get("deltas", []), name]
        self._swap(now | {"deltas": deltas, "seq": now.get("seq", 0) + 1})
        if len(deltas) >= MOST_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Merge the deltas into a new snapshot."""
        if self._load().get("deltas"):
            self._swap(self._load() | {"images": self._write("images", self.images()), "deltas": []})

    def delete(self, paths: DataFrame) -> None:
        gone = paths.select(F.lit("delete").alias("op"), "path").distinct()
        self._append(self._delta(gone.select("op", "path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in CHANGES.fields[2:]])))

    def remember(self, query: str, embedding: list[float]) -> None:
        """Append one row to the query's folder of ``queries``; nothing that is there is read or written again. The last row of a
        query counts."""
        name = self.metadata("queries") or f"queries-{uuid.uuid4().hex}"
        new = self.spark.createDataFrame([(query, [float(x) for x in embedding], time.time_ns())], "query string, embedding array<float>, seq long")
        held = new.withColumn("bucket", _bucket(F.col("query"))).coalesce(1).write.mode("append").partitionBy("bucket")
        held.option("parquet.bloom.filter.enabled#query", "true").parquet(f"{self.path}/{name}")
        sync(f"{self.path}/{name}/bucket={new.select(_bucket(F.col('query'))).first()[0]}")
        if self.metadata("queries") != name:
            self._swap(self._load() | {"queries": name})

    def recalled(self, query: str) -> DataFrame:
        """The rows of a query: one folder is listed, and of its files those whose Bloom filter may hold it are read."""
        name = self.metadata("queries")
        schema = "query string, embedding array<float>, seq long, bucket int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], schema)
        return rows.where((F.col("bucket") == _bucket(F.lit(query))) & (F.col("query") == query))

    def recall(self, query: str) -> list[float] | None:
        row = self.recalled(query).agg(F.max_by("embedding", "seq").alias("embedding")).first()
        return None if row.embedding is None else list(row.embedding)

    def stage(self) -> Index:
        """An empty index beside this one, to be installed or dropped."""
        return Index(self.spark, f"{self.path}.stage-{uuid.uuid4().hex}", self.contract, self.metadata("root"))

    def install(self, staged: Index) -> None:
        """Validate the staged index, then move its snapshots here and point at them."""
        staged.compact()
        if staged.images().where(~is_stored(F.col("embedding"), self.contract.dim)).limit(1).count():
            raise InvalidVectorError("the staged index holds an invalid vector")
        if staged.queries().where(~is_stored(F.col("embedding"), self.contract.dim)).limit(1).count():
            raise InvalidVectorError("the staged index holds an invalid query vector")
        found = staged._load()
        for kind in ("images", "queries"):
            if found[kind]:
                os.rename(f"{staged.path}/{found[kind]}", f"{self.path}/{found[kind]}")
        _sync(self.path)
        self._swap(found)
        staged.drop()

    def drop(self) -> None:
        for path in (self.path, f"{self.path}.feed"):
            shutil.rmtree(path, ignore_errors=True)
        if os.path.exists(self.path + ".lock"):
            os.remove(self.path + ".lock")
