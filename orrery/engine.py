"""Search, index and rebuild: the request level."""

from __future__ import annotations

import os
from enum import Enum

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orrery.contracts import DEFAULT_THRESHOLD, DEFAULT_TOP, FILES, INGEST_BATCH, Contract
from orrery.errors import QueryChoiceError, QueryImageError, check_query, check_threshold, check_top
from orrery.functions.paths import components
from orrery.operators.encode import Encoder, checked, embed
from orrery.operators.ranking import search as rank
from orrery.operators.reconcile import missing, only_in
from orrery.sources.scan import discover, resolve_root
from orrery.sources.shared import kept
from orrery.sources.snapshot import Index
from orrery.streaming.feed import Feed
from orrery.timing import Progress, Timings


class Cache(Enum):
    USE, REINDEX, DISABLED = range(3)


class Engine:
    def __init__(self, spark: SparkSession, root: str, encoder: Encoder, contract: Contract, index_path: str | None = None, on_skip=lambda path, error: None, timings: Timings | None = None, progress: Progress | None = None, commit: int = INGEST_BATCH):
        self.spark, self.root, self.encoder, self.contract, self.on_skip = spark, resolve_root(root), encoder, contract, on_skip
        self.timings, self.progress = timings or Timings(False), progress or Progress(lambda line: None)
        self.commit = commit
        self.index_path = index_path or os.path.join(self.root, ".orrery-index")

    def _open(self) -> Index:
        return Index(self.spark, self.index_path, self.contract, self.root)

    def refresh(self, index: Index) -> None:
        """Bring the index up to the tree: stale keys go first, then changed and new files are embedded and committed by one
        streaming query, ``self.commit`` files a micro-batch, so a crash leaves a valid index. The next run first ends
        what the one before left over, from the batch that it stopped at. A file that cannot be decoded loses its row, or
        never gets one and is tried again each time."""
        feed = Feed(self.spark, f"{index.path}.feed", FILES)
        if feed.begun:
            feed.drain(lambda rows: self._ingest(index, rows), self.commit)
        with self.timings.phase("scan"):
            found = discover(self.spark, self.root).persist()
            self.timings.note(corpus_size=found.count())
        with self.timings.phase("reconcile"):
            files = index.files()
            stale = only_in(files, found, "path").select("path")
            if not stale.isEmpty():
                index.delete(stale)
            todo = missing(found, files).persist()
            n = todo.count()
        self.timings.note(index_cache_state="hit" if not n else "partial" if n < self.timings.facts["corpus_size"] else "miss")
        if n:
            self.progress.started(n)
            feed.write(todo, "path", self.commit)
            todo.unpersist()
            found.unpersist()
            feed.drain(lambda rows: self._ingest(index, rows), self.commit)
        todo.unpersist()
        found.unpersist()

    def _ingest(self, index: Index, files: DataFrame) -> None:
        """Embed and commit some files. How many rows there are, how many failed, and what tasks spent on decoding and on the model are
        observed on the way; only a micro-batch with failures is looked at again for their messages."""
        seen = Observation()
        told = [F.count("*").alias("n"), F.count("error").alias("bad"), F.sum("decode_ms").alias("decode"), F.sum("infer_ms").alias("infer")]
        with self.timings.phase("embed"):
            done = kept(embed(files, self.root, self.encoder).observe(seen, *told), "embedded")
        if seen.get["bad"]:
            for row in done.where("error is not null").select("path", "error").orderBy("path").collect():  # of one micro-batch
                self.on_skip(bytes(row.path), row.error)
                self.progress.skipped(bytes(row.path), row.error)
        self.timings.add("decode", seen.get["decode"] or 0.0, seen.get["n"])
        self.timings.add("inference", seen.get["infer"] or 0.0, seen.get["n"] - seen.get["bad"])
        op = F.when(F.col("error").isNull(), "upsert").otherwise("delete")
        with self.timings.phase("commit"):
            index.commit(done.select(op.alias("op"), "path", "mtime_ns", "size", "embedding"))
        self.progress.processed(seen.get["n"])

    def index(self) -> int:
        """Refresh; the number of images indexed."""
        with self._open().locked() as index:
            self.refresh(index)
            return index.count()

    def _text(self, query: str, index: Index | None) -> list[float]:
        known = index.recall(query) if index else None
        self.timings.note(query_cache_state="disabled" if index is None else "miss" if known is None else "hit")
        if known is not None:
            return known
        with self.timings.phase("encode_text"):
            vector = checked(self.encoder.text(query)[None], 1)[0].tolist()
        if index:
            index.remember(query, vector)
        return vector

    def _answer(self, vectors: DataFrame, index: Index | None, text: str | None, image: str | None, top: int, threshold: float):
        exclude = None
        if image is not None:
            full = os.path.realpath(image)
            own = os.path.relpath(full, self.root).encode("utf-8", "surrogateescape")
            row = vectors.where(F.col("path") == F.lit(own)).select("embedding").first()
            prepared = None if row else self.encoder.prepare(full.encode("utf-8", "surrogateescape"))
            exclude = F.col("path") == F.lit(own)
            if vectors.where(~exclude).isEmpty():
                return []
            query = list(row.embedding) if row else checked(self.encoder.images([prepared]), 1)[0].tolist()
        elif vectors.isEmpty():
            return []
        else:
            query = self._text(text, index)
        found = rank(vectors, query, top, threshold, key="path", exclude=exclude, tie=components(F.col("path")), f32=True)
        with self.timings.phase("rank"):
            return [(r.score, bytes(r.path)) for r in found.orderBy("rank").collect()]  # top rows

    def search(self, text: str | None = None, image: str | None = None, top: int = DEFAULT_TOP, threshold: float = DEFAULT_THRESHOLD, cache: Cache = Cache.USE) -> list[tuple[float, bytes]]:
        """(score, path below the root) of the best matches. Rebuilds answer from the staged index and install it only
        if that succeeds."""
        if (text is None) == (image is None):
            raise QueryChoiceError()
        if text is not None:
            check_query(text)
        elif not os.path.isfile(image):
            raise QueryImageError(path=image)
        check_top(top)
        check_threshold(threshold)
        ask = lambda vectors, index: self._answer(vectors, index, text, image, top, threshold)
        if cache is Cache.DISABLED:
            fresh = kept(embed(discover(self.spark, self.root), self.root, self.encoder).where("error is null").select("path", "embedding"))
            return ask(fresh, None)
        with self._open().locked() as index:
            if cache is Cache.USE:
                self.refresh(index)
                return ask(index.vectors(), index)
            staged = index.stage()
            try:
                self.refresh(staged)
                answer = ask(staged.vectors(), staged)
                index.install(staged)
                return answer
            finally:
                staged.drop()
