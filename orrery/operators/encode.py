"""Embedding of files through an injected encoder."""

from __future__ import annotations

import hashlib
import time
from threading import Lock
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.contracts import INFERENCE_BATCH, ImageError
from orrery.errors import ModelShapeError
from orrery.functions.codecs import decode
from orrery.operators.reconcile import numbered, place
from orrery.operators.sessions import open_session
from orrery.timing import milliseconds


class Encoder(Protocol):
    """images() gives a row of floats for each prepared file, or raises ImageError from prepare() for one file."""

    def prepare(self, path: bytes) -> object: ...

    def images(self, prepared: list) -> np.ndarray: ...

    def text(self, query: str) -> np.ndarray: ...


def unit(x: np.ndarray) -> np.ndarray:
    """Rows to unit length in floats; a row that is not finite or next to zero is an error."""
    x = np.asarray(x, np.float32)
    n = np.sqrt((x * x).sum(1, dtype=np.float32))
    if not np.isfinite(x).all() or not (n > np.finfo(np.float32).eps).all():
        raise ValueError("the model gave a vector that cannot be normalised")
    return x / n[:, None]


def checked(vectors, n: int) -> np.ndarray:
    """A model's output, which must be one row of floats for each of n inputs, as unit vectors."""
    vectors = np.asarray(vectors)
    if vectors.ndim != 2 or len(vectors) != n or not vectors.shape[1]:
        raise ModelShapeError(shape=vectors.shape, n=n)
    return unit(vectors)


class HashEncoder:
    """A deterministic stand-in for a model: vectors seeded by a file's bytes or a query's text."""

    def __init__(self, dim: int):
        self.dim = dim

    def _vector(self, data: bytes) -> np.ndarray:
        return np.random.default_rng(int.from_bytes(hashlib.sha256(data).digest()[:8], "big")).normal(size=self.dim)

    def prepare(self, path: bytes) -> bytes:
        with open(path, "rb") as f:
            data = f.read()
        if not data or data.startswith(b"corrupt"):
            raise ImageError("the file cannot be decoded")
        return data

    def images(self, prepared: list) -> np.ndarray:
        return np.stack([self._vector(p) for p in prepared])

    def text(self, query: str) -> np.ndarray:
        return self._vector(query.encode())


def pixels(path: bytes, decode=decode) -> np.ndarray:
    """A file's upright pixels as model input."""
    from orrery.functions.images import load, prepare
    from orrery.functions.paths import RAW

    kind = "raw" if path.rpartition(b".")[2].lower().decode("ascii", "replace") in RAW else "standard"
    with open(path, "rb") as f:
        return prepare(load(f.read(), kind, decode))


class PixelEncoder(HashEncoder):
    """Vectors of what a picture shows, coarsely: the means of dim / 3 patches of each channel. No model is needed, so the
    whole way from a file to an answer can be run; text gets seeded numbers."""

    def prepare(self, path: bytes) -> np.ndarray:
        return pixels(path)

    def images(self, prepared: list) -> np.ndarray:
        flat = np.stack([np.concatenate([part.mean(1) for part in np.array_split(p.reshape(3, -1), max(1, self.dim // 3), axis=1)]) for p in prepared])
        return np.concatenate([flat, np.ones((len(flat), self.dim - flat.shape[1]))], 1)


class OnnxEncoder:
    """A vision and a text model with a tokenizer; sessions are opened once in each worker, one model in memory at a time.
    decode turns the bytes of a common format into RGB pixels as they are stored; the one here reads all but WebP and HEIC,
    JPEG slowly. graphs: a folder of each machine for optimised graphs, or none."""

    def __init__(self, vision: str, text: str, tokenizer: str, decode=decode, length: int = 77, graphs: str | None = None):
        self.paths, self.decode, self.length, self.graphs = (vision, text, tokenizer), decode, length, graphs
        self._open, self._lock = {}, Lock()

    def __getstate__(self):
        return self.__dict__ | {"_open": {}, "_lock": None}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_lock": Lock()}

    def _run(self, which: int, data: np.ndarray) -> np.ndarray:
        with self._lock:
            if which not in self._open:
                self._open.clear()  # before the other is opened
                self._open[which] = open_session(self.paths[which], self.graphs)
            session = self._open[which]
            return session.run(None, {session.get_inputs()[0].name: data})[0]

    def prepare(self, path: bytes) -> np.ndarray:
        return pixels(path, self.decode)

    def images(self, prepared: list) -> np.ndarray:
        return self._run(0, np.stack(prepared))

    def tokens(self, query: str) -> np.ndarray:
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(self.paths[2])
        tool.enable_truncation(self.length)
        tool.enable_padding(length=self.length, pad_id=0)
        return np.array([tool.encode(query).ids], np.int64)

    def text(self, query: str) -> np.ndarray:
        return self._run(1, self.tokens(query))[0]


def embed(files: DataFrame, root: str, encoder: Encoder, batch: int = INFERENCE_BATCH) -> DataFrame:
    """files with embedding and error (one of them null), and the milliseconds that the row took to decode and its share of the
    inference. Batches are fixed by byte order of path, whatever the partitioning: a model's vectors may depend on what they
    are batched with. Files are dealt to range partitions once; a task runs the batches that lie inside its partition, and the few
    that lie across an edge of partitions are brought together and run apart. A file that cannot be prepared
    shrinks its batch."""
    base = root.rstrip("/").encode("utf-8", "surrogateescape")
    dealt, ahead = numbered(files, [F.col("path")])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("path").reset_index(drop=True)
        good, prepared, errors, decoding = [], [], [None] * len(rows), []
        for i, path in enumerate(rows["path"]):
            began = time.perf_counter()
            try:
                prepared.append(encoder.prepare(base + b"/" + bytes(path)))
                good.append(i)
            except (ImageError, OSError) as e:
                errors[i] = str(e)
            decoding.append(milliseconds(time.perf_counter() - began))
        vectors: list = [None] * len(rows)
        began = time.perf_counter()
        if good:
            for i, v in zip(good, checked(encoder.images(prepared), len(good))):
                vectors[i] = v
        infer = milliseconds(time.perf_counter() - began) / max(1, len(good))
        took = [infer if e is None else 0.0 for e in errors]
        return rows[["path", "mtime_ns", "size"]].assign(embedding=vectors, error=errors, decode_ms=decoding, infer_ms=took)

    def inside(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            numbers = held["_batch"].to_numpy()
            cut = int(np.searchsorted(numbers, numbers[-1]))  # the last batch may go on
            for _, own in held[:cut].groupby("_batch", sort=False):
                yield run(own)
            held = held[cut:]
        if held is not None and len(held):
            yield run(held)

    schema = "path binary, mtime_ns long, size long, embedding array<float>, error string, decode_ms double, infer_ms double"
    rows = dealt.withColumn("_at", place(ahead)).withColumn("_batch", F.floor(F.col("_at") / batch).cast("long"))
    cut = sorted({n // batch for n, _ in ahead.values() if n % batch})  # batches across an edge, one a partition at most
    across = F.col("_batch").isin(cut) if cut else F.lit(False)
    whole = rows.where(~across).repartition(max(1, len(ahead)), "_p").sortWithinPartitions("_at").mapInPandas(inside, schema)
    return whole.unionByName(rows.where(across).groupBy("_batch").applyInPandas(lambda own: run(own), schema)) if cut else whole
