"""Schemas, limits and errors that all modules agree on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DIM = 512
NORM_TOLERANCE = 1e-3
FORMAT_VERSION = 3
INFERENCE_BATCH, COMMIT_BATCH, INGEST_BATCH = 8, 256, 1 << 14  # images a model run, rows a commit at least, files a micro-batch
DEFAULT_TOP, DEFAULT_THRESHOLD = 5, 0.25

# The last three are DDL strings.
FILES = T.StructType([T.StructField("path", T.BinaryType(), False), T.StructField("mtime_ns", T.LongType()), T.StructField("size", T.LongType())])
IMAGES = T.StructType([*FILES.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
QUERIES = T.StructType([T.StructField("query", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CHANGES = T.StructType([T.StructField("op", T.StringType(), False), *IMAGES.fields])
QUALITY = "id string, kind string, intent string, relevant array<string>, results array<struct<path:string,score:double>>"
SAMPLES = "scenario string, side string, n int, seconds double, rss_bytes long"
PHASES = "phase string, elapsed_ms double, invocations long"


class EngineError(Exception):
    """Base of all errors raised here."""


class ArgumentError(EngineError, ValueError):
    """A request that no job should start for."""


class ScanError(EngineError):
    """The root or an entry below it cannot be read, or has a time before 1970."""


class IndexError_(EngineError):
    """The index location, format or content is unusable."""


class InvalidVectorError(IndexError_):
    """A stored vector breaks its contract."""


class ImageError(EngineError):
    """One image cannot be prepared; ingestion skips it."""


@dataclass(frozen=True)
class Contract:
    """Versions of what vectors mean; a change of either clears the vectors of its side alone."""

    image: str
    query: str
    dim: int = DIM
