"""One class for each cause of failure, below the bases in contracts.py, with what it is about as attributes."""

from __future__ import annotations

import math

from orrery.contracts import ArgumentError, EngineError, IndexError_, InvalidVectorError, NORM_TOLERANCE, ScanError


class _Told:
    """An error whose message is its class's text filled with its arguments, which are attributes as well."""

    text = ""

    def __init__(self, **about):
        self.about = about
        super().__init__(self.text.format(**about))

    def __getattr__(self, name):
        about = self.__dict__.get("about", {})
        if name in about:
            return about[name]
        raise AttributeError(name)

    def __reduce__(self):  # they come back from tasks whole
        return _again, (type(self), self.about)


def _again(kind, about):
    return kind(**about)


class BlankQueryError(_Told, ArgumentError):
    text = "the query is blank"


class ThresholdError(_Told, ArgumentError):
    text = "the threshold must be a number from -1 to 1, not {value}"


class TopError(_Told, ArgumentError):
    text = "top must be 1 or more, not {value}"


class QueryChoiceError(_Told, ArgumentError):
    text = "give a text or an image, and not both"


class QueryImageError(_Told, ArgumentError):
    text = "{path} is not a file"


class RootMissingError(_Told, ScanError):
    text = "cannot resolve {path}: {cause}"


class RootKindError(_Told, ScanError):
    text = "{path} is not a directory"


class FolderError(_Told, ScanError):
    text = "cannot list {path!r}: {cause}"


class EntryError(_Told, ScanError):
    text = "cannot read {path!r}: {cause}"


class EpochError(_Told, ScanError):
    text = "{path!r} was modified before 1970 ({mtime_ns} ns)"


class IndexPathError(_Told, IndexError_):
    text = "{path}: {cause}"


class FormatError(_Told, IndexError_):
    text = "format {found} is newer than {known}"


class RootMismatchError(_Told, IndexError_):
    text = "the index belongs to {bound}, not to {asked}"


class ManifestError(_Told, IndexError_):
    text = "the manifest is broken: {cause}"


class MetadataError(_Told, IndexError_):
    text = "the manifest has no {key}"


class DuplicateChangeError(_Told, IndexError_):
    text = "{path!r} has {n} changes in one commit"


class DimensionError(_Told, InvalidVectorError):
    text = "{path!r}: expected {expected} values, got {actual}"


class MissingVectorError(_Told, InvalidVectorError):
    text = "{path!r} has no vector"


class NonFiniteError(_Told, InvalidVectorError):
    text = "{path!r}: value {place} is not finite"


class NormError(_Told, InvalidVectorError):
    text = "{path!r}: length {norm} is not 1"


class ModelShapeError(_Told, EngineError):
    text = "the model gave shape {shape} for {n} inputs"


class PathEncodingError(_Told, EngineError):
    text = "the path {path!r} is not UTF-8"


class FormError(_Told, EngineError):
    text = "the form is one of {known}, not {form}"


class SharedFolderError(_Told, EngineError):
    text = "spark.checkpoint.dir must name a folder that all executors share (master {master})"


class CorpusError(_Told, EngineError):
    text = "{cause}"


def vector_error(path: bytes | str, vector: list | None, dim: int) -> InvalidVectorError | None:
    """What is wrong with a vector that is to be stored."""
    if vector is None:
        return MissingVectorError(path=path)
    if len(vector) != dim:
        return DimensionError(path=path, expected=dim, actual=len(vector))
    for k, x in enumerate(vector):
        if x is None or not math.isfinite(x):
            return NonFiniteError(path=path, place=k)
    norm = math.sqrt(sum(x * x for x in vector))
    return NormError(path=path, norm=norm) if abs(norm - 1) > NORM_TOLERANCE * (1 - 1e-3) else None


def check_query(text: str) -> str:
    if not text.strip():
        raise BlankQueryError()
    return text


def check_threshold(value: float) -> float:
    if not (math.isfinite(value) and -1.0 <= value <= 1.0):
        raise ThresholdError(value=value)
    return value


def check_top(value: int) -> int:
    if value < 1:
        raise TopError(value=value)
    return value
