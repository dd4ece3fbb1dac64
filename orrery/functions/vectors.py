"""Vector expressions. Scores exist twice: in doubles, for SQL parity, and in sequential 32-bit floats, bit for bit as a
loop of multiply and add would give them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.contracts import DIM, NORM_TOLERANCE


def literal(vector) -> Column:
    """A vector as one folded literal, so that a single query needs no join."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_f32(a: Column, b: Column) -> Column:
    """Inner product in floats, each product and sum rounded."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("float") * y.cast("float")).cast("float")), F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def norm_f32(a: Column) -> Column:
    return F.sqrt(dot_f32(a, a)).cast("float")


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def normalise(a: Column, dim: int = DIM) -> Column:
    """Fresh model output to unit length in floats; null if of another length, not finite, or next to zero."""
    n = norm_f32(a)
    usable = (F.size(a) == dim) & finite(a) & (n > float(np.finfo(np.float32).eps)) & (n < float("inf"))
    return F.when(usable, F.transform(a, lambda x: (x.cast("float") / n).cast("float")))


def is_stored(a: Column, dim: int = DIM) -> Column:
    """Whether a stored vector has its length, is finite and of unit length within the tolerance."""
    return F.coalesce((F.size(a) == dim) & finite(a) & (F.abs(norm_f32(a) - F.lit(1.0).cast("float")) <= F.lit(NORM_TOLERANCE).cast("float")), F.lit(False))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def from_blob(blob: pa.Array) -> pa.Array:
    """Little-endian floats to an array; null if the bytes are none or not whole floats."""
    size = pc.fill_null(pc.binary_length(blob), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = (size > 0) & (size % 4 == 0)
    whole = pc.if_else(pa.array(good), blob, pa.scalar(b"", blob.type))
    at = np.concatenate([[0], np.cumsum(np.where(good, size // 4, 0))]).astype(np.int32)
    values = np.frombuffer(b"".join(x.as_buffer() for x in whole), "<f4")
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.float32)), mask=pa.array(~good))


@F.arrow_udf(T.BinaryType())
def to_blob(vector: pa.Array) -> pa.Array:
    """An array of floats as little-endian bytes."""
    size = pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = vector.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
    at = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(vector), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])
    return pc.if_else(vector.is_valid(), whole, pa.scalar(None, pa.binary()))
