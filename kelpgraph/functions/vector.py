"""Vector expressions."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, in double."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def usable(a: Column, dim: Column) -> Column:
    """A vector of the stated length, without null and NaN, that is not all zero."""
    sound = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(a, lambda x: x != 0)
    return F.coalesce((F.size(a) == dim) & sound, F.lit(False))


def to_bytes(vector: list[float]) -> bytes:
    """Little-endian float32 bytes, the form of exports."""
    return struct.pack(f"<{len(vector)}f", *vector)


def from_bytes(raw: bytes) -> list[float]:
    """The vector of such bytes; a last part of a number is left out."""
    return list(struct.unpack(f"<{len(raw) // 4}f", raw[: len(raw) // 4 * 4]))
