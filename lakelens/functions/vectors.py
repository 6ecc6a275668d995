"""Vector functions: cosine similarity in the JVM and a deterministic offline embedding (RK1, RK7, RK8)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, low: float = -1.0) -> Column:
    """Clamped to [low, 1]; 0 for a zero norm or different lengths."""
    scale = norm(a) * norm(b)
    value = F.least(F.lit(1.0), F.greatest(F.lit(low), dot(a, b) / F.nullif(scale, F.lit(0.0))))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def hash_embedding(text: Column, dims: int) -> Column:
    """Unit vector from the bytes of the text's SHA-256, cycled and mixed with the position; rounded to six digits."""

    def raw(digest: Column) -> Column:
        byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(i).bitwiseXOR((i % 256).cast("int")) / 127.5 - 1.0)

    def unit(pair: Column) -> Column:
        scaled = F.transform(pair["raw"], lambda x: F.round(x / pair["length"], 6))
        return F.when(pair["length"] == 0, F.array_repeat(F.lit(dims**-0.5), dims)).otherwise(scaled)

    return let(let(F.sha2(text, 256), raw), lambda r: let(F.struct(r.alias("raw"), norm(r).alias("length")), unit))


def hash_vectors(texts: list[str], dims: int) -> list[list[float]]:
    """The same for a batch of texts, as a model gives it."""
    at = np.arange(dims)
    out = []
    for text in texts:
        raw = (np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)[at % 32] ^ (at % 256)) / 127.5 - 1.0
        length = np.sqrt(np.cumsum(raw * raw)[-1])  # added in order, as columns are
        out.append((np.round(raw / length, 6) if length else np.full(dims, dims**-0.5)).tolist())
    return out
