"""Vector expressions and the deterministic hashing encoder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.numeric import runs

# Tokens and vector elements that are counted at a time.
RUN = 500_000


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(vector: Column) -> Column:
    """Unit-length copy; the norm is read once per row, the zero vector stays zero."""
    scaled = F.transform(
        F.array(F.struct(norm(vector).alias("n"), vector.alias("v"))),
        lambda s: F.transform(s["v"], lambda x: F.coalesce(F.try_divide(x.cast("double"), s["n"]), F.lit(0.0))),
    )
    return F.get(scaled, 0)


def require_dimension(vector: Column, dimension: int) -> Column:
    message = F.format_string("vector has %d dimensions, expected %d", F.size(vector), F.lit(dimension))
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(message))


def slot(token: str, dimension: int) -> tuple[int, float]:
    """Bucket and sign of a token: first and second 32 bits of its MD5."""
    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % dimension, 1.0 - 2.0 * (int(digest[8:16], 16) % 2)


def hash_encode(batch: pa.Array, dimension: int) -> np.ndarray:
    """Signed feature hashing of token lists, one unit vector per list. Lists are counted in runs of bounded size."""
    out, known = np.zeros((len(batch), dimension)), {}
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for at, end in runs(sizes + dimension, RUN):
        encoded = batch.slice(at, end - at).flatten().dictionary_encode()
        slots = [known.get(token) or known.setdefault(token, slot(token, dimension)) for token in encoded.dictionary.to_pylist()]
        part = out[at:end]
        if slots:
            bucket, sign = (np.array(x) for x in zip(*slots))
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            cells = np.repeat(np.arange(end - at) * dimension, sizes[at:end]) + bucket[codes]
            part += np.bincount(cells, sign[codes], part.size).reshape(part.shape)
        length = np.sqrt((part * part).sum(axis=1, keepdims=True))
        np.divide(part, length, out=part, where=length > 0)
        if len(known) > RUN:
            known.clear()
    return out


def hashing_encoder(dimension: int):
    """Encoder: token-list column in, ARRAY<DOUBLE> of the given dimension out."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def encode(tokens: pa.Array) -> pa.Array:
        vectors = hash_encode(tokens, dimension)
        offsets = np.arange(0, vectors.size + 1, dimension, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    return encode
