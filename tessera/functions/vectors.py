"""Vector and bit functions as columns.

Scalar forms are built-in expressions; signatures, which multiply every vector
with every plane, run as one Arrow batch multiplication per batch, without a
shuffle and in exact 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The first 32 primes, bases of the radical inverse.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109, 113, 127, 131)
SCALE = 100_000_000
# Fixed value: step between the bases of neighbouring planes.
BASE_STEP = 7


def radical_inverse(index: int, base: int) -> float:
    value, digit = 0.0, 1.0
    while index:
        index, rest = divmod(index, base)
        digit /= base
        value += rest * digit
    return value


def halton_planes(dimension: int, planes: int = 32) -> np.ndarray:
    """planes x dimension hyperplanes, unit length, as integers scaled by SCALE."""
    raw = np.array([[2 * radical_inverse(p * dimension + d + 1, PRIMES[(d + BASE_STEP * p) % len(PRIMES)]) - 1 for d in range(dimension)] for p in range(planes)])
    return np.round(raw / np.linalg.norm(raw, axis=1, keepdims=True) * SCALE).astype(np.int64)


def quantize_int8(vector: str | Column) -> Column:
    """clip(127 x, -128, 127), truncated toward zero."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), x.cast("double") * 127)).cast("int"))


def l2_normalize(vector: str | Column) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x).cast("double"))


def cosine(score: Column, query_norm: Column) -> Column:
    """Score over query norm times 127, clamped; 0 for a zero query."""
    return F.when(query_norm > 1e-6, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / (query_norm * 127)))).otherwise(F.lit(0.0))


def binary_code(v: str | Column, dimension: int) -> Column:
    """Sign bits as 32-bit words in longs: bit d of the code is v[d] >= 0."""
    words = [F.aggregate(F.transform(F.slice(v, w * 32 + 1, 32), lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), i.cast("double")).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x) for w in range(-(-dimension // 32))]
    return F.array(*words)


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def adc(query: str | Column, v: str | Column) -> Column:
    """Sum of the query's components, each with the sign bit of the vector's."""
    return F.aggregate(F.zip_with(query, v, lambda q, x: F.when(x >= 0, q).otherwise(-q).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def signs(v: str | Column) -> Column:
    """1 for every component that is not negative, else -1: the sign bits as a vector."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1))


def mean_pooled(vectors: str | Column, mask: str | Column) -> Column:
    """Mean of the vectors of an array whose mask is 1, unit length; zeros where none is."""
    width = F.size(F.element_at(vectors, 1))
    kept = F.filter(F.arrays_zip(F.col(vectors).alias("v"), F.col(mask).alias("m")), lambda t: t["m"] == 1)
    start = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, start, lambda s, t: F.zip_with(s, t["v"], lambda a, b: a + b))
    return l2_normalize(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def centred(vectors: pd.Series, centre: np.ndarray | None) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.int64)
    return x if centre is None else x - centre


def signature(planes: np.ndarray, centre: np.ndarray | None = None):
    """UDF of an int vector: bit i is set where the vector less the centre is on the positive side of plane i."""
    powers = 1 << np.arange(len(planes), dtype=np.int64)

    @pandas_udf("long")
    def run(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="int64")
        side = centred(vectors, centre) @ planes.T >= 0
        return pd.Series(side.astype(np.int64) @ powers)

    return run


def projections(planes: np.ndarray, centre: np.ndarray | None = None):
    """UDF of an int vector: its exact products, less the centre, with all planes."""

    @pandas_udf("array<long>")
    def run(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(centred(vectors, centre) @ planes.T))

    return run
