"""Column expressions on vectors: quantising, squared L2, distance tables, asymmetric distances, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as BIGINT: distances between such vectors are exact."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def l2sqr(a: Column, b: Column) -> Column:
    """Squared L2 of two integer vectors, exact."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def l2sqr_float(a: Column, b: Column) -> Column:
    """Squared L2 of two floating vectors in double, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2sqr_mixed(typed: Column, floats: Column, scale: int = 256) -> Column:
    """Squared L2 of a quantised vector, brought back to floating numbers, and a floating one, in double, summed from the left."""
    return l2sqr_float(F.transform(typed, lambda x: x.cast("double") / F.lit(float(scale))), floats)


def unrolled_l2sqr(a: Column, b: Column, dims: int) -> Column:
    """Squared L2 for a fixed number of dimensions, which stays within generated code."""
    total = None
    for i in range(dims):
        d = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        total = d * d if total is None else total + d * d
    return total


def subvector(v: Column, sub: Column, width: int) -> Column:
    return F.slice(v, sub * width + 1, F.lit(width))


def adc(lut: Column, code: Column) -> Column:
    """Sum over sub-spaces of lut[sub][code[sub]]."""
    return F.aggregate(F.zip_with(lut, code, lambda row, c: F.get(row, c)), F.lit(0).cast("long"), lambda s, x: s + x)


def adc_unrolled(lut: Column, code: Column, m: int) -> Column:
    """adc() for a known number of sub-spaces, which stays within generated code."""
    total = None
    for i in range(m):
        x = F.get(F.get(lut, F.lit(i)), F.get(code, F.lit(i)))
        total = x if total is None else total + x
    return total


def default_pq_m(dims: int) -> int:
    """Sub-spaces of a product quantizer: an eighth of the dimensions, else a fourth, a half, or all."""
    return next(dims // k for k in (8, 4, 2, 1) if dims % k == 0)


def log_bucket(us: Column, growth: float = 1.05, most: int = 379) -> Column:
    """Bucket of a latency histogram: 0 up to 1, then one per factor `growth`."""
    return F.when(us <= 1, F.lit(0)).otherwise(F.least(F.floor(F.ln(us) / F.lit(_ln(growth))).cast("int") + 1, F.lit(most))).cast("int")


def _ln(x: float) -> float:
    import math

    return math.log(x)
