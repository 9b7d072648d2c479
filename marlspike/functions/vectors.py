"""Vector expressions over array columns; components are widened to double first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "l2sq", "cos", "ip")


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm_sq(v: Column) -> Column:
    return _sum(F.transform(_double(v), lambda x: x * x))


def l2_sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Distance of two vectors: l2, l2sq, cos (1 - cosine) or ip (1 - inner product)."""
    if metric == "l2":
        return F.sqrt(l2_sq(a, b))
    if metric == "l2sq":
        return l2_sq(a, b)
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "cos":
        return 1 - dot(a, b) / F.nullif(F.sqrt(norm_sq(a)) * F.sqrt(norm_sq(b)), F.lit(0.0))
    raise ValueError(f"metric is one of {METRICS}")


def valid_vector(v: Column, dimension: int | None = None) -> Column:
    """Not null, of the right length, every component finite."""
    ok = v.isNotNull() & ~F.exists(_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ok if dimension is None else ok & (F.size(v) == dimension)


def valid_distance(d: Column) -> Column:
    return d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < float("inf"))


def sign_code(v: Column, dimension: int) -> Column:
    """Binary code of a vector: 64-bit words, bit i set where component i is positive."""

    def word(k: int) -> Column:
        part = F.slice(v, 64 * k + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.call_function("shiftleft", F.expr("1L"), i.cast("int")))
        return F.aggregate(bits, F.expr("0L"), lambda a, b: a.bitwiseOR(b))

    return F.array(*[word(k) for k in range((dimension + 63) // 64)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def length_vector(text: Column, dimension: int) -> Column:
    """The test embedder that repeats a text's length."""
    return F.array_repeat(F.length(text).cast("float"), dimension)
