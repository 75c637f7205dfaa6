"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 1e-12, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def softmax(v: Column) -> Column:
    """Softmax with the greatest value as shift."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / total(e))


def log_sum_exp(v: Column) -> Column:
    return F.array_max(v) + F.log(total(F.transform(v, lambda x: F.exp(x - F.array_max(v)))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(v: Column) -> Column:
    """Place of the greatest value, the first of equals, from 0."""
    return F.array_position(v, F.array_max(v)) - 1


def masked_softmax(v: Column, mask: Column) -> Column:
    """Softmax over allowed places; the others get (nearly) nothing."""
    return softmax(F.zip_with(v, mask, lambda x, m: F.when(m, x).otherwise(x - 1e9)))


def hash_code(text: Column) -> Column:
    """A string's 31-based polynomial hash, wrapped to signed 32 bits."""
    h = F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(4294967296)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)


def hash_embedding(text: Column, size: int = 8) -> Column:
    """A deterministic stand-in for an embedding: thousandths of multiples of the text's hash, with 32-bit overflow."""

    def part(i: int) -> Column:
        wide = F.pmod(hash_code(text) * (i + 1), F.lit(4294967296))
        signed = F.when(wide >= 2147483648, wide - 4294967296).otherwise(wide)
        return (signed % 1000) / F.lit(1000.0)

    return F.array(*[part(i) for i in range(size)])
