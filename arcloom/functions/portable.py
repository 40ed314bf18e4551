"""Column functions that other engines can repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1_000_033


def draw(a: Column, b: Column | int = 0, seed: int = 0) -> Column:
    """A number below MODULUS from integers, the same wherever 64-bit integer arithmetic is."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a * 1_000_003 + b * 7_919 + F.lit(seed * 104_729)) * 69_069 + 12_345) % MODULUS


def draw_sql(a: str, b: str = "0", seed: int = 0) -> str:
    return f"(((CAST({a} AS BIGINT)) * 1000003 + CAST({b} AS BIGINT) * 7919 + {seed * 104729}) * 69069 + 12345) % {MODULUS}"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda v: v * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """x W + b for given weights (rows are inputs), as one array."""
    outs = len(weights[0])
    terms = [sum((F.get(x, i) * F.lit(float(weights[i][o])) for i in range(len(weights))), F.lit(float(bias[o] if bias else 0.0))) for o in range(outs)]
    return F.array(*terms)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def long_form(df, vector: str = "x", key: tuple[str, ...] = ("id",)):
    """One row for each place of a vector."""
    return df.select(*key, F.posexplode(vector).alias("pos", "v"))
