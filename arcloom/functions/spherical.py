"""Spherical Bessel functions and zonal harmonics: tables made on the driver, values as column expressions."""

from __future__ import annotations

from math import cos, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def bessel(order: int, x: float) -> float:
    """j_order(x), by upward recurrence."""
    a, b = sin(x) / x, sin(x) / x**2 - cos(x) / x
    if not order:
        return a
    for n in range(1, order):
        a, b = b, (2 * n + 1) / x * b - a
    return b


def zeros(orders: int, count: int) -> list[list[float]]:
    """The first `count` zeros of j_0 .. j_(orders-1); those of each order lie between those of the order below."""
    rows = [[pi * (k + 1) for k in range(count + orders)]]
    for n in range(1, orders):
        row = []
        for lo, hi in zip(rows[-1], rows[-1][1:], strict=False):
            f = bessel(n, lo)
            for _ in range(80):
                mid = (lo + hi) / 2
                if (g := bessel(n, mid)) * f > 0:
                    lo, f = mid, g
                else:
                    hi = mid
            row.append((lo + hi) / 2)
        rows.append(row)
    return [r[:count] for r in rows]


def bessel_column(order: int, x: Column) -> Column:
    a, b = F.sin(x) / x, F.sin(x) / (x * x) - F.cos(x) / x
    if not order:
        return a
    for n in range(1, order):
        a, b = b, (2 * n + 1) / x * b - a
    return b


def legendre_column(order: int, c: Column) -> Column:
    a, b = F.lit(1.0), c
    if not order:
        return a
    for n in range(1, order):
        a, b = b, ((2 * n + 1) * c * b - n * a) / (n + 1)
    return b


def spherical_basis(dist: Column, angle: Column, cutoff: float, orders: int, count: int) -> Column:
    """For each order and zero: the normalised radial function times the zonal harmonic of the angle. dist > 0."""
    out = []
    for n, row in enumerate(zeros(orders, count)):
        harmonic = legendre_column(n, F.cos(angle)) * sqrt((2 * n + 1) / (4 * pi))
        for z in row:
            scale = sqrt(2 / bessel(n + 1, z) ** 2)
            out.append(bessel_column(n, dist / cutoff * z) * scale * harmonic)
    return F.array(*out)
