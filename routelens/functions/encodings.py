"""Trigonometric encodings as array columns (fixed, untrained constants)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cosine_encoding(x, d: int) -> Column:
    """sqrt(1/d) * cos(x * w_i), w_i = 10^-(9 i/(d-1)), bias 0 (initial values)."""
    step = 9.0 / (d - 1) if d > 1 else 0.0
    scale = math.sqrt(1.0 / d)
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                       lambda i: F.lit(scale) * F.cos(_c(x) * F.pow(F.lit(10.0), -i * F.lit(step))))


def position_encoding(pos, d: int) -> Column:
    """P20: sin at even dims, cos at odd dims, div = exp(-(2j) ln(10000)/d)."""
    k = math.log(10000.0) / d
    return F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda i: F.when(i % 2 == 0, F.sin(_c(pos) * F.exp(-(i - i % 2) * F.lit(k))))
                   .otherwise(F.cos(_c(pos) * F.exp(-(i - i % 2) * F.lit(k)))))


def time_encoding(t, d: int) -> Column:
    """concat(sin(t w), cos(t w)), w_j = exp(-j ln(10000)/(d/2 - 1))."""
    half = d // 2
    k = math.log(10000.0) / (half - 1) if half > 1 else 0.0
    js = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(js, lambda j: F.sin(_c(t) * F.exp(-j * F.lit(k)))),
                    F.transform(js, lambda j: F.cos(_c(t) * F.exp(-j * F.lit(k)))))
