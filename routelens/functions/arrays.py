"""Array helpers on columns: distances, padding, concatenation, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_distance(a, b) -> Column:
    """Euclidean distance of two equal-length numeric arrays."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def pad_to(arr, length) -> Column:
    """Pad by repeating the last element up to ``length``."""
    a = _c(arr)
    n = F.size(a)
    length = length if isinstance(length, Column) else F.lit(length)
    return F.when(n >= length, a).otherwise(
        F.concat(a, F.array_repeat(F.element_at(a, -1), (length - n).cast("int"))))


def concat_valid(a, n, b, m=None) -> Column:
    """Valid part of ``a`` (first n) followed by the valid part of ``b``."""
    a, b = _c(a), _c(b)
    n = n if isinstance(n, Column) else F.lit(n)
    head = F.slice(a, 1, n.cast("int"))
    tail = b if m is None else F.slice(b, 1, (m if isinstance(m, Column) else F.lit(m)).cast("int"))
    return F.concat(head, tail)


def valid_mask(length, valid_len) -> Column:
    """booleans i < valid_len for i in 0..length-1."""
    L = length if isinstance(length, Column) else F.lit(length)
    v = valid_len if isinstance(valid_len, Column) else F.lit(valid_len)
    return F.transform(F.sequence(F.lit(0), L - 1), lambda i: i < v)
