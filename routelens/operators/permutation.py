"""Keyed permutations of 0..n-1, a place at a time.

A Feistel network over pairs (left, right), left < a = ceil(sqrt(n)) and right
< b = ceil(n / a): each round adds to one half, modulo its size, a value that
depends on the other half and on the round's key. So every key gives a
permutation of 0..a*b-1, and the first k of its places that are below n are k
distinct places, drawn as from one shuffle of 0..n-1; at most a - 1 places are
n or more. The round's value is two squarings modulo a prime: whole numbers
that fit a long, so that any SQL engine can follow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
PRIME = 2**31 - 1


def round_keys(seed: int, column: str) -> Column:
    """The keys of a row's rounds: 28 bits each, of md5 over the seed, the round and ``column``."""
    one = lambda r: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(r)), F.col(column).cast("string"))), 1, 7), 16, 10)
    return F.array(*[one(r).cast("long") for r in range(ROUNDS)])


def sides(total: Column) -> tuple[Column, Column]:
    """a and b for n = ``total`` (at least 1)."""
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    return a, F.floor((total + a - 1) / a).cast("long")


def domain(total: Column) -> Column:
    """a * b: the number of places that the network permutes."""
    a, b = sides(total)
    return a * b


def place_of(step: str, total: str, keys: str) -> Column:
    """The place that a row's keys give to ``step`` in 0..domain(total)-1; places
    of ``total`` or more mean nothing and are for the caller to skip."""
    a, b = sides(F.col(total))

    def value(x: Column, key: Column) -> Column:
        first = F.pmod(x + key, F.lit(PRIME))
        second = F.pmod(first * first + key, F.lit(PRIME))
        return F.pmod(second * second, F.lit(PRIME))

    def turn(s: Column, i: Column) -> Column:
        key = F.element_at(keys, i + 1)
        return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + value(s["r"], key), a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] + value(s["l"], key), b).alias("r")))

    start = F.struct(F.pmod(F.col(step), a).alias("l"), F.floor(F.col(step) / a).cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda s: s["r"] * a + s["l"])
