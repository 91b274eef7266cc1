"""Time columns that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
DAY = 86400


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts="time") -> Column:
    """Seconds since 1970-01-01 of a naive timestamp, as double."""
    col = _c(ts).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), col) / F.lit(1e6)


def time_of_day(seconds="seconds") -> Column:
    """Fraction of the day, seconds % 86400 / 86400."""
    return F.pmod(_c(seconds), F.lit(float(DAY))) / F.lit(float(DAY))


def weekday(seconds="seconds") -> Column:
    """Monday = 0 ... Sunday = 6 (1970-01-01 was a Thursday)."""
    return F.pmod(F.floor(_c(seconds) / DAY) + 3, F.lit(7)).cast("int")


def hour(seconds="seconds") -> Column:
    """Hour of day 0..23."""
    return F.floor(F.pmod(_c(seconds), F.lit(float(DAY))) / 3600).cast("int")
