"""Distances, bearings, clipping and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine(lng1, lat1, lng2, lat2) -> Column:
    """Great-circle distance in metres (radius 6371 km)."""
    lng1, lat1, lng2, lat2 = (F.radians(_c(x)) for x in (lng1, lat1, lng2, lat2))
    a = (F.pow(F.sin((lat2 - lat1) / 2), 2)
         + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lng2 - lng1) / 2), 2))
    # least(1, .) keeps rounding above 1 out of asin; NULL stays NULL.
    root = F.sqrt(a)
    return 2 * F.asin(F.when(root > 1, F.lit(1.0)).otherwise(root)) * F.lit(EARTH_RADIUS_M)


def azimuth(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees in [0, 360) from point 1 to point 2."""
    lat1, lon1, lat2, lon2 = (_c(v) * F.lit(math.pi) / F.lit(180.0) for v in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    # atan2 in degrees lies in [-180, 180], so +360 is positive and % is exact.
    return (F.atan2(y, x) * F.lit(180.0) / F.lit(math.pi) + F.lit(360.0)) % F.lit(360.0)


def clip(col, lo, hi) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (least/greatest alone skip NULL)."""
    c = _c(col)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.least(c, hi), lo))


def grid_index(value, vmin, vmax, n) -> Column:
    """clip(ceil((v - min) / (max - min) * n) - 1, 0, n - 1) as long."""
    span = _c(vmax) - _c(vmin)
    raw = F.ceil(F.try_divide(_c(value) - _c(vmin), span) * _c(n)) - 1
    return clip(raw, F.lit(0), _c(n) - 1).cast("long")
