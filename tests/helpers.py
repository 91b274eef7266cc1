"""Brute-force references used by the tests (plain Python loops)."""

import datetime as dt
import math

EPOCH = dt.datetime(1970, 1, 1)


def hav(lng1, lat1, lng2, lat2):
    lng1, lat1, lng2, lat2 = map(math.radians, (lng1, lat1, lng2, lat2))
    a = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * math.asin(min(1.0, math.sqrt(a))) * 6371000.0


def azimuth(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = (v * math.pi / 180 for v in (lat1, lon1, lat2, lon2))
    y = math.sin(lon2 - lon1) * math.cos(lat2)
    x = math.cos(lat1) * math.sin(lat2) - math.sin(lat1) * math.cos(lat2) * math.cos(lon2 - lon1)
    return (math.atan2(y, x) * 180 / math.pi + 360.0) % 360.0


def motion_loop(points):
    """points: list of (seconds, lng, lat) in order -> list of (speed, acc, heading)."""
    n = len(points)
    speed = [0.0] * n
    acc = [0.0] * n
    head = [0.0] * n
    for i in range(1, n):
        s, lng, lat = points[i]
        ps, plng, plat = points[i - 1]
        d = s - ps
        if lng is None or plng is None:
            speed[i] = None if d > 0 else 0.0
            acc[i] = None if d > 0 else 0.0
            head[i] = None
            continue
        if d > 0:
            speed[i] = max(min(hav(lng, lat, plng, plat) / d, 33.33), -33.33)
            if speed[i - 1] is None:
                acc[i] = None
            else:
                acc[i] = max(min((speed[i] - speed[i - 1]) / d, 3.0), -3.0)
        head[i] = azimuth(lng, lat, plng, plat)
    if n > 1:
        head[0] = head[1]
    return list(zip(speed, acc, head))


def close(a, b, tol=1e-6):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
