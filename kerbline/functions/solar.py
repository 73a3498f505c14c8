"""Sun position as column expressions: the low-precision solar algorithm (Meeus, as published by NOAA) with refraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def position(lat: Column, lon: Column, epoch_s: Column) -> tuple[Column, Column]:
    """Azimuth (degrees from north) and apparent elevation (degrees) at a time given as seconds since 1970 UTC."""
    sin, cos = (lambda x: F.sin(F.radians(x))), (lambda x: F.cos(F.radians(x)))
    t = (epoch_s / 86400.0 + 2440587.5 - 2451545.0) / 36525.0
    l0 = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    m = 357.52911 + t * (35999.05029 - 0.0001537 * t)
    e = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    c = sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289
    node = 125.04 - 1934.136 * t
    seen = l0 + c - 0.00569 - 0.00478 * sin(node)
    tilt = 23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(node)
    decl = F.degrees(F.asin(sin(tilt) * sin(seen)))
    y = F.pow(F.tan(F.radians(tilt / 2)), 2)
    eqt = 4 * F.degrees(y * sin(2 * l0) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l0) - 0.5 * y * y * sin(4 * l0) - 1.25 * e * e * sin(2 * m))
    minutes = F.pmod(F.pmod(epoch_s, F.lit(86400.0)) / 60.0 + eqt + 4 * lon, F.lit(1440.0))
    hour = minutes / 4 - 180.0
    cz = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin(lat) * sin(decl) + cos(lat) * cos(decl) * cos(hour)))
    true = 90.0 - F.degrees(F.acos(cz))
    tan = F.tan(F.radians(true))
    low = (1735.0 + true * (-518.2 + true * (103.4 + true * (-12.79 + true * 0.711)))) / 3600.0
    bent = F.when(true > 85.0, 0.0).when(true > 5.0, (58.1 / tan - 0.07 / F.pow(tan, 3) + 0.000086 / F.pow(tan, 5)) / 3600.0).when(true > -0.575, low).otherwise(-20.772 / tan / 3600.0)
    azimuth = F.pmod(F.degrees(F.atan2(sin(hour), cos(hour) * sin(lat) - F.tan(F.radians(decl)) * cos(lat))) + 180.0, F.lit(360.0))
    return azimuth, true + bent


def glare(axis: Column, elevation: Column) -> Column:
    """cos^2 of the angle to the road's axis times 1 - sin(elevation); 0 by night and straight overhead."""
    raw = F.pow(F.cos(F.radians(axis)), 2) * (1.0 - F.sin(F.radians(elevation)))
    return F.when(elevation < 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
