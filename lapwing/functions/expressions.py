"""Column expressions that several operators share, and fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per second of a mile an hour, standard gravity, metres of a degree of latitude.
MPH, G, M_PER_DEG = 0.44704, 9.80665, 111132.0
#: Scale of a median absolute deviation that estimates a standard deviation.
MAD_SCALE = 1.4826
#: Fixed values of section timing: floor of speed, correlation of crossing errors, driven band, residual band, tiers.
V_FLOOR, RHO, BAND_PER_RAD, BAND_BASE, RESIDUAL_BAND, TIER_A, TIER_B = 8.0, 0.66, 3.2, 10.3, 10.2, 0.10, 0.30
#: Fixed value: seconds by which trajectory and odometer may differ without an offset.
SPEED_SLACK = 0.2


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.when(b != 0, a / b)


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def to_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres about a centre, on a plane."""
    return (lon - lon0) * M_PER_DEG * F.cos(F.radians(lat0)), (lat - lat0) * M_PER_DEG


def drift_corrected(lat: Column, lon: Column, north: Column, east: Column, lat0: Column) -> tuple[Column, Column]:
    """A place moved back by a lap's drift in metres; a lap without drift stays."""
    return lat - F.coalesce(north, F.lit(0.0)) / M_PER_DEG, lon - F.coalesce(east, F.lit(0.0)) / (M_PER_DEG * F.cos(F.radians(lat0)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def huber(r: Column, k) -> Column:
    k = F.lit(k)
    return F.when(F.abs(r) > k, k / F.abs(r)).otherwise(F.lit(1.0))


def tricube(u: Column) -> Column:
    return F.when(F.abs(u) < 1, F.pow(1 - F.pow(F.abs(u), 3), 3)).otherwise(0.0)


def lap_clock(seconds: Column) -> Column:
    """M:SS.ss of a time in seconds.

    Hundredths are rounded from the number as it is stored, as in C: 19.845 is a little less than it reads and becomes 19.84. A format
    string would round the digits that it reads.
    """
    minutes = F.floor(seconds / 60)
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(F.format_number(seconds - 60 * minutes, 2), 5, "0"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation of the rows that have both; null, not an error, where one does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
