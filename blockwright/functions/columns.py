"""Column functions with the exact rules that the timeline and the leads need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp since 1970; no session zone takes part."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def plus_seconds(start_us: Column, seconds: Column) -> Column:
    """An end in whole microseconds."""
    return start_us + F.round(seconds * US).cast("bigint")


def upper_median(value: Column) -> Column:
    """Aggregate: the element at n div 2 of the sorted values; of an even number the upper middle one."""
    return F.element_at(F.sort_array(F.collect_list(value)), (F.count(value) / 2).cast("int") + 1)


def exclusive_quartile(values: Column, k: int) -> Column:
    """The k-th quartile of a sorted array of two or more numbers, the ends left out: places k (n + 1) / 4, between neighbours in proportion."""
    n = F.size(values)
    low = F.greatest(F.lit(1), F.least(F.floor(k * (n + 1) / 4).cast("int"), n - 1))
    over = k * (n + 1) - 4 * low
    return (F.element_at(values, low) * (4 - over) + F.element_at(values, low + 1) * over) / 4


def packed_date(value: Column) -> Column:
    """Zone-less timestamp of a packed date (from the low bits: second 6, minute 6, hour 5, day 5, month 4, years since 2000 6); null if impossible."""
    field = lambda low, width: F.shiftrightunsigned(value, low).bitwiseAND((1 << width) - 1).cast("int")
    return F.try_make_timestamp_ntz(field(26, 6) + 2000, field(22, 4), field(17, 5), field(12, 5), field(6, 6), field(0, 6).cast("double"))


def pack_date(ts: Column) -> Column:
    parts = ((F.second(ts), 0), (F.minute(ts), 6), (F.hour(ts), 12), (F.dayofmonth(ts), 17), (F.month(ts), 22), (F.year(ts) - 2000, 26))
    return reduce(lambda a, b: a + b, [F.shiftleft(v.cast("bigint"), low) for v, low in parts])


def wrapped_difference(later: Column, earlier: Column, bits: int) -> Column:
    """later - earlier on a counter of so many bits, as the nearest signed number."""
    half, whole = 1 << (bits - 1), 1 << bits
    return F.pmod(later - earlier + half, F.lit(whole).cast("bigint")) - half


def epoch_guess(value: Column) -> Column:
    """Microseconds of an epoch number in seconds, milliseconds or microseconds, told apart by size; null for none."""
    return F.when(value.between(10**8, 10**11 - 1), value * US).when(value.between(10**11, 10**14 - 1), value * 1000).when(value.between(10**14, 10**17 - 1), value)


def to_utc(local_us: Column, zone_min: Column, drift_s: Column) -> Column:
    """UTC = local - drift - zone; null where no zone is stated."""
    return local_us - F.coalesce(drift_s, F.lit(0)).cast("bigint") * US - zone_min.cast("bigint") * 60 * US


def ten_minutes(local_us: Column) -> Column:
    """Number of the ten-minute stretch of the day."""
    return F.floor(F.pmod(local_us, F.lit(86_400 * US).cast("bigint")) / (600 * US)).cast("bigint")


def day_number(local_us: Column) -> Column:
    return F.floor(local_us / (86_400 * US)).cast("bigint")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); zero without an area."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = wide * high
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def solar_elevation(utc_us: Column, lat: float, lon: float) -> Column:
    """Degrees of the sun above the horizon, by the general low-accuracy solar equations."""
    days = utc_us / (86_400.0 * US)
    century = (days + 2440587.5 - 2451545.0) / 36525.0
    mean_long = F.pmod(280.46646 + century * (36000.76983 + century * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + century * (35999.05029 - 0.0001537 * century))
    eccentricity = 0.016708634 - century * (0.000042037 + 0.0000001267 * century)
    centre = F.sin(anomaly) * (1.914602 - century * (0.004817 + 0.000014 * century)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * century) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * century)
    apparent = F.radians(mean_long + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23.0 + (26.0 + (21.448 - century * (46.815 + century * (0.00059 - century * 0.001813))) / 60.0) / 60.0 + 0.00256 * F.cos(node))
    declination = F.asin(F.sin(tilt) * F.sin(apparent))
    y = F.pow(F.tan(tilt / 2), F.lit(2.0))
    turn = F.radians(mean_long)
    equation = 4 * F.degrees(y * F.sin(2 * turn) - 2 * eccentricity * F.sin(anomaly) + 4 * eccentricity * y * F.sin(anomaly) * F.cos(2 * turn) - 0.5 * y * y * F.sin(4 * turn) - 1.25 * eccentricity * eccentricity * F.sin(2 * anomaly))
    minutes = F.pmod(utc_us / (60.0 * US), F.lit(1440.0))
    angle = F.radians(F.pmod(minutes + equation + 4 * lon, F.lit(1440.0)) / 4 - 180)
    phi = F.radians(F.lit(float(lat)))
    return F.degrees(F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(angle)))
