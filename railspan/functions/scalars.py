"""Column functions: clocks, keys, distances, clamps and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Planar kilometres per degree, earth radius, speeds in km/h.
KM_PER_LAT, KM_PER_LON, EARTH_KM, WALK_KMH = 111.0, 71.0, 6371.0, 4.5
SPEEDS = {"Walk": 5.0, "Bike": 15.0, "Car": 50.0}


def station_key(name: Column) -> Column:
    return F.upper(F.trim(name))


def clock_hour(clock: Column) -> Column:
    """Hour of "HH:MM:SS", null if unreadable; may exceed 23."""
    return F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int")


def clock_seconds(clock: Column, strict: bool = True) -> Column:
    """Seconds since the service day's midnight. Strict: exactly eight characters, else null."""
    h, m, s = (F.split_part(clock, F.lit(":"), F.lit(i)).try_cast("long") for i in (1, 2, 3))
    seconds = h * 3600 + m * 60 + (s if strict else F.coalesce(s, F.lit(0)))
    return F.when(F.length(clock) == 8, seconds) if strict else seconds


def clock_label(minutes: Column) -> Column:
    """HH:MM, with +1 beyond midnight."""
    return F.concat(F.format_string("%02d:%02d", F.pmod(F.floor(minutes / 60), F.lit(24)).cast("int"), F.pmod(minutes, F.lit(60)).cast("int")), F.when(minutes >= 1440, "+1").otherwise(""))


def whole_number(text: Column) -> Column:
    """A number given as text, to the nearest whole, half to even; null if unreadable."""
    return F.rint(text.try_cast("double")).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def manhattan_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.abs(lat1 - lat2) * KM_PER_LAT + F.abs(lon1 - lon2) * KM_PER_LON


def walk_minutes(km: Column) -> Column:
    return km / WALK_KMH * 60


def km_to_degrees(km: float) -> float:
    return km * (1 / KM_PER_LAT + 1 / KM_PER_LON) / 2


def in_box(lat: Column, lon: Column, box=(49.4, 51.6, 2.5, 6.5)) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def clamp_delay(delay: Column, floor: float, cap: float) -> Column:
    """Below the floor: 0; above the cap: the cap."""
    return F.when(delay < floor, F.lit(0)).otherwise(F.least(delay, F.lit(cap)))


def quadrant(dlat: Column, dlon: Column) -> Column:
    return F.when(F.abs(dlat) >= F.abs(dlon), F.when(dlat >= 0, "N").otherwise("S")).otherwise(F.when(dlon >= 0, "E").otherwise("W"))


def size_class(per_hour: Column) -> Column:
    return F.when(per_hour < 4, "Small").when(per_hour < 10, "Medium").otherwise("Big")


def speed_class(kmh: Column) -> Column:
    return F.when(kmh > 80, "fast").when(kmh >= 60, "medium").otherwise("slow")


def correlation_label(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a < 0.1, "none").when(a < 0.3, "weak").when(a < 0.5, "moderate").when(a < 0.7, "strong").otherwise("very strong")


def undirected(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 where a side is constant. Pairs with a null are left out."""
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def round_exact(x: Column, n: int) -> Column:
    """x to n decimals by its exact binary value, a true half to the even neighbour: 2.675 is below its half, so it becomes 2.67.

    x * 10^n is a rounded product and its error, worked out without error from halves of 26 bits; the error decides where the product alone is a half.
    """
    s, cut = float(10**n), float((1 << 27) + 1)
    a = F.abs(x.cast("double"))
    p = a * s
    split = lambda v: (v * cut - (v * cut - v))  # noqa: E731  the upper half of the digits
    ah, sh = split(a), float(s * cut - (s * cut - s))
    al, sl = a - ah, s - sh
    error = ((ah * sh - p) + ah * sl + al * sh) + al * sl
    low = F.floor(p)
    odd = p - low
    up = F.when(odd != 0.5, odd > 0.5).when(error != 0, error > 0).otherwise(low % 2 == 1)
    whole = (low + up.cast("long")).cast("double") / s
    small = F.when(x < 0, -whole).otherwise(whole)
    return F.when(F.isnan(x) | (p >= float(1 << 51)), x).otherwise(small)  # larger values have no decimals to drop


def weekday_label(day: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), F.weekday(day) + 1)
