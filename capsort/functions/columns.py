"""Scalar functions as Column builders: all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_share(a: Column, b: Column) -> Column:
    return hamming(a, b) / 64.0


def hamming_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(hamming(a, b), F.lit(0)).cast("double")


def sign_bits(vector: Column) -> Column:
    """A 64-bit hash: element i > 0 sets bit 63 - i."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def thermometer(level: Column) -> Column:
    """The lowest ``level`` bits set, 63 at most."""
    n = F.greatest(F.lit(0), F.least(F.lit(63), F.floor(level))).cast("int")
    # All ones shifted right: 1 << 63 is no long, and n of 0 must not shift by 64.
    return F.when(n > 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - n)).otherwise(F.lit(0).cast("long"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def vertical(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def angle(a: Column, b: Column) -> Column:
    """Difference of directions, 0 to 180 degrees."""
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def decay(gap: Column, span: float, least: float = 1.0) -> Column:
    return F.exp(-F.abs(gap) / F.lit(float(max(least, span))))


def turn(a: Column, b: Column) -> Column:
    return (1 + F.cos(angle(a, b) * F.pi() / 180)) / 2


def aspect(width: Column, height: Column) -> Column:
    known = (width > 0) & (height > 0)
    return F.when(known, F.greatest(width, height) / F.least(width, height)).otherwise(F.lit(1.0))


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def flat_name(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("_"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def sequence_number(name: Column) -> Column:
    """The last run of digits of the file's stem, if it has 8 digits at most."""
    stem = F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    digits = F.regexp_extract(stem, "([0-9]+)[^0-9]*$", 1)
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 8), digits.try_cast("int"))


def trusted_location(lat: Column, accuracy: Column, fix: Column, taken: Column, most_accuracy: float, most_age: float) -> Column:
    """A location whose error and fix age are not known to be too large."""
    near = F.coalesce(accuracy <= most_accuracy, F.lit(True))
    fresh = F.coalesce(F.abs(taken - fix) <= most_age, F.lit(True))
    return lat.isNotNull() & near & fresh


def capture_time(text: Column, offset: Column, fraction: Column) -> Column:
    """Seconds since 1970 of an EXIF time with its zone offset and sub-second digits."""
    base = F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))) / 1e6
    return base - F.coalesce(zone_offset(offset), F.lit(0)) + F.coalesce(F.concat(F.lit("0."), fraction).try_cast("double"), F.lit(0.0))


def zone_offset(text: Column) -> Column:
    """Seconds of ``+09:00``; null if malformed."""
    part = lambda k: F.regexp_extract(text, r"^([+-])(\d{2}):(\d{2})$", k)
    seconds = part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60
    return F.when(part(1) == "-", -seconds).when(part(1) == "+", seconds)


def signed_coordinate(value: Column, ref: Column) -> Column:
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def exposure_value(aperture: Column, seconds: Column, iso: Column, brightness: Column) -> Column:
    """log2(N^2 / t) - log2(ISO / 100), or the brightness."""
    known = (aperture > 0) & (seconds > 0) & (iso > 0)
    return F.when(known, F.log2(aperture * aperture / seconds) - F.log2(iso / 100)).otherwise(brightness)


def note_value(body: Column, key: str) -> Column:
    """The value of the first ``key: value`` or ``key=value`` line."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    own = F.filter(lines, lambda x: x.startswith(f"{key}="))
    return F.coalesce(F.btrim(F.substring(F.try_element_at(own, F.lit(1)), len(key) + 2, 1 << 30)), F.lit(""))


def single_line(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\n|\r", " ")


def percent_text(share: Column) -> Column:
    return F.concat(F.round(F.coalesce(share, F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("%"))


def size_text(n: Column) -> Column:
    """Decimal units with one digit."""
    steps = [(1e9, "GB"), (1e6, "MB"), (1e3, "KB")]
    return reduce(lambda out, s: F.when(n >= s[0], F.concat(F.format_string("%.1f", n / s[0]), F.lit(f" {s[1]}"))).otherwise(out), reversed(steps), F.concat(n.cast("string"), F.lit(" バイト")))


def critical_density(n: Column, k: Column, q: float) -> Column:
    return 1 - F.pow(F.greatest(q * n, F.lit(1.0)), -1.0 / k)
