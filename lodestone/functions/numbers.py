"""Numbers, dates, hashes, places, arrays and maps: Columns in, Column out."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col

# ---- lenient casts


def as_bool(x: C, default: bool | None = None) -> Column:
    return F.coalesce(col(x).cast("string").try_cast("boolean"), F.lit(default))


def as_int(x: C, default: int | None = None) -> Column:
    return F.coalesce(F.trim(col(x).cast("string")).try_cast("bigint"), F.lit(default))


def as_number(x: C, default: float | None = None) -> Column:
    return F.coalesce(F.trim(col(x).cast("string")).try_cast("double"), F.lit(default))


def parse_int(x: C, separators: str = "[, ]") -> Column:
    return F.regexp_replace(col(x), separators, "").try_cast("bigint")


def parse_float(x: C, separators: str = "[, ]") -> Column:
    return F.regexp_replace(col(x), separators, "").try_cast("double")


def parse_decimal(x: C, precision: int = 38, scale: int = 6) -> Column:
    return F.regexp_replace(col(x), "[, ]", "").try_cast(f"decimal({precision},{scale})")


def parse_percent(x: C) -> Column:
    """'32.1%' as 0.321."""
    return F.regexp_replace(col(x), "[% ]", "").try_cast("double") * 0.01


# ---- arithmetic


def percent(x: C, y: C, if_zero: float | None = 0.0) -> Column:
    return F.when(col(y) == 0, F.lit(if_zero)).otherwise(F.lit(100.0) * col(x) / col(y))


def bound(x: C, low, high) -> Column:
    """Clamped; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.least(col(x), F.lit(high)), F.lit(low)))


def div_up(x: C, d: int) -> Column:
    """Division rounded up."""
    return -F.floor(-col(x) / F.lit(d))


def round_down(x: C, d: int) -> Column:
    return col(x) - F.pmod(col(x), F.lit(d))


def round_up(x: C, d: int) -> Column:
    return col(x) + F.pmod(-col(x), F.lit(d))


def log_x(x: C) -> Column:
    """sign(x) * ln(1 + |x|)."""
    return F.signum(col(x)) * F.log1p(F.abs(col(x)))


def exp1_x(x: C) -> Column:
    """Inverse of log_x."""
    return F.signum(col(x)) * F.expm1(F.abs(col(x)))


def mexican(x: C, scale: float = 1.0) -> Column:
    """Ricker wavelet, 2/sqrt(3) * pi**-0.25 * (1 - t*t) * exp(-t*t/2)."""
    t = col(x) / F.lit(scale)
    return F.lit(2 / 3**0.5 * pi**-0.25) * (F.lit(1.0) - t * t) * F.exp(-t * t / 2)


def logistic(x: C, scale: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x) / F.lit(scale)))


def logistic_slope(x: C, scale: float = 1.0) -> Column:
    s = logistic(x, scale)
    return s * (F.lit(1.0) - s) / F.lit(scale)


def cauchy(x: C, scale: float = 1.0) -> Column:
    return F.atan(col(x) / F.lit(scale)) / F.lit(pi) + 0.5


def sigmoid_sqrt(x: C) -> Column:
    return (col(x) / F.sqrt(F.lit(1.0) + col(x) * col(x)) + 1) / 2


def sigmoid_lin(x: C) -> Column:
    """Piecewise linear; null gives 0.5."""
    return F.coalesce(bound((col(x) + 1) / 2, 0.0, 1.0), F.lit(0.5))


def binarize(x: C, slope: float = 4.0) -> Column:
    """Pushed towards 0 or 1 around 0.5, and clipped."""
    return bound((col(x) - 0.5) * F.lit(slope) + 0.5, 0.0, 1.0)


def noise(scale: float, seed: int) -> Column:
    return (F.rand(seed) - 0.5) * F.lit(2.0 * scale)


def heat(x: C, magnitude: float, seed: int) -> Column:
    """A value with uniform noise of up to the magnitude on either side."""
    return col(x) + noise(magnitude, seed)


def multiplicative_noise(scale: float, seed: int) -> Column:
    return F.exp(noise(scale, seed))


# ---- vectors (array<double>)


def _sum(v: Column, f=lambda x: x) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def norm2(v: C) -> Column:
    return _sum(col(v), lambda x: x.cast("double") * x.cast("double"))


def norm(v: C) -> Column:
    return F.sqrt(norm2(v))


def softmax(v: C, slope: float = 1.0, eps: float = 0.0) -> Column:
    top = F.array_max(col(v))
    e = F.transform(col(v), lambda x: F.exp((x - top) * F.lit(slope)))
    return F.transform(e, lambda x: x / (_sum(e) + F.lit(eps)))


def multi_softmax(v: C, groups: Sequence[tuple[int, int]]) -> Column:
    """Softmax of each (start, length) range, from 0, in one array."""
    return F.concat(*(softmax(F.slice(col(v), s + 1, n)) for s, n in groups))


def zero_sum(v: C) -> Column:
    m = _sum(col(v)) / F.size(col(v))
    return F.transform(col(v), lambda x: x - m)


def unit_sum(v: C) -> Column:
    s = _sum(col(v))
    return F.transform(col(v), lambda x: x / s)


def unit_norm(v: C, p: float = 2.0) -> Column:
    n = F.pow(_sum(col(v), lambda x: F.pow(F.abs(x), F.lit(p))), F.lit(1.0 / p))
    return F.transform(col(v), lambda x: x / n)


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def find_nonzero(v: C) -> Column:
    """Indices (from 0) of values that aren't 0."""
    return F.filter(F.transform(col(v), lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def vector_json(v: C) -> Column:
    """A vector as JSON with five significant digits."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(v), lambda x: F.format_string("%.5g", x.cast("double"))), ", "), F.lit("]"))


def vector_of_json(x: C) -> Column:
    return F.from_json(col(x), "array<double>")


def min_max(*xs: C) -> Column:
    return F.struct(F.least(*map(col, xs)).alias("min"), F.greatest(*map(col, xs)).alias("max"))


# ---- arrays and maps


def reverse_map(m: C) -> Column:
    return F.map_from_arrays(F.map_values(col(m)), F.map_keys(col(m)))


def lower_keys(m: C) -> Column:
    return F.transform_keys(col(m), lambda k, _: F.lower(k))


def split_keys(m: C, sep: str) -> Column:
    """Keys that list several names, one entry for each."""
    return F.map_from_entries(F.flatten(F.transform(F.map_entries(col(m)), lambda e: F.transform(F.split(e["key"], sep), lambda k: F.struct(F.trim(k), e["value"])))))


def list_to_map(v: C, invert: bool = False) -> Column:
    """Index (from 0) to value, or value to index."""
    at = F.transform(col(v), lambda _, i: i)
    return F.map_from_arrays(col(v), at) if invert else F.map_from_arrays(at, col(v))


def update_map(a: C, b: C) -> Column:
    """Entries of both; those of b win."""
    return F.map_concat(F.map_filter(col(a), lambda k, _: ~F.map_contains_key(col(b), k)), col(b))


def print_map(m: C) -> Column:
    """Lines 'key: value' in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(m))), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("null")))), "\n")


# ---- hashes and places


def hash_md5(x: C, n: int = 4) -> Column:
    """The first 2n hex digits of the MD5 as a number: bigint to n = 7, decimal to 15, else a hex string."""
    h = F.substr(F.md5(col(x).cast("binary")), F.lit(1), F.lit(2 * n))
    if n <= 7:
        return F.conv(h, 16, 10).cast("bigint")
    if n <= 15:
        hi, lo = F.substr(h, F.lit(1), F.lit(2 * n - 14)), F.substr(h, F.lit(2 * n - 13), F.lit(14))
        return (F.conv(hi, 16, 10).cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(17,0)") + F.conv(lo, 16, 10).cast("decimal(17,0)")).cast("decimal(38,0)")
    return h


def crc32(x: C) -> Column:
    return F.crc32(col(x).cast("binary"))


EARTH_KM = 6367.0


def distance_km(lat1: C, lon1: C, lat2: C, lon2: C) -> Column:
    """Great-circle distance by the haversine formula, radius 6,367 km."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# ---- dates

MINUTE, HOUR, DAY, WEEK, YEAR = 60.0, 3600.0, 86400.0, 604800.0, 86400.0 * 365.2425


def seconds_between(a: C, b: C) -> Column:
    """b - a in seconds, with microseconds; null if either is."""
    return (F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))) / F.lit(1e6)


def minutes_between(a: C, b: C) -> Column:
    return seconds_between(a, b) / MINUTE


def hours_between(a: C, b: C) -> Column:
    return seconds_between(a, b) / HOUR


def days_between(a: C, b: C) -> Column:
    return seconds_between(a, b) / DAY


def weeks_between(a: C, b: C) -> Column:
    return seconds_between(a, b) / WEEK


def years_between(a: C, b: C) -> Column:
    return seconds_between(a, b) / YEAR


def seconds_since(a: C) -> Column:
    return seconds_between(a, F.current_timestamp())


def minutes_since(a: C) -> Column:
    return seconds_since(a) / MINUTE


def hours_since(a: C) -> Column:
    return seconds_since(a) / HOUR


def days_since(a: C) -> Column:
    return seconds_since(a) / DAY


def years_since(a: C) -> Column:
    return seconds_since(a) / YEAR


def as_datetime(x: C, fmt: str | None = None, default=None) -> Column:
    """A timestamp; a date is its midnight, a text is parsed, what fails is the default."""
    t = F.try_to_timestamp(col(x).cast("string"), F.lit(fmt)) if fmt else col(x).cast("string").try_cast("timestamp")
    return F.coalesce(t, F.lit(default).cast("timestamp"))


def _date(x: Column, fmt: str, pattern: str) -> Column:
    return F.when(x.rlike(pattern), F.try_to_timestamp(x, F.lit(fmt)).cast("date"))


def parse_date(x: C) -> Column:
    """2001-02-03, 03.02.2001, 02/03/2001, '3 Feb 2001', 'Feb 3, 2001', 20010203, 200102 or 2001."""
    t = F.trim(col(x))
    return F.coalesce(
        _date(t, "yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), _date(t, "d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"), _date(t, "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
        _date(t, "MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), _date(t, "d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"), _date(t, "yyyyMMdd", r"^\d{8}$"), _date(t, "yyyyMM", r"^\d{6}$"), _date(t, "yyyy", r"^\d{4}$"),
    )


def parse_datetime(x: C) -> Column:
    """'02/03/2001 14:05:06', its 12-hour form, or ISO."""
    t = F.trim(col(x))
    return F.coalesce(F.try_to_timestamp(t, F.lit("M/d/yyyy H:mm:ss")), F.try_to_timestamp(t, F.lit("M/d/yyyy h:mm:ss a")), t.try_cast("timestamp"))


def format_date(x: C) -> Column:
    """ISO date; a year before 1000 isn't padded."""
    return F.date_format(col(x), "y-MM-dd")


def format_datetime(x: C) -> Column:
    return F.date_format(col(x), "y-MM-dd HH:mm:ss")


def epoch_seconds(x: C) -> Column:
    return F.unix_micros(col(x).cast("timestamp")) / F.lit(1e6)


def convert_timezone(x: C, source: str, target: str) -> Column:
    """Wall-clock time of another zone."""
    return F.convert_timezone(F.lit(source), F.lit(target), col(x).cast("timestamp_ntz"))
