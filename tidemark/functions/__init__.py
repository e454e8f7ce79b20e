"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
FAR_FUTURE = "9999-12-31 23:59:59"


def time_bucket(millis: Column, minutes: int) -> Column:
    """Epoch millis cut to a multiple of minutes, as 'yyyy-MM-dd HH:mm:ss.SSS'; null for null."""
    size = minutes * 60_000
    return F.date_format(F.timestamp_millis(millis - F.pmod(millis, F.lit(size))), "yyyy-MM-dd HH:mm:ss.SSS")


def text_time_bucket(text: Column, minutes: int, pattern: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    return time_bucket(F.unix_millis(F.try_to_timestamp(text, F.lit(pattern))), minutes)


def geohash(lat: Column, lng: Column, precision: int = 5) -> Column:
    """Geohash text; null outside of the globe's ranges or for null.

    Each coordinate becomes an integer of its share of bits by one multiplication, and each character takes its five
    bits of the two by shifts.
    """
    bits = 5 * precision
    lng_bits, lat_bits = (bits + 1) // 2, bits // 2

    def scaled(x: Column, low: float, width: float, n: int) -> Column:
        return F.least(F.floor((x - low) / width * (1 << n)), F.lit((1 << n) - 1)).cast("long")

    parts = (scaled(lng, -180.0, 360.0, lng_bits), scaled(lat, -90.0, 180.0, lat_bits))
    chars = []
    for c in range(precision):
        value = F.lit(0)
        for i in range(5 * c, 5 * c + 5):
            n = (lng_bits, lat_bits)[i % 2]
            bit = F.shiftright(parts[i % 2], n - 1 - i // 2).bitwiseAND(F.lit(1))
            value = value * 2 + bit
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (value + 1).cast("int"), F.lit(1)))
    sound = lat.between(-90, 90) & lng.between(-180, 180)
    return F.when(sound, F.concat(*chars))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches (Spark's own gives '')."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def url_prefix(url: Column) -> Column:
    """The address up to its last slash."""
    return first_match(url, "^(.*/)")


def reversed_key(number: Column, width: int = 10_000_000_000) -> Column:
    """Row key that spreads neighbouring numbers: the reversed text of width - number."""
    return F.reverse((F.lit(width) - number).cast("string"))


def to_json_text(properties: Column) -> Column:
    """A map or struct as JSON text; null for null, and null values are left out."""
    return F.to_json(properties)


def patched_json(json: Column, key: str, value: Column) -> Column:
    """A JSON object of plain values with key set to value (a text); null where it can't be read."""
    old = F.from_json(json, "map<string,string>")
    rest = F.map_filter(old, lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def null_of(kind: str = "long") -> Column:
    return F.lit(None).cast(kind)


#: Fixed value: the separator of packed texts.
UNIT = "\x01"


def packed_text(*parts: Column) -> Column:
    """Texts in one, which unpacked_text takes apart; null where one is null."""
    return F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit(UNIT), p.cast("string")) if i else (p.cast("string"),))])


def unpacked_text(text: Column, *names: str) -> Column:
    """A struct of the parts under names; absent parts are null."""
    parts = F.split(text, UNIT, -1)
    return F.when(text.isNotNull(), F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def on_day(time: Column, as_of: Column | str | None = None) -> Column:
    """Whether time lies on the day as_of; without one, on today."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return F.to_date(time) == day


def in_window(time: Column, start: Column | str, end: Column | str) -> Column:
    """start <= time < end; texts are times of the session's zone."""
    kind = lambda x: F.lit(x).cast("timestamp") if isinstance(x, str) else x
    return (time.cast("timestamp") >= kind(start)) & (time.cast("timestamp") < kind(end))


def processing_time() -> Column:
    return F.current_timestamp()


def from_server_time(time: Column, zone: str) -> Column:
    """A database's wall-clock time of the given zone, as an instant."""
    return F.to_utc_timestamp(time, zone)


def parse_time_or(text: Column, default: str = FAR_FUTURE) -> Column:
    """Timestamp of 'yyyy-MM-dd HH:mm:ss'; blank, null and unreadable texts give default."""
    read = F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(read, F.lit(default).cast("timestamp"))


def property_map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def property_or_blank(properties: Column, key: str) -> Column:
    return F.coalesce(properties[key], F.lit(""))


_OPERATORS = {"=": 1, ">": 1, ">=": 1, "<": 1, "<=": 1, "between": 2, "in": None}
STRICT_OPERATORS = frozenset(("=", ">", "<"))


def compare(tag: Column, operator: str, values: Sequence, strict: bool = False, known: bool = False) -> Column:
    """Whether tag stands in operator to values; never null.

    Equality and "in" compare texts; the others compare doubles, and texts that are none fail. An unknown operator is
    false, or with strict (only =, > and < are known then) or known a ValueError.
    """
    if (strict and operator not in STRICT_OPERATORS) or (known and operator not in _OPERATORS):
        raise ValueError(f"operator {operator!r} is not one of {sorted(STRICT_OPERATORS if strict else _OPERATORS)}")
    if operator not in _OPERATORS:
        return F.lit(False)
    if (need := _OPERATORS[operator]) is not None and len(values) < need:
        raise ValueError(f"operator {operator!r} needs {need} values")
    if operator == "=":
        out = tag.cast("string") == F.lit(str(values[0]))
    elif operator == "in":
        out = tag.cast("string").isin([str(v) for v in values])
    else:
        x, (v, *more) = tag.cast("string").try_cast("double"), [float(v) for v in values]
        out = {">": lambda: x > v, ">=": lambda: x >= v, "<": lambda: x < v, "<=": lambda: x <= v, "between": lambda: x.between(v, more[0])}[operator]()
    return F.coalesce(out, F.lit(False))


def compare_data(tag: Column, operator: Column, values: Column) -> Column:
    """compare with the operator and the values (texts) as data; an unknown operator is false."""
    x, at = tag.cast("string").try_cast("double"), lambda i: F.get(values, F.lit(i)).try_cast("double")
    numeric = {">": x > at(0), ">=": x >= at(0), "<": x < at(0), "<=": x <= at(0), "between": x.between(at(0), at(1))}
    out = F.when(operator == "=", tag.cast("string") == F.get(values, F.lit(0))).when(operator == "in", F.array_contains(values, tag.cast("string")))
    for name, holds in numeric.items():
        out = out.when(operator == name, holds)
    return F.coalesce(out, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def has_word(text: Column, word: str) -> Column:
    """Full-text match of one word: equality with a lower-cased token."""
    return F.array_contains(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), word.lower())
