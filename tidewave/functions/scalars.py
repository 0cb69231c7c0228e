"""Scalar expressions: names, lenient numbers, fingerprints, clipping."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite(value: Column) -> Column:
    """NaN and infinities as null: the one way to say missing from here on."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(INFINITY)), None).otherwise(value)


def fixed(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def scaled_fixed(value: Column, digits: int = 6) -> Column:
    """The same by way of the value times a power of ten, rounded to a whole number, as DuckDB does it: near half a unit
    that product decides."""
    unit = F.lit(10.0**digits)
    near = F.round(value * unit) / unit
    return F.when(F.abs(near) == F.lit(INFINITY), value).otherwise(near) + F.lit(0.0)


def exact_mean(value: Column) -> Column:
    """The mean of a group's doubles as they are written, rounded once: the same in any order of the rows. Where a value
    has no exact decimal with 18 places, or the sum none with 38 digits, the plain average."""
    d = value.try_cast("decimal(38,18)")
    exact = F.bool_and(value.isNull() | F.coalesce(d.cast("double") == value, F.lit(False)))
    return F.coalesce(F.when(exact, F.try_avg(d).cast("double")), F.avg(value))


def clean_name(name: Column) -> Column:
    """Runs of anything but ASCII letters, digits, ``_`` and common Han characters become ``_``; ends
    are stripped of it; what is left empty is ``unnamed``."""
    runs = F.regexp_replace(name, r"[^0-9A-Za-z_一-鿿]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(runs, "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))


def lenient_float(text: Column) -> Column:
    """A finite number, else 0."""
    return F.coalesce(finite(text.try_cast("double")), F.lit(0.0))


def lenient_int(text: Column) -> Column:
    """A whole number written as one, else 0."""
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long")), F.lit(0).cast("long"))


def lenient_ratio(text: Column) -> Column:
    """``a/b`` as a quotient (0 if b is 0), a plain number as it is, anything else 0."""
    parts = F.split(text, "/", 2)
    quotient = F.try_divide(finite(parts[0].try_cast("double")), finite(F.get(parts, F.lit(1)).try_cast("double")))
    return F.when(F.size(parts) == 2, F.coalesce(finite(quotient), F.lit(0.0))).otherwise(lenient_float(text))


def derived_length(frames: Column, rate: Column, duration: Column) -> Column:
    """(frames, duration) with each, where it is 0 or null, from the other and the rate."""
    known = F.nullif(frames, F.lit(0))
    length = F.nullif(duration, F.lit(0.0))
    return F.struct(
        F.coalesce(known, F.bround(length * rate, 0).cast("long"), F.lit(0).cast("long")).alias("frames"),
        F.coalesce(length, F.try_divide(known.cast("double"), F.nullif(rate, F.lit(0.0))), F.lit(0.0)).alias("duration"),
    )


def char_text(chars: Column) -> Column:
    """An array of strings as a text: joined if all have one character at most, else the first."""
    short = F.forall(chars, lambda c: F.length(c) <= 1)
    return F.when(short, F.array_join(chars, "")).otherwise(F.get(chars, F.lit(0)))


def magnitude(real: Column, imaginary: Column) -> Column:
    return F.hypot(real, imaginary)


def clipped(value: Column, bound: float = 8.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), value))


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def config_hash(config: Mapping[str, Any]) -> str:
    """16 hex digits of the SHA-256 of canonical JSON (sorted keys, no spaces)."""
    import hashlib

    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def file_fingerprint(path: Column, size: Column, modified: Column) -> Column:
    return short_hash(F.concat_ws("|", path, size.cast("string"), modified.cast("string")))


def record_key(parts: Sequence[Column], digits: int = 20) -> Column:
    """Key of a record's cached result: all that the result depends on, as JSON."""
    return short_hash(F.to_json(F.struct(*parts)), digits)


def to_other_clock(t: Column, offset: Column) -> Column:
    """A time of the right-hand series on the left-hand clock; ``from_other_clock`` is its inverse."""
    return t - offset


def from_other_clock(t: Column, offset: Column) -> Column:
    return t + offset


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp by its own fields, whatever the session's time zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
