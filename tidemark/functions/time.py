"""Calendar- and timezone-aware time buckets on timestamps without time zone (read as UTC)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone
from fractions import Fraction

from pyspark.sql import Column, functions as F

#: Units and their names (fixed values); microseconds for fixed ones, months for calendar ones.
_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_MONTHS = {"mo": 1, "y": 12}
_NAMES = {"us": "us micro micros microsecond microseconds", "ms": "ms milli millis millisecond milliseconds", "s": "s sec secs second seconds", "m": "m min mins minute minutes", "h": "h hr hrs hour hours", "d": "d day days", "w": "w week weeks", "mo": "mo mon month months", "y": "y yr year years"}
_UNIT = {name: unit for unit, names in _NAMES.items() for name in names.split()}
#: Monday 2000-01-03 00:00 UTC, where buckets of fixed width begin; calendar ones begin in January 2000.
ORIGIN_MICROS = 946_857_600_000_000


@dataclass(frozen=True)
class Width:
    micros: int = 0
    months: int = 0


def parse_width(text: str) -> Width:
    """A width like `5m`, `1.5h`, `1 day` or `3mo`; parts add up, but months and fixed parts don't mix."""
    parts = re.findall(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*", text)
    if not parts or "".join(a + b for a, b in parts) != re.sub(r"\s", "", text):
        raise ValueError(f"not a width: {text!r}")
    micros, months = Fraction(0), Fraction(0)
    for number, name in parts:
        unit = _UNIT.get(name.lower())
        if unit is None:
            raise ValueError(f"unknown unit {name!r}")
        if unit in _MONTHS:
            months += Fraction(number) * _MONTHS[unit]
        else:
            micros += Fraction(number) * _MICROS[unit]
    if micros and months:
        raise ValueError("months and fixed widths don't mix")
    if micros.denominator != 1 or months.denominator != 1 or not (micros or months):
        raise ValueError("a width must be a positive whole number of microseconds or months")
    return Width(int(micros), int(months))


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def time_bucket(width: str, ts: Column, origin: datetime | None = None, tz: str | None = None) -> Column:
    """The start of the bucket of `width` that ts is in; with tz, buckets follow that zone's wall time."""
    w = parse_width(width)
    if tz is not None:
        local = F.from_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")
        return F.to_utc_timestamp(time_bucket(width, local, origin).cast("timestamp"), tz).cast("timestamp_ntz")
    if w.micros:
        start = ORIGIN_MICROS if origin is None else round(origin.replace(tzinfo=timezone.utc).timestamp() * 1e6)
        u = to_micros(ts)
        return from_micros(u - F.pmod(u - F.lit(start), F.lit(w.micros)))
    first = 24_000 if origin is None else origin.year * 12 + origin.month - 1
    month = F.year(ts) * 12 + F.month(ts) - 1
    start = month - F.pmod(month - F.lit(first), F.lit(w.months))
    return F.make_timestamp_ntz(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
