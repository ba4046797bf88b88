"""Times, durations and sizes as query literals spell them. All instants are Unix milliseconds, UTC."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
MOST = (1 << 64) // 2

# Unit spellings, in seconds and in bytes.
DURATION_UNITS = {
    1: ("", "s", "sec", "secs", "second", "seconds"),
    60: ("m", "min", "mins", "minute", "minutes"),
    3600: ("h", "hr", "hrs", "hour", "hours"),
    86400: ("d", "day", "days"),
    604800: ("w", "week", "weeks"),
}
SIZE_UNITS = {"": 1, "b": 1, "byte": 1, "bytes": 1, "k": 1 << 10, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40}

_SECONDS = {name: n for n, names in DURATION_UNITS.items() for name in names}
_NUMBER = re.compile(r"([0-9.]+)(.*)", re.DOTALL)
_WHOLE = re.compile(r"\+?[0-9]+")


def now_ms() -> int:
    return int(time.time() * 1000)


def _measure(raw: str, units: dict[str, int]) -> Decimal | None:
    """A number and its unit, multiplied out; None if either cannot be read."""
    m = _NUMBER.fullmatch(raw.strip())
    unit = units.get(m[2].strip().lower()) if m else None
    if unit is None or not re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", m[1]):
        return None
    value = Decimal(m[1]) * unit
    return None if value > MOST else value


def parse_duration(raw: str) -> int | None:
    """Milliseconds of a duration such as 30s, 15m, 24h, 7d, 2w; a bare number is seconds."""
    value = _measure(raw, _SECONDS)
    return None if value is None else int(value * 1000)


def parse_size(raw: str) -> int | None:
    """Bytes of a size such as 512, 64kb, 10mb; units are powers of 1024 and m, g, t alone are none."""
    value = _measure(raw, SIZE_UNITS)
    return None if value is None else int(value.to_integral_value(ROUND_HALF_UP))


def parse_date(raw: str) -> int | None:
    """Midnight of Y-M-D or Y/M/D, month and day 1 if missing. Days past a month's end run into the next."""
    parts = raw.strip().replace("/", "-").split("-")
    numbers = parts[:3] + ["1"] * (3 - len(parts))
    if not all(_WHOLE.fullmatch(p) for p in numbers):
        return None
    year, month, day = map(int, numbers)
    if not (1 <= month <= 12 and 1 <= day <= 31):
        return None
    # The calendar repeats every 400 years of 146,097 days.
    cycles, year = divmod(year, 400)
    first = datetime(2000 + year, month, 1, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC) + timedelta(days=day - 1)
    return (first.days + (cycles - 5) * 146_097) * DAY_MS


def format_duration(ms: int) -> str:
    """The largest unit that divides whole seconds; days only from two on."""
    seconds = ms // 1000
    for unit, size, least in (("d", 86400, 2), ("h", 3600, 1), ("m", 60, 1)):
        if seconds % size == 0 and seconds >= least * size:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def format_size(n: int) -> str:
    """The largest of tb, gb, mb, kb that divides the size; else bytes."""
    for unit in ("tb", "gb", "mb", "kb"):
        if n >= SIZE_UNITS[unit] and n % SIZE_UNITS[unit] == 0:
            return f"{n // SIZE_UNITS[unit]}{unit}"
    return f"{n}b"


def format_date(ms: int) -> str:
    """YYYY-MM-DD, for any year."""
    cycles, days = divmod(ms // DAY_MS - 10957, 146_097)
    at = datetime(2000, 1, 1) + timedelta(days=days)
    return f"{at.year + 400 * cycles:04d}-{at.month:02d}-{at.day:02d}"


# Column forms.


def days_of(ms: Column) -> Column:
    """Whole days since the epoch, floored."""
    return F.floor(ms / DAY_MS).cast("long")


def date_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def instant_text(ms: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS; instants before the epoch read as the epoch."""
    return F.date_format(F.timestamp_millis(F.greatest(ms, F.lit(0))), "yyyy-MM-dd HH:mm:ss")


def human_size(n: Column) -> Column:
    """Bytes as people read them: 512 B, 1.5 KB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1 << (10 * power), F.format_string(f"%.1f {unit}", F.bround(n / float(1 << (10 * power)), 1))).otherwise(out)
    return out


def exact_size(n: Column) -> Column:
    """The spelling of format_size, as a column."""
    out = F.concat(n.cast("string"), F.lit("b"))
    for power, unit in enumerate(("kb", "mb", "gb", "tb"), 1):
        one = 1 << (10 * power)
        out = F.when((n >= one) & (n % one == 0), F.concat((n / one).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def age_text(ms: Column, now: int) -> Column:
    """How long ago an instant was: minutes, hours, days under 30, else the date; null is empty."""
    minutes = F.floor(F.greatest(F.lit(now) - ms, F.lit(0)) / 60_000)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(ms.isNull(), "")
        .when(minutes < 1, "just now")
        .when(minutes < 60, ago(minutes, "m"))
        .when(minutes < 1440, ago(minutes / 60, "h"))
        .when(minutes < 43_200, ago(minutes / 1440, "d"))
        .otherwise(date_text(ms))
    )


def _whole_tens_of_thousands(n: Column) -> Column:
    # What is divided is a multiple of 16, so a double holds it.
    return (n - F.pmod(n, F.lit(10_000))) / 10_000


def filetime_ms(ticks: Column) -> Column:
    """Unix milliseconds of 100-nanosecond ticks since 1601; 0 stays 0."""
    return F.when(ticks == 0, F.lit(0)).otherwise(_whole_tens_of_thousands(ticks - 116_444_736_000_000_000)).cast("long")
