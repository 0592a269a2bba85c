"""Time codes as Column expressions. Media offsets are whole milliseconds (LONG); seconds are DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"(\d{1,2}):(\d{2}):(\d{2})(?:[,.](\d{1,3}))?"
RANGE = rf"^\s*{STAMP}\s*-->\s*{STAMP}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _hms(c: Column, first: int, pattern: str) -> list[Column]:
    return [F.regexp_extract(c, pattern, first + i).try_cast("long") for i in range(3)]


def parse_ms(c: str | Column, pattern: str = STAMP, first: int = 1) -> Column:
    """Milliseconds of a stamp, with a comma or a point. The fraction counts as a whole number: ".5" is 5 ms, a missing one 0. Null if there is none."""
    c = _col(c)
    h, m, s = _hms(c, first, pattern)
    frac = F.coalesce(F.regexp_extract(c, pattern, first + 3).try_cast("long"), F.lit(0))
    return ((h * 60 + m) * 60 + s) * 1000 + frac


def parse_ms_strict(c: str | Column) -> Column:
    """As parse_ms, but only for HH:MM:SS,mmm with three digits and nothing around it; else null."""
    c = _col(c)
    return F.when(c.rlike(r"^\d\d(?::\d\d){2}[,.]\d{3}$"), parse_ms(c))


def parse_seconds(c: str | Column, pattern: str = STAMP, first: int = 1) -> Column:
    """Seconds of a stamp. The fraction is padded on the right: ".5" is half a second."""
    c = _col(c)
    h, m, s = _hms(c, first, pattern)
    frac = F.rpad(F.regexp_extract(c, pattern, first + 3), 3, "0").try_cast("long")
    return ((h * 60 + m) * 60 + s) + F.coalesce(frac, F.lit(0)) / 1000.0


def _two(c: Column) -> Column:
    return F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("long")


def format_clock(ms: str | Column) -> Column:
    """HH:MM:SS of milliseconds, the fraction dropped."""
    s = _div(_col(ms), 1000)
    return F.concat_ws(":", _two(_div(s, 3600)), _two(_div(s, 60) % 60), _two(s % 60))


def format_ms(ms: str | Column) -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    c = _col(ms).cast("long")
    return F.concat(format_clock(c), F.lit(","), F.lpad((c % 1000).cast("string"), 3, "0"))


def format_seconds_truncated(seconds: str | Column) -> Column:
    """HH:MM:SS,mmm of seconds, less than a millisecond cut off."""
    return format_ms((_col(seconds) * 1000).cast("long"))


def format_seconds_rounded(seconds: str | Column) -> Column:
    """HH:MM:SS,mmm of seconds, halves of a millisecond rounded to even."""
    return format_ms(F.bround(_col(seconds) * 1000).cast("long"))


def format_short(seconds: str | Column) -> Column:
    """[MM:SS] of seconds."""
    s = F.floor(_col(seconds)).cast("long")
    return F.concat(F.lit("["), _two(_div(s, 60)), F.lit(":"), _two(s % 60), F.lit("]"))


def duration(start: str | Column, end: str | Column) -> Column:
    return _col(end) - _col(start)


def overlap(start_a: str | Column, end_a: str | Column, start_b: str | Column, end_b: str | Column) -> Column:
    """The length that two ranges share; 0 if they only touch."""
    return F.greatest(F.lit(0), F.least(_col(end_a), _col(end_b)) - F.greatest(_col(start_a), _col(start_b)))


def overlaps(start_a: str | Column, end_a: str | Column, start_b: str | Column, end_b: str | Column) -> Column:
    """Touching ranges don't overlap."""
    return (_col(start_a) < _col(end_b)) & (_col(start_b) < _col(end_a))
