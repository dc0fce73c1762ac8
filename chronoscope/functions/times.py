"""Time conversions. Ticks are 100 ns since 1601; what can't be a time is null, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1970 in ticks and in microseconds since 1601.
UNIX_EPOCH_TICKS = 116_444_736_000_000_000
UNIX_EPOCH_CHROME = 11_644_473_600_000_000
TICKS_A_SECOND = 10_000_000


def _filled(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def whole(x: Column, by: int) -> Column:
    """Whole-number quotient of a number from 0 on, exact where a double isn't."""
    return ((x - F.pmod(x, F.lit(by))).cast("decimal(20,0)") / F.lit(by)).cast("long")


def filetime_micros(ticks: Column | str) -> Column:
    """Microseconds since 1970; null for 0 and for times before 1970."""
    ticks = _filled(ticks).cast("long")
    return F.when(ticks >= UNIX_EPOCH_TICKS, whole(ticks - UNIX_EPOCH_TICKS, 10))


def filetime(ticks: Column | str) -> Column:
    return F.timestamp_micros(filetime_micros(ticks))


def chrome_micros(value: Column | str) -> Column:
    """Microseconds since 1601 as microseconds since 1970; null unless both are positive or zero."""
    value = _filled(value).cast("long")
    return F.when((value > 0) & (value >= UNIX_EPOCH_CHROME), value - UNIX_EPOCH_CHROME)


def chrome_time(value: Column | str) -> Column:
    return F.timestamp_micros(chrome_micros(value))


def firefox_time(value: Column | str) -> Column:
    """Microseconds since 1970, if positive."""
    value = _filled(value).cast("long")
    return F.timestamp_micros(F.when(value > 0, value))


def unix_time(value: Column | str) -> Column:
    """Seconds since 1970, if positive."""
    value = _filled(value).cast("long")
    return F.timestamp_seconds(F.when(value > 0, value))


def systemtime(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A calendar time; milliseconds are dropped, an impossible date is null."""
    return F.when(year > 0, F.try_make_timestamp(year, month, day, hour, minute, second))


def ticks_of(ts: Column | str) -> Column:
    """A timestamp in ticks (to the microsecond)."""
    return F.unix_micros(_filled(ts).cast("timestamp")) * 10 + UNIX_EPOCH_TICKS


def iso_ticks(text: Column | str) -> Column:
    """Ticks of an ISO time with up to seven decimals, the seventh of which a timestamp can't hold."""
    text = _filled(text)
    seventh = F.regexp_extract(text, r"\.[0-9]{6}([0-9])", 1)
    return ticks_of(F.try_to_timestamp(F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1"))) + F.when(seventh == "", 0).otherwise(seventh.try_cast("int"))


#: What the letters of a format match, a year with its sign and further digits included.
_LETTERS = {"yyyy": "[+-]?[0-9]{4,}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "X": "(?:[Zz]|[+-][0-9]{2,4})"}


def _form(pattern: str) -> str:
    """A regular expression that every text of this format matches; letters that aren't listed match anything."""
    parts = (x.group() for x in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']", pattern))
    return "(?is)^" + "".join(_LETTERS.get(x, ".*") if x.isalpha() else re.escape(x.strip("'")) for x in parts) + "$"


def one_of_formats(text: Column | str, *formats: str) -> Column:
    """The time by the first format that fits. A parser sees only texts of its form: one that it can't read costs it an exception, some hundred times a time."""
    text = _filled(text)
    return F.coalesce(*(F.when(text.rlike(_form(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats))


#: Date strings of program inventories.
INVENTORY_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def shown(ts: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss", missing: str = "-") -> Column:
    return F.coalesce(F.date_format(_filled(ts), pattern), F.lit(missing))
