"""Bytes of registry values as columns; a value that is too short gives null. Numbers are little-endian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoscope.functions import times as T


def number(data: Column, at: Column | int, size: int) -> Column:
    """The unsigned number of ``size`` bytes (8 at most) from a place on; null where the value ends before, or no long can hold it."""
    at = F.lit(at) if isinstance(at, int) else at
    pairs = F.hex(F.substr(data, at + 1, F.lit(size)))
    turned = F.concat(*(F.substr(pairs, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(size))))
    return F.when(F.octet_length(data) >= at + size, F.conv(turned, 16, 10).try_cast("long"))


def filetime_value(data: Column) -> Column:
    """Ticks in the first eight bytes."""
    return number(data, 0, 8)


def systemtime_value(data: Column) -> Column:
    """The time of a 16-byte calendar value to the second; its day of the week and milliseconds don't count."""
    year, month, day, hour, minute, second = (number(data, at, 2).cast("int") for at in (0, 2, 6, 8, 10, 12))
    known = (F.octet_length(data) >= 16) & (month > 0) & (day > 0) & (second < 60)
    return F.when(known, T.systemtime(year, month, day, hour, minute, second))


def user_assist_value(data: Column) -> Column:
    """struct<run_count, focus_count, focus_ms, ticks> of the form of 72 bytes or more, or of the older one of 16 or more."""
    long_form, short_form = F.octet_length(data) >= 72, F.octet_length(data) >= 16
    focus = [F.when(long_form, number(data, at, 4)) for at in (8, 12)]
    ticks = F.when(long_form, number(data, 60, 8)).otherwise(number(data, 8, 8))
    return F.when(short_form, F.struct(number(data, 4, 4).alias("run_count"), focus[0].alias("focus_count"), focus[1].alias("focus_ms"), ticks.alias("ticks")))


def recent_order(data: Column) -> Column:
    """array<long>: the numbers of a list of recent items, the latest first, up to its end mark."""
    words = F.floor(F.octet_length(data) / 4).cast("int")
    items = F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), lambda i: number(data, i * 4, 4))).otherwise(F.array().cast("array<long>"))
    end = F.array_position(items, F.lit(0xFFFFFFFF).cast("long")).cast("int")
    return F.when(end > 0, F.slice(items, F.lit(1), end - 1)).otherwise(items)


def wide_text(data: Column) -> Column:
    """Little-endian UTF-16 without the NULs at its end; a lone surrogate becomes U+FFFD, an odd last byte doesn't count."""
    many = F.floor(F.octet_length(data) / 2).cast("int")
    pairs = F.hex(data)
    units = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substr(pairs, i * 4 + 1, F.lit(4)))

    def surrogate(unit: Column, kinds: str) -> Column:
        return F.coalesce(F.substr(unit, F.lit(3), F.lit(2)).rlike(f"^D[{kinds}]"), F.lit(False))

    def mended(unit: Column, i: Column) -> Column:
        before, after = (F.get(units, i + k) for k in (-1, 1))
        lone = surrogate(unit, "89AB") & ~surrogate(after, "CDEF") | surrogate(unit, "CDEF") & ~surrogate(before, "89AB")
        return F.when(lone, "FDFF").otherwise(unit)

    text = F.decode(F.unhex(F.array_join(F.transform(units, mended), "")), "UTF-16LE")
    return F.when(data.isNotNull() & (many > 0), F.regexp_replace(text, "\\x00+$", "")).when(data.isNotNull(), "")


def sid(data: Column) -> Column:
    """``S-1-...`` of a binary security identifier; null for bytes of any other form."""
    many = number(data, 1, 1).cast("int")
    fits = (number(data, 0, 1) == 1) & many.between(1, 15) & (F.octet_length(data) == 8 + 4 * many)
    authority = F.conv(F.substr(F.hex(data), F.lit(5), F.lit(12)), 16, 10)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1), lambda i: number(data, 8 + i * 4, 4).cast("string"))
    return F.when(fits, F.concat_ws("-", F.lit("S-1"), authority, F.array_join(parts, "-")))


def id_name(data: Column) -> Column:
    """What a blob of an id map says: a security identifier, or a text of which no sign is a control; else null."""
    text = wide_text(data)
    return F.coalesce(sid(data), F.when((text != "") & ~text.rlike("[\\x00-\\x1f\\x7f-\\x9f]"), text))
