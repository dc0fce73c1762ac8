"""Text functions on columns: paths, names, labels, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rot13(text: Column) -> Column:
    return F.translate(text, LOWER + UPPER, LOWER[13:] + LOWER[:13] + UPPER[13:] + UPPER[:13])


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def app_id(path: Column) -> Column:
    """The 16 hex digits before the first dot of a jump list's name, lower case; null where there are none."""
    found = F.lower(F.regexp_extract(basename(path), r"^([0-9a-fA-F]{16})\.", 1))
    return F.when(found != "", found)


def device_path(path: Column) -> Column:
    r"""``\Device\HarddiskVolume3\x`` as ``C:\x``; other paths as they are."""
    return F.regexp_replace(path, r"^\\Device\\HarddiskVolume[^\\]*(\\.*)$", "C:$1")


def image_path(path: Column, drive: str) -> Column:
    """A path inside a disk image as a Windows path."""
    return F.concat(F.lit(f"{drive}:\\"), F.translate(F.regexp_replace(path, "^/+", ""), "/", "\\"))


def username(path: Column, missing: str = "unknown") -> Column:
    """The part after the first ``Users``."""
    found = F.regexp_extract(path, r"(?i)(?:^|\\)users\\([^\\]+)", 1)
    return F.when(found != "", found).otherwise(missing)


def hostname(file_name: Column) -> Column:
    """The host in ``Collection-<host>-<year from 2020>...``."""
    found = F.regexp_extract(file_name, r"^Collection-(.*?)-202", 1)
    return F.when(found != "", found).otherwise("unknown")


def browser(path: Column) -> Column:
    lower = F.lower(path)
    return F.when(lower.contains("firefox") | lower.contains("mozilla"), "Firefox").when(lower.contains("edge"), "Edge").otherwise("Chrome")


def _choice(value: Column, names: dict[int, str], other: Column | str) -> Column:
    chosen = F
    for number, name in names.items():
        chosen = chosen.when(value == number, name)
    return chosen.otherwise(other)


# Labels of numeric codes.
START_TYPES = {0: "Boot", 1: "System", 2: "Auto", 3: "Manual", 4: "Disabled"}
NETWORK_TYPES = {6: "Wired", 23: "VPN", 71: "Wireless"}
ACTIVITY_TYPES = {5: "Open", 6: "Focus", 16: "Clipboard"}


def start_type(value: Column) -> Column:
    return _choice(value, START_TYPES, "Unknown")


def network_type(value: Column) -> Column:
    return _choice(value, NETWORK_TYPES, "Unknown")


def activity_type(value: Column) -> Column:
    return _choice(value, ACTIVITY_TYPES, F.concat(F.lit("Type:"), value.cast("string")))


def activity_app(app_id: Column) -> Column:
    """The first ``application`` of a JSON array; other texts as they are, cut after 100 characters."""
    items = F.from_json(app_id, "array<struct<application:string>>")
    first = F.get(F.filter(F.transform(items, lambda x: x["application"]), lambda x: x.isNotNull()), F.lit(0))
    whole = F.when(F.octet_length(app_id) > 100, F.concat(F.left(app_id, F.lit(100)), F.lit("..."))).otherwise(app_id)
    return F.coalesce(first, whole)


def _tenths(n: str, unit: int) -> str:
    """SQL for n / unit in tenths, a half rounded to the even one, in whole numbers."""
    q, r = f"(({n} * 10) div {unit})", f"(({n} * 10) % {unit})"
    return f"({q} + case when {r} * 2 > {unit} or ({r} * 2 = {unit} and {q} % 2 = 1) then 1 else 0 end)"


def humanized_sql(n: str) -> str:
    """SQL (Spark's and DuckDB's but for the division sign) for a byte count with one decimal."""
    def shown(unit: int, name: str) -> str:
        t = _tenths(n, unit)
        return f"concat(cast({t} div 10 as string), '.', cast({t} % 10 as string), ' {name}')"

    return f"case when {n} >= 1073741824 then {shown(1 << 30, 'GB')} when {n} >= 1048576 then {shown(1 << 20, 'MB')} when {n} >= 1024 then {shown(1 << 10, 'KB')} else concat(cast({n} as string), ' B') end"


def humanized(column: str) -> Column:
    return F.expr(humanized_sql(column))


def truncated(path: Column, width: int) -> Column:
    """The path's end after three dots, where it is longer than ``width``."""
    if width < 4:
        return path
    return F.when(F.length(path) <= width, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(width - 3))))


def mac_address(raw: Column) -> Column:
    """Six bytes as lower-case hex pairs with colons."""
    return F.regexp_replace(F.lower(F.hex(raw)), "(..)(?=.)", "$1:")
