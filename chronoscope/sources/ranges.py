"""Large files in ranges, each decoded by a task of its own, with the rows that the whole file gives.

Log pages begin at known places. A journal's records follow each other by their lengths, so
a range doesn't know where its first one begins. It guesses: the first place that looks like a
record in every respect. Beside its rows it leaves a border: the place it began at, the
first place it left to the next range, and the last place before its beginning where the walk
over the whole file could have found anything. The guesses are right if each range begins where
the walk that comes out of the range before arrives; that is compared over the borders alone.
Where it doesn't hold, the rest of that file is walked again, from the last known place on."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import IO

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.sources import decoders

#: Bytes of a range; a record that looks right in every respect is at most this long.
RANGE_BYTES, LONGEST = 64 << 20, 1 << 16

JOURNAL = f"place long, {decoders.USN}, entry_at long, exit_at long, loose_at long"


def split(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files with ``offset`` and ``stop``, a row for each range; a file that is only read as a whole has one."""
    many = F.when(F.col("whole"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / range_bytes))).cast("long")
    cut = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("_nth"), many.alias("_many"))
    stop = F.when(F.col("_nth") == F.col("_many") - 1, F.col("size")).otherwise((F.col("_nth") + 1) * range_bytes)
    return cut.withColumns({"offset": F.col("_nth") * range_bytes, "stop": stop}).drop("_nth", "_many")


def beginning(file: IO[bytes], size: int, start: int, stop: int) -> tuple[int | None, int | None]:
    """(where the range's first record seems to begin, the last place before it that a walk would take for one)."""
    file.seek(start)
    base, data, place, loose = start, b"", start, None
    while place + 60 <= size and place < stop:
        if place - base + LONGEST + 60 > len(data) and base + len(data) < size:
            data, base = data[place - base :] + file.read(decoders.CHUNK), place
        at = place - base
        length, major, minor = struct.unpack_from("<IHH", data, at)
        if 60 <= length <= size - place and major in (2, 3):
            wide = 16 if major == 3 else 0
            name_size, name_at = struct.unpack_from("<HH", data, at + 56 + wide) if at + 60 + wide <= len(data) else (0, 0)
            if minor == 0 and length <= LONGEST and length % 8 == 0 and name_at == 60 + wide and name_at + name_size <= length:
                return place, loose
            loose = place
        elif length == 0 and major == 0:
            found = decoders.NOT_ZERO.search(data, at)
            place += max(8, ((found.start() if found else len(data)) - at) // 8 * 8) - 8
        place += 8
    return None, loose


def journal_range(file: IO[bytes], size: int, start: int, stop: int) -> Iterator[tuple]:
    """The records that begin in a range, and at last its border."""
    entry, loose = (0, None) if start == 0 else beginning(file, size, start, stop)
    nothing = (None,) * 10
    if entry is None:
        yield *nothing, None, None, loose
        return
    file.seek(entry)
    walk = decoders.JournalWalk(file, size, entry, stop)
    for row in walk:
        yield *row, None, None, None
    yield *nothing, entry, walk.place, loose


def wrong_borders(borders: DataFrame) -> DataFrame:
    """(file_ord, from_offset, from_place): of each file whose ranges don't fit together the first such range and the place to walk on from."""
    earlier = Window.partitionBy("file_ord").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("exit_at", ignorenulls=True).over(earlier), F.lit(0))
    come = borders.select("file_ord", "offset", "entry_at", "loose_at", before.alias("before"))
    right = F.coalesce(F.col("loose_at") < F.col("before"), F.lit(True)) & F.coalesce(F.col("before") <= F.col("entry_at"), F.lit(True))
    return come.where((F.col("offset") > 0) & ~right).groupBy("file_ord").agg(F.min("offset").alias("from_offset"), F.min_by("before", "offset").alias("from_place"))


def walk_on(file: IO[bytes], size: int, start: int, stop: int) -> Iterator[tuple]:
    """All records from a known place on."""
    file.seek(start)
    for row in decoders.JournalWalk(file, size, start, stop):
        yield *row, None, None, None
