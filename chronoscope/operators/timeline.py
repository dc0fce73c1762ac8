"""The timeline: union, total order, row numbers, pages, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.text import humanized
from chronoscope.operators.anomaly import detail_labels
from chronoscope.operators.settled import settled
from chronoscope.schema import EVENT_CODES, SOURCE_CODES

#: Ties of time are broken by artifact, file and record, as a stable sort of the sources in turn would.
ORDER = ("primary_ticks", "stage", "file_ord", "rec_ord")


def union(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; a column that a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def event_code(kind: Column) -> Column:
    """The shown code of an event kind; a kind outside the list is its own code."""
    codes = F.create_map(*(F.lit(x) for pair in EVENT_CODES.items() for x in pair))
    return F.coalesce(F.element_at(codes, kind), kind)


def source_code(source: Column) -> Column:
    """The shown code of a source struct (kind, detail)."""
    codes = F.create_map(*(F.lit(x) for pair in SOURCE_CODES.items() for x in pair))
    return F.concat(F.coalesce(F.element_at(codes, source["kind"]), source["kind"]), F.coalesce(source["detail"], F.lit("")))


def source_codes(sources: Column, separator: str = "|") -> Column:
    return F.array_join(F.transform(sources, source_code), separator)


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.orderBy(*(order or ORDER))


def numbered(rows: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """rows with their place from 0 in the total order.

    A range sort deals rows into ordered partitions; each is numbered by itself and
    moved by the sizes of those before, so no task sees all rows."""
    order = order or ORDER
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    spread = spread.withColumn("_nth", F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33))
    spread = settled(spread)  # both uses below must see the same range bounds
    sizes = spread.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return spread.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_id", "_nth", "_before")


def page(rows: DataFrame, offset: int, limit: int, *order: str | Column) -> DataFrame:
    return rows.orderBy(*(order or ORDER)).offset(offset).limit(limit)


def top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def search(rows: DataFrame, query: str, path: str = "path") -> DataFrame:
    """Rows whose path contains the query, whatever the case; an empty query finds none."""
    if not query:
        return rows.limit(0)
    return rows.where(F.contains(F.lower(F.col(path)), F.lit(query.lower())))


def cursor(matches: DataFrame, start: int, idx: str = "idx") -> DataFrame:
    """(cursor, matches): the place among the matches of the first from row ``start`` on, or 0 where none follows."""
    before = F.count_if(F.col(idx) < start)
    after = F.count_if(F.col(idx) >= start)
    return matches.agg(F.when(after > 0, before).otherwise(0).alias("cursor"), F.count("*").alias("matches"))


def step(cursor: Column, matches: Column, by: int) -> Column:
    """The next (1) or previous (-1) match, around the ends; null without matches."""
    return F.when(matches > 0, F.pmod(cursor + by, matches))


def _times_line(prefix: str) -> Column:
    shown = [(letter, F.coalesce(F.date_format(f"timestamps.{prefix}_{name}", "yyyy-MM-dd HH:mm:ss"), F.lit("-"))) for letter, name in (("C", "created"), ("M", "modified"), ("A", "accessed"), ("E", "entry_modified"))]
    return F.concat_ws(" ", *(F.concat(F.lit(f"{letter}:"), value) for letter, value in shown))


def details(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and what is shown of one row: path, file (null without an entry number), si and fn times, flags (null where none is set)."""
    m = F.col("metadata")
    size = F.when(m["file_size"].isNotNull(), F.concat(F.lit("  Size: "), humanized("metadata.file_size")))
    file = F.concat(F.lit("Entry "), m["mft_entry_number"].cast("string"), F.lit(" Seq "), F.coalesce(m["mft_sequence"], F.lit(0)).cast("string"), F.coalesce(size, F.lit("")), F.when(m["is_directory"], " [DIR]").otherwise(""))
    return rows.select(*keep, "path", file.alias("file"), _times_line("si").alias("si"), _times_line("fn").alias("fn"), F.when(F.col("anomalies") != 0, detail_labels(F.col("anomalies"))).alias("flags"))


class View:
    """Where a reader of the timeline stands; pure arithmetic on row numbers."""

    def __init__(self, rows: int, visible: int):
        self.rows, self.visible, self.selected, self.first = rows, max(1, visible), 0, 0
        self._before = (0, 0)

    def begin_search(self) -> None:
        """Keeps the place for ``cancel_search``; a search that is confirmed just goes on from its match."""
        self._before = (self.selected, self.first)

    def cancel_search(self) -> None:
        self.selected, self.first = self._before

    def to(self, row: int) -> None:
        """Selects a row, kept inside the timeline, and scrolls as little as shows it."""
        self.selected = min(max(0, row), max(0, self.rows - 1))
        if self.selected < self.first:
            self.first = self.selected
        elif self.selected >= self.first + self.visible:
            self.first = self.selected - self.visible + 1

    def move(self, by: int) -> None:
        self.to(self.selected + by)

    def half_page(self, direction: int) -> None:
        self.move(direction * (self.visible // 2))

    def page(self, direction: int) -> None:
        self.move(direction * self.visible)

    def top(self) -> None:
        self.to(0)

    def bottom(self) -> None:
        self.to(self.rows - 1)


def summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Counts of rows by several sets of columns in one pass: all columns (null where a set hasn't one), n, and level, the bits of the columns that a row's set lacks, the first column highest."""
    columns = list(dict.fromkeys(c for found in sets for c in found))
    grouped = rows.groupingSets([[F.col(c) for c in found] for found in sets], *columns)
    return grouped.agg(F.count("*").alias("n"), F.grouping_id(*columns).cast("long").alias("level"))
