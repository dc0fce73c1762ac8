"""A timeline that is sorted and written once, and then paged and searched by reading few files.

Rows are dealt to parts by ranges of the order, a folder of files each. A manifest has for each
part how many rows it has and how many are before it, so a row number leads to its part by
arithmetic. For searches each part has a bit set of the trigrams of its paths: a part that lacks
one of a query's trigrams isn't read. Nothing is sorted, counted or checkpointed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoscope.operators import timeline
from chronoscope.operators.settled import Kept

#: Rows of a part, about; bits of a part's set of trigrams.
ROWS_A_PART, GRAM_BITS = 1 << 20, 1 << 16


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, each as a bit's number."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    found = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(low, i, F.lit(3))), F.lit(GRAM_BITS)).cast("int"))
    return F.when(F.length(low) >= 3, F.array_distinct(found)).otherwise(F.array().cast("array<int>"))


class KeptTimeline:
    """Ordered rows in a folder of the shared one; ``remove`` deletes it."""

    def __init__(self, rows: DataFrame, *order: str, path: str = "path", rows_a_part: int = ROWS_A_PART):
        """Sorts and writes rows. The order must tell all rows apart, or equal ones follow each other in any order, once and for all."""
        self.spark: SparkSession = rows.sparkSession
        self.order, self.path = order or timeline.ORDER, path
        self._kept = Kept(self.spark, "timeline")
        parts = max(1, -(-rows.count() // rows_a_part))
        dealt = rows.repartitionByRange(parts, *self.order).sortWithinPartitions(*self.order)
        dealt = dealt.withColumns({"kept_part": F.spark_partition_id(), "kept_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        self.table = self._kept.write(dealt, "rows", "kept_part")
        keys = F.struct(*self.order)
        counted = self.table.groupBy("kept_part").agg(F.count("*").alias("n"), F.min(keys).alias("first"), F.max(keys).alias("last"))
        before = Window.orderBy("kept_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        self.manifest = self._kept.write(counted.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "manifest")
        bit = self.table.select("kept_part", F.explode(grams(F.col(self.path))).alias("bit"))
        words = bit.groupBy("kept_part", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
        self.grams = self._kept.write(words, "grams")

    def _rows(self, parts: list[int], name: str) -> DataFrame:
        """The rows of some parts with their numbers; no other files are read."""
        own = self.table.where(F.col("kept_part").isin(parts)) if parts else self.table.limit(0)
        placed = own.join(F.broadcast(self.manifest.where(F.col("kept_part").isin(parts) if parts else F.lit(False)).select("kept_part", "before")), "kept_part")
        return placed.withColumn(name, F.col("before") + F.col("kept_nth")).drop("kept_part", "kept_nth", "before")

    def count(self) -> int:
        return self.manifest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def numbered(self, name: str = "idx") -> DataFrame:
        """All rows with their numbers from 0."""
        placed = self.table.join(self.manifest.select("kept_part", "before"), "kept_part")
        return placed.withColumn(name, F.col("before") + F.col("kept_nth")).drop("kept_part", "kept_nth", "before")

    def page_parts(self, offset: int, limit: int) -> list[int]:
        """The parts that rows ``offset`` to ``offset + limit - 1`` are in."""
        found = self.manifest.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        return sorted(r.kept_part for r in found.select("kept_part").collect())  # a row for each part of the page

    def page(self, offset: int, limit: int, name: str = "idx") -> DataFrame:
        return self._rows(self.page_parts(offset, limit), name).where((F.col(name) >= offset) & (F.col(name) < offset + limit))

    def search_parts(self, query: str) -> list[int]:
        """The parts that may have a path with the query in it: at most one row a part is looked at on the driver."""
        wanted = self.spark.range(1).select(F.explode(grams(F.lit(query))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("need"))
        needed = {r.word: r.need for r in wanted.collect()}  # at most as many as the query has signs
        if not needed:
            return sorted(r.kept_part for r in self.manifest.select("kept_part").collect())
        need = F.element_at(F.create_map(*(F.lit(x) for pair in needed.items() for x in pair)), F.col("word"))
        having = self.grams.where(F.col("word").isin(list(needed)) & (F.col("bits").bitwiseAND(need) == need))
        return sorted(r.kept_part for r in having.groupBy("kept_part").count().where(F.col("count") == len(needed)).collect())

    def search(self, query: str, name: str = "idx") -> DataFrame:
        """Rows, with their numbers, whose path contains the query, whatever the case; an empty query finds none."""
        found = self._rows(self.search_parts(query) if query else [], name)
        return timeline.search(found, query, self.path)

    def cursor(self, query: str, start: int) -> DataFrame:
        """(cursor, matches) as ``timeline.cursor`` gives them."""
        return timeline.cursor(self.search(query), start)

    def remove(self) -> bool:
        return self._kept.remove()
