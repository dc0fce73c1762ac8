"""From collections to their timeline and detections: what is decoded here, and room for more rows.

Every class is read and decoded by itself, once, when it is first asked for: rows, errors and what
ranges say of their borders go to one table in the shared folder, split by these. So a class
that nobody asks for costs nothing, and asking for errors decodes nothing again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.functions import times as T
from chronoscope.functions.text import basename, browser, username
from chronoscope.operators import timeline
from chronoscope.operators.settled import Kept, settled
from chronoscope.plans import normalize as N
from chronoscope.sources import collection, decoders, ranges

# Sizes over which files of a class that is decoded as a whole aren't read; errors() names them.
MOST_BYTES = {"lnk": 2 << 20, "recycle_bin": 1 << 20, "jumplist_custom": 50 << 20, "scheduled_task": 1 << 30}
#: Classes decoded from their whole bytes, and in chunks at any size: decoder and columns of each.
WHOLE = {
    "lnk": (decoders.link, decoders.LNK),
    "recycle_bin": (decoders.recycled, decoders.RECYCLED),
    "jumplist_custom": (decoders.custom_links, decoders.CUSTOM_LINKS),
    "scheduled_task": (decoders.task, decoders.TASK),
}
STREAMED = {"wmi": (decoders.wmi_stream, decoders.WMI), "powershell": (decoders.lines_stream, decoders.LINES), "rdp_cache": (decoders.bitmap_head, decoders.BITMAP_HEAD)}
IN_RANGES = {"logfile": (decoders.log_range, decoders.LOG_PAGES), "usnjrnl_j": (ranges.journal_range, ranges.JOURNAL)}
HISTORIES = ("browser", "activities")
DECODED = (*WHOLE, *STREAMED, *IN_RANGES, *HISTORIES)


class Collection:
    """ZIP archives, or folders as they were unpacked, at paths that the driver and all tasks see; their rows together."""

    def __init__(self, spark: SparkSession, archives: str | list[str], as_of: str | None = None, most_visits: int | None = decoders.MOST_ROWS, range_bytes: int = ranges.RANGE_BYTES):
        """``as_of`` (a time as text) stands where an artifact has no time of its own; now, if left out.

        ``most_visits`` of a history are taken, the latest first; all with None. Files of folders larger than ``range_bytes`` are read in ranges."""
        self.spark, self.archives = spark, [archives] if isinstance(archives, str) else list(archives)
        self.most_visits, self.range_bytes = most_visits, range_bytes
        self.as_of: Column = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        self.listing = settled(collection.listings(spark, self.archives))
        self.files = collection.manifest(self.listing).join(self.listing.drop("original_path"), "ordinal")
        self._kept, self._tables = Kept(spark, "collection"), {}

    def counts(self) -> DataFrame:
        """(artifact_class, n)."""
        return timeline.summary(self.files, "artifact_class")

    def hosts(self) -> DataFrame:
        """(file_ord, archive, host, collected): which collection a timeline row's file is from."""
        return self.files.select(F.col("ordinal").alias("file_ord"), "archive", "host", "collected")

    def chosen(self, artifact_class: str) -> DataFrame:
        files = self.files.where(F.col("artifact_class") == artifact_class)
        if artifact_class in collection.SINGLE:  # of each collection the last one counts
            last = files.groupBy("archive").agg(F.max("ordinal").alias("ordinal"))
            files = files.join(last, ["archive", "ordinal"], "left_semi")
        return files.select(F.col("ordinal").alias("file_ord"), "archive", "original_path", "windows_path", "username", "size", "whole")

    def _decoded(self, artifact_class: str) -> DataFrame:
        files = self.chosen(artifact_class)
        if artifact_class in WHOLE:
            decode, schema = WHOLE[artifact_class]
            return decoders.decoded(collection.entry_bytes(files.drop("size", "whole"), most=MOST_BYTES[artifact_class]), decode, schema)
        if artifact_class in STREAMED:
            return collection.entry_rows(files, None, *STREAMED[artifact_class])
        if artifact_class in IN_RANGES:
            return collection.entry_rows(ranges.split(files, self.range_bytes).repartition("file_ord", "offset"), None, *IN_RANGES[artifact_class])
        if artifact_class == "activities":
            return collection.entry_rows(files, None, decoders.sqlite_stream(decoders.ACTIVITY_SQL, self.most_visits), decoders.ACTIVITY)
        files = files.withColumn("browser", browser(F.col("windows_path")))
        kinds = (("browser = 'Firefox'", decoders.FIREFOX_SQL), ("browser <> 'Firefox'", decoders.CHROMIUM_SQL))
        return timeline.union(*(collection.entry_rows(files.where(test), None, decoders.sqlite_stream(sql, self.most_visits), decoders.HISTORY) for test, sql in kinds))

    def decoded(self, artifact_class: str) -> DataFrame:
        """Rows and error rows of a class, and ``outcome`` (row, error, border); decoded when this is first called."""
        if artifact_class not in self._tables:
            found = self._decoded(artifact_class)
            border = F.col("rec_ord").isNotNull() & F.col("place").isNull() if artifact_class == "usnjrnl_j" else F.lit(False)
            outcome = F.when(F.col("error").isNotNull(), "error").when(border, "border").otherwise("row")
            table = self._kept.write(found.withColumn("outcome", outcome), artifact_class, "outcome")
            if artifact_class == "usnjrnl_j":
                table = self._fitted(table)
            self._tables[artifact_class] = collection.sound(table)
        return self._tables[artifact_class]

    def _fitted(self, journals: DataFrame) -> DataFrame:
        """The journals' rows; a file whose ranges don't fit together is walked again from where they don't."""
        wrong = settled(ranges.wrong_borders(journals.where("outcome = 'border'")))
        journals = journals.where("outcome <> 'border'")
        if wrong.isEmpty():
            return journals
        again = self.chosen("usnjrnl_j").join(wrong.select("file_ord", F.col("from_place").alias("offset"), "from_offset"), "file_ord")
        files = again.withColumn("stop", F.col("size")).drop("from_offset")
        more = self._kept.write(collection.entry_rows(files, None, ranges.walk_on, ranges.JOURNAL).withColumn("outcome", F.when(F.col("error").isNotNull(), "error").otherwise("row")), "usnjrnl_j-again", "outcome")
        good = journals.join(wrong, "file_ord", "left").where("from_offset is null or offset < from_offset").select(*journals.columns)
        return good.unionByName(more.select(*journals.columns))

    def rows(self, artifact_class: str) -> DataFrame:
        """The rows of a class without its errors; a journal's are numbered by their places."""
        found = self.decoded(artifact_class).where("outcome = 'row'").drop("error", "outcome")
        if artifact_class == "usnjrnl_j":
            return found.withColumn("rec_ord", F.col("place"))
        return found.withColumn("rec_ord", F.col("page_no")) if artifact_class == "logfile" else found

    def errors(self) -> DataFrame:
        """(artifact_class, windows_path, error) of files that couldn't be read or decoded, from the tables that hold their rows."""
        found = (self.decoded(c).where("outcome = 'error'").select(F.lit(c).alias("artifact_class"), "windows_path", "error") for c in DECODED)
        return timeline.union(*found)

    def remove(self) -> bool:
        """Deletes the decoded tables; rows that were got from them can't be read any more."""
        self._tables = {}
        return self._kept.remove()

    def parts(self, file_paths: DataFrame | None = None) -> dict[str, DataFrame]:
        """Timeline rows by artifact; file_paths (entry, path, and archive where there are several) resolves the journals' parents."""
        if file_paths is not None and len(self.archives) > 1 and "archive" not in file_paths.columns:
            raise ValueError("file_paths of several collections need the column archive")
        log = self.rows("logfile")
        summary = decoders.log_summary(log, "file_ord")
        areas = log.where("lsn is not null").select("file_ord", (F.col("page_no") * decoders.PAGE).alias("offset"), "lsn", "clients", F.col("page_no").alias("rec_ord"))
        areas = areas.join(summary.select("file_ord", F.col("record_pages").alias("pages"), "gap"), "file_ord")
        lines = self.rows("powershell").withColumn("rec_ord", F.col("line_no").cast("long"))
        tasks = self.rows("scheduled_task").withColumns(decoders.task_columns()).where("date is not null")
        firefox = self.rows("browser").where("browser = 'Firefox'").withColumn("ts", T.firefox_time("visit"))
        chromium = self.rows("browser").where("browser <> 'Firefox' and title is not null").withColumn("ts", T.chrome_time("visit"))
        caches = self.rows("rdp_cache").withColumns(decoders.bitmap_columns(F.col("head"), F.col("size"))).withColumn("file", basename(F.col("windows_path"))).withColumn("username", username(F.col("windows_path"), "Unknown"))
        listed = self.rows("jumplist_custom")
        place = F.concat("windows_path", F.lit(":offset_0x"), F.lower(F.hex("offset")))
        return {
            "JumpList": N.jump_lists(listed.withColumn("target", F.coalesce("target", place))),
            "LogFile": N.log_file(areas, self.as_of),
            "Wmi": N.wmi(decoders.wmi_entries(self.rows("wmi")), self.as_of),
            "UsnJrnl": N.change_journal(self.rows("usnjrnl_j"), file_paths),
            "Lnk": N.shortcuts(self.rows("lnk").withColumnRenamed("windows_path", "lnk_path")),
            "RecycleBin": N.recycle_bin(self.rows("recycle_bin")),
            "PowerShell": N.powershell(lines, self.as_of),
            "Browser": N.browser_history(timeline.union(firefox, chromium)),
            "Activities": N.activities(self.rows("activities")),
            "RdpCache": N.rdp_bitmaps(caches, self.as_of),
            "ScheduledTask": N.scheduled_tasks(tasks),
        }

    def timeline(self, *more: DataFrame, file_paths: DataFrame | None = None) -> DataFrame:
        """All rows of this collection and further timeline rows, not yet ordered."""
        return N.build(*self.parts(file_paths).values(), *more)
