"""CSV, JSON and bodyfile forms of the timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.functions.times import ticks_of
from chronoscope.operators.anomaly import csv_labels
from chronoscope.operators.timeline import ORDER, numbered, source_codes
from chronoscope.schema import EVENT_CODES

MILLIS = "yyyy-MM-dd HH:mm:ss.SSS"

# The CSV file's columns and where their times come from.
CSV_TIMES = {
    "SI_Created": "si_created",
    "SI_Modified": "si_modified",
    "SI_Accessed": "si_accessed",
    "SI_EntryMod": "si_entry_modified",
    "FN_Created": "fn_created",
    "FN_Modified": "fn_modified",
    "FN_Accessed": "fn_accessed",
    "FN_EntryMod": "fn_entry_modified",
}


def _or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def csv_rows(timeline: DataFrame) -> DataFrame:
    """The 16 columns as strings; missing values are empty, times are cut to milliseconds."""
    times = [_or_empty(F.date_format(F.col(f"timestamps.{c}"), MILLIS)).alias(n) for n, c in CSV_TIMES.items()]
    return timeline.select(
        F.date_format("primary_ts", MILLIS).alias("Timestamp"),
        F.col("event_code").alias("Event"),
        F.col("path").alias("Path"),
        source_codes(F.col("sources")).alias("Sources"),
        csv_labels(F.col("anomalies")).alias("Anomalies"),
        *times,
        _or_empty(F.col("metadata.mft_entry_number")).alias("MFT_Entry"),
        _or_empty(F.col("metadata.file_size")).alias("FileSize"),
        F.coalesce(F.col("metadata.is_directory"), F.lit(False)).cast("string").alias("IsDir"),
    )


def write_csv(timeline: DataFrame, path: str) -> None:
    """Ordered part files with a header each; the sort ranges keep their order over the files."""
    csv_rows(timeline.orderBy(*ORDER)).write.csv(path, header=True, emptyValue="", escape='"', mode="overwrite")


def quoted(text: Column) -> Column:
    """A string as JSON, or ``null``."""
    inside = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(inside, F.lit(6), F.length(inside) - 6)


def json_enum(kind: Column, detail: Column) -> Column:
    return F.when(detail.isNull(), quoted(kind)).otherwise(F.concat(F.lit("{"), quoted(kind), F.lit(":"), quoted(detail), F.lit("}")))


def json_time(ts: Column, ticks: Column | None = None) -> Column:
    """A time as JSON with as many digits (none, 3, 6 or 9) as it needs; ticks (100 ns since 1601) say more than microseconds do. Null is ``null``."""
    exact = ticks if ticks is not None else ticks_of(ts)
    exact = F.coalesce(exact, ticks_of(ts))
    part = exact % 10_000_000
    digits = F.lpad(part.cast("string"), 7, "0")
    fraction = F.when(part == 0, "").when(part % 10_000 == 0, F.concat(F.lit("."), F.left(digits, F.lit(3)))).when(part % 10 == 0, F.concat(F.lit("."), F.left(digits, F.lit(6)))).otherwise(F.concat(F.lit("."), digits, F.lit("00")))
    return F.coalesce(F.concat(F.lit('"'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit('Z"')), F.lit("null"))


def json_times(timeline: DataFrame) -> Column:
    """The timestamps as a JSON object, nulls kept."""
    types = dict(timeline.select("timestamps.*").dtypes)
    fine = set(timeline.select("ticks.*").columns) if "ticks" in timeline.columns else set()
    parts = []
    for name, kind in types.items():
        ts = F.col(f"timestamps.{name}")
        if kind.startswith("array"):
            value = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(ts, lambda t: json_time(t)), ","), F.lit("]")), F.lit("[]"))
        else:
            value = json_time(ts, F.col(f"ticks.{name}") if name in fine else None)
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_text(timeline: DataFrame) -> Column:
    """An object a row with all fields, nulls kept, enums as a name or an object (a kind outside the list is ``Other``), flags as a number."""
    entity = F.concat(F.lit("{"), quoted(F.col("entity_kind")), F.lit(":"), F.col("entity_num").cast("string"), F.lit("}"))
    kind = F.when(F.col("event_kind").isin(*EVENT_CODES), quoted(F.col("event_kind"))).otherwise(F.concat(F.lit('{"Other":'), quoted(F.col("event_kind")), F.lit("}")))
    sources = F.concat(F.lit("["), F.array_join(F.transform("sources", lambda s: json_enum(s["kind"], s["detail"])), ","), F.lit("]"))
    fields = [
        ("entity_id", entity),
        ("path", quoted(F.col("path"))),
        ("primary_timestamp", json_time(F.col("primary_ts"), F.col("primary_ticks"))),
        ("event_type", kind),
        ("timestamps", json_times(timeline)),
        ("sources", sources),
        ("anomalies", F.col("anomalies").cast("string")),
        ("metadata", F.to_json("metadata", {"ignoreNullFields": "false"})),
    ]
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))) for name, value in fields]
    return F.concat(F.lit("{"), reduce(lambda a, b: F.concat(a, F.lit(","), b), parts), F.lit("}"))


def json_rows(timeline: DataFrame) -> DataFrame:
    """A column ``json``, as ``json_text`` gives it."""
    return timeline.select(json_text(timeline).alias("json"))


def write_json(timeline: DataFrame, path: str, lines: bool = False) -> None:
    """An array of objects in order: the part files, one after the other, are one JSON text. With ``lines`` an object a line and no array."""
    if lines:
        return json_rows(timeline.orderBy(*ORDER)).write.text(path)
    placed = numbered(timeline, name="_place")
    objects = placed.select("_place", F.concat(F.when(F.col("_place") > 0, ",").otherwise(""), json_text(placed)).alias("line"))
    ends = timeline.sparkSession.createDataFrame([(-1, "["), ((1 << 63) - 1, "]")], "_place long, line string")
    objects.union(ends).orderBy("_place").select("line").write.text(path)


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down; -1 where there is no time."""
    return F.coalesce(F.floor(F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("long"), F.lit(-1).cast("long"))


def body_line(path: Column, sources: Column, number: Column, sequence: Column, sha256: Column, size: Column, accessed: Column, modified: Column, changed: Column, created: Column, primary: Column) -> Column:
    """A bodyfile line: digest, name, inode, mode, uid, gid, size and four times."""
    a, m, c, b = (epoch(x) for x in (accessed, modified, changed, created))
    none = (a == -1) & (m == -1) & (c == -1) & (b == -1)
    inode = F.coalesce(F.concat_ws("-", number.cast("string"), F.coalesce(sequence, F.lit(0)).cast("string")), F.lit("0"))
    inode = F.when(number.isNull(), "0").otherwise(inode)
    return F.concat_ws("|", F.coalesce(sha256, F.lit("0")), F.concat(path, F.lit(" ("), sources, F.lit(")")), inode, F.lit(""), F.lit("0"), F.lit("0"), F.coalesce(size, F.lit(0)).cast("string"), a.cast("string"), F.when(none, epoch(primary)).otherwise(m).cast("string"), c.cast("string"), b.cast("string"))


def bodyfile_rows(timeline: DataFrame) -> DataFrame:
    number = F.when(F.col("entity_kind") == "MftEntry", F.col("entity_num")).otherwise(F.col("metadata.mft_entry_number"))
    t = F.col("timestamps")
    line = body_line(F.col("path"), source_codes(F.col("sources")), number, F.col("metadata.mft_sequence"), F.col("metadata.sha256"), F.col("metadata.file_size"), t["si_accessed"], t["si_modified"], t["si_entry_modified"], t["si_created"], F.col("primary_ts"))
    return timeline.select(line.alias("line"))


def write_bodyfile(timeline: DataFrame, path: str) -> None:
    bodyfile_rows(timeline.orderBy(*ORDER)).write.text(path)
